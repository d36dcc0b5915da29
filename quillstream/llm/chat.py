"""Chat formatting: typed content parts to one marked string, with DataFrame functions only.

Each turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``.  Content is the turn's parts in
order: texts as they are, image, audio and document parts as the placeholders ``<|image|>``,
``<|audio|>`` and ``<|document|>``, each of which is also recorded in ``attachments`` with its
reference and the number of tokens it will stand for.

Escaping: in texts and roles every ``<``, any number of backslashes, ``|`` gets one more
backslash before the bar.  No escaped text holds ``<|``, so none holds a control string, and
taking one backslash away gives the text back.  In roles, percent signs are written ``%25`` and
line feeds ``%0A`` before that.

The loss mask is kept as the list of the output's segments, in order, each with a flag: an
assistant's texts are under the mask, one segment each; marks, placeholders and other turns
aren't.  The segments joined are the formatted string; both are the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

START, END = "<|im_start|>", "<|im_end|>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels on a side of one image token, audio tokens a second, tokens a document page.
IMAGE_SIDE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    # each percent sign is followed by its own two digits, so no other text reads as a code
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def visit_part(part: Column) -> Column:
    """(segment, is_text, type, ref, tokens) of a part; an unknown type counts as a document."""
    kind = F.coalesce(part["type"], F.lit("text"))
    tokens = (
        F.when(kind == "image", F.ceil(F.coalesce(part["width"], F.lit(0)) / IMAGE_SIDE) * F.ceil(F.coalesce(part["height"], F.lit(0)) / IMAGE_SIDE))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .otherwise(F.coalesce(part["pages"], F.lit(1)).cast("long") * PAGE_TOKENS)
    )
    mark = F.when(kind == "image", F.lit("<|image|>")).when(kind == "audio", F.lit("<|audio|>")).otherwise(F.lit("<|document|>"))
    is_text = kind == "text"
    return F.struct(
        F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark).alias("segment"),
        is_text.alias("is_text"),
        kind.alias("type"),
        part["ref"].alias("ref"),
        F.when(is_text, F.lit(0)).otherwise(tokens).cast("long").alias("tokens"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: n_turns, formatted, segments (text, loss) and attachments.

    ``turns`` has conv_id, turn, role and text or ``parts`` (an array of PART, which then takes
    text's place).  Turns go by ``turn``, equal ones by role and content, nulls first; repeated
    rows stay.  Null texts and roles are empty, a null list of parts has none; rows of a null
    conv_id are one conversation.  Other columns are left out; no rows give none.  A conversation
    is one row of the result, so its text must fit one value.
    """
    if isinstance(turns.schema["parts"].dataType if "parts" in turns.columns else None, ArrayType):
        parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    else:
        parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))
    role = F.coalesce(F.col("role"), F.lit(""))
    visited = turns.select("conv_id", "turn", role.alias("role"), F.transform(parts, visit_part).alias("parts"))
    grouped = visited.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))

    def segments(turn: Column) -> Column:
        under = turn["role"] == "assistant"
        plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        body = F.transform(turn["parts"], lambda p: F.struct(p["segment"].alias("text"), (under & p["is_text"]).alias("loss")))
        return F.concat(F.array(plain(F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n")))), body, F.array(plain(F.lit(END))))

    attached = F.flatten(F.transform("turns", lambda t: F.filter(t["parts"], lambda p: ~p["is_text"])))
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.transform(attached, lambda p, i: F.struct(i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted string; placeholders stay in the text."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(block: Column) -> Column:
        at = F.instr(block, "\n")
        body = F.substring(block, at + 1, F.length(block) - at - len(END))
        return F.struct(unescape_role(F.substring(block, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(blocks, turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """The formatted conversations' digests, read back from the output."""
    # Each value is read once: parsing stays out of the expressions that use it.
    back = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), F.coalesce(F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]), F.lit(0)).alias("attachment_tokens"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "attachment_tokens",
    )
