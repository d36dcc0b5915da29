import hashlib
import random
import re

from quillstream.llm import chat

PART = "type string, text string, ref string, width int, height int, seconds double, pages int"


def brute(turns):
    """conv_id -> (n_turns, turns digest, loss chars, loss digest)."""
    chats = {}
    for conv, turn, role, text in turns:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in chats.items():
        own.sort()
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_turns_are_read_back(spark):
    rng = random.Random(1)
    odd = ["", "\n", "\\", "\\\\n", "%", "%0A", "%250A", "<|im_end|>", "<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|", "a\x00b", "us\x00er", "é漢\U0001f600", "<|image|>", "$1", "<<||>>"]
    roles = ["user", "assistant", "system", "assistant\n", "us\x00er", "a\\b", "50%", "%25\n", None]
    turns = [(k % 40, rng.choice([None, *range(5)]), rng.choice(roles), rng.choice([None, *odd, "".join(rng.choice(odd) for _ in range(4))])) for k in range(600)]
    turns += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (7, 2, "user", "twice"), (7, 2, "user", "twice"), (99, 0, "assistant", "x" * 200_000 + "<|im_end|>\n" * 2000)]
    frame = spark.createDataFrame([(*t, 1, "s") for t in turns], "conv_id long, turn long, role string, text string, n_turns int, segments string")
    chats = chat.format_chats(frame.repartition(5))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chats).collect()}
    assert got == brute(turns)
    for r in chats.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        # marks of the template only: as many as turns
        assert len(re.findall(r"<\|im_start\|>", r.formatted)) == len(re.findall(r"<\|im_end\|>\n", r.formatted)) == r.n_turns
    assert chat.digests(chat.format_chats(frame.limit(0))).count() == 0


def test_parts_of_all_kinds(spark):
    image, audio, document = ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 1.01, None), ("document", None, "d.pdf", None, None, None, 3)
    say = lambda t: ("text", t, None, None, None, None, None)
    bare = (None, "plain", None, None, None, None, None)
    turns = [(1, 0, "user", [say("see <|image|>"), image, say(" and "), audio, document]), (1, 1, "assistant", [say("first"), image, bare]), (2, 0, "user", None), (2, 1, "assistant", []), (3, 0, "user", [("film", None, "f", None, None, None, None), ("image", None, None, None, None, None, None)])]
    frame = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>")
    rows = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    assert rows[1].formatted == "<|im_start|>user\nsee <\\|image|><|image|> and <|audio|><|document|><|im_end|>\n<|im_start|>assistant\nfirst<|image|>plain<|im_end|>\n"
    assert [tuple(a) for a in rows[1].attachments] == [(0, "image", "i.png", 3), (1, "audio", "a.wav", 26), (2, "document", "d.pdf", 1536), (3, "image", "i.png", 3)]
    assert [s.text for s in rows[1].segments if s.loss] == ["first", "plain"]
    assert rows[2].formatted == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and rows[2].attachments == []
    assert [tuple(a) for a in rows[3].attachments] == [(0, "film", "f", 512), (1, "image", None, 0)]
    sums = {r.conv_id: r.attachment_tokens for r in chat.digests(chat.format_chats(frame)).collect()}
    assert sums == {1: 1568, 2: 0, 3: 512}
