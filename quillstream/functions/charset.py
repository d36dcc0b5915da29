"""The charset of a page's bytes: byte-order mark, valid UTF-8, what the page declares, else what its letters look like.

Whole Arrow batches at a time: UTF-8 is checked by the classes of neighbouring bytes, and single-byte charsets are
scored by tables over pairs of bytes that follow from what the bytes mean in each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.session import small_batches

#: Letters beyond ASCII by how common they are in texts of the languages that use a charset; and the charsets, preferred ones first.
COMMON = {
    "cp1252": "éäöüßèàçñóíáêúôãâîûëïåæøœ",
    "cp1250": "áéíěščřžýůúňťďąćęłńóśźżőűöüțşăâî",
    "cp1251": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёіїє",
    "koi8-r": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "cp1253": "αοιετσνηυρπκμλςωόίάέήύώγδχθφβξζψ",
    "cp1254": "ıüişçğöâîû",
}
BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: How far into a page its declaration may be.
HEAD = 2048
_DECLARED = re.compile(rb"""(?i)(?:<meta[^>]+charset\s*=\s*["']?|<\?xml[^>]+encoding\s*=\s*["'])\s*([a-z0-9_\-]+)""")
#: Labels of the web that mean a larger charset.
_LARGER = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "iso-8859-9": "cp1254"}


def _table(charset: str) -> np.ndarray:
    """A score for each pair of neighbouring bytes, of which the second isn't ASCII or the first isn't.

    A common letter counts for as much as it is common, another one little; against it are bytes without a meaning,
    capitals after small letters, letters of two scripts side by side, accented letters in a row, and signs inside words.
    """
    chars = [bytes([b]).decode(charset, "replace") for b in range(256)]
    kind, script, weight = [], [], []
    for b, c in enumerate(chars):
        name = unicodedata.name(c, "")
        letter = c.isalpha()
        kind.append("x" if c == "�" or (b > 127 and unicodedata.category(c) == "Cc") else "u" if letter and c.isupper() else "l" if letter else "d" if c.isdigit() else "s" if c.isspace() or c == "\xa0" else "p")
        script.append(name.split(" ")[0] if letter else "")
        # what a byte means in the first charset, too, counts as it does there
        own = COMMON["cp1252"] if c == bytes([b]).decode("cp1252", "replace") else COMMON[charset]
        place = own.find(c.lower()) if b > 127 else -1
        most, least = (4.0, 3.0) if own is COMMON["cp1252"] else (3.0, 2.0)  # the first charset's letters go before others
        weight.append(most - (most - least) * place / len(own) if place >= 0 else 0.0 if b < 128 else 0.3 if letter else 0.2)
    out = np.zeros((256, 256), np.float32)
    for a in range(256):
        for b in range(256):
            if a < 128 and b < 128:
                continue
            s = weight[b] if b > 127 else 0.0
            x, y = kind[a], kind[b]
            if (x == "x" and a > 127) or (y == "x" and b > 127):
                s -= 12
            if x == "l" and y == "u":
                s -= 4
            if script[a] and script[b] and script[a] != script[b]:
                s -= 6
            if script[a] == script[b] == "LATIN" and a > 127 and b > 127:
                s -= 3
            if (x in "ul" and y == "p" and b > 127 and chars[b] not in "’”»…–—") or (x == "p" and a > 127 and y in "ul" and chars[a] not in "‘’“„«–—"):
                s -= 3
            out[a, b] = s
    return out


_TABLES: dict[str, np.ndarray] = {}


def _invalid_utf8(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text, how many bytes break UTF-8: by its lead bytes, each byte says how many are to follow it."""
    n = len(data)
    lead = np.zeros(n, np.int8)
    lead[data >= 0xC2] = 1
    lead[data >= 0xE0] = 2
    lead[data >= 0xF0] = 3
    bad = ((data == 0xC0) | (data == 0xC1) | (data > 0xF4)).astype(np.int64)
    lead[data > 0xF4] = 0
    # a lead byte asks for followers in its own text
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n) - 1
    bad += lead > left
    lead = np.minimum(lead, left)
    wanted = np.zeros(n, np.int8)
    for k in range(1, min(4, n)):
        wanted[k:] |= (lead[:-k] >= k).astype(np.int8)
    bad += (wanted == 1) != ((data & 0xC0) == 0x80)
    second = np.zeros(n, np.uint8)
    second[:-1] = data[1:]
    bad += ((data == 0xE0) & (second < 0xA0)) | ((data == 0xED) & (second > 0x9F)) | ((data == 0xF0) & (second < 0x90)) | ((data == 0xF4) & (second > 0x8F))
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[offsets[1:]] - total[offsets[:-1]]


def detected(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """A charset's name for each text."""
    n = len(offsets) - 1
    broken = _invalid_utf8(data, offsets) if len(data) else np.zeros(n, np.int64)
    raw = memoryview(np.ascontiguousarray(data))
    out: list[str] = []
    for i in range(n):
        head = bytes(raw[offsets[i] : min(offsets[i + 1], offsets[i] + HEAD)])
        mark = next((name for bom, name in BOMS if head.startswith(bom)), None)
        if mark or not broken[i]:
            out.append(mark or "utf-8")
            continue
        said = m[1].decode().lower() if (m := _DECLARED.search(head)) else ""
        own = data[offsets[i] : offsets[i + 1]]
        pairs = own[:-1].astype(np.int32) << 8 | own[1:]
        pairs = pairs[(own[:-1] > 127) | (own[1:] > 127)]
        scores = {}
        for name in COMMON:
            if name not in _TABLES:
                _TABLES[name] = _table(name).ravel()
            scores[name] = float(_TABLES[name][pairs].sum())
        said = _LARGER.get(said, said)
        if said in scores and scores[said] >= max(scores.values()) - 0.25 * abs(max(scores.values())):
            out.append(said)  # what is declared, unless its letters are far from likely
        else:
            out.append(max(scores, key=lambda k: scores[k]))
    return out


#: Bytes of pages that are looked at together; they take some thirty times as many here.
SLICE = 1 << 20


def _slices(batch: pa.RecordBatch, raw: str) -> Iterator[pa.RecordBatch]:
    """The batch in rows of ``SLICE`` bytes and one page at most."""
    past = np.cumsum(pc.binary_length(batch.column(raw)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(past)) + 1).tolist(), len(past)]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def decoded(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """``pages`` with its binary column ``raw`` replaced by ``charset`` and ``html``; null stays null, what no charset has is U+FFFD."""
    rest = [c for c in pages.columns if c != raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, raw)):
            column = batch.column(raw)
            values = column.to_pylist()
            sizes = np.array([len(v) if v is not None else 0 for v in values], dtype=np.int64)
            names = detected(np.frombuffer(b"".join(v for v in values if v), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            texts = [None if v is None else v.decode(name, "replace") for v, name in zip(values, names, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([None if v is None else c for v, c in zip(values, names, strict=True)], pa.string()), pa.array(texts, pa.string())], names=[*rest, "charset", "html"])

    small_batches(pages.sparkSession)
    schema = pages.select(*rest, F.lit("").alias("charset"), F.lit("").alias("html")).schema
    for f in schema.fields[-2:]:
        f.nullable = True
    return pages.select(*rest, raw).mapInArrow(run, schema)
