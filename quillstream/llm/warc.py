"""WARC records in ZIP archives: writing them, and reading single records in place.

An archive is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``, a
concatenation of records that are compressed one by one, and ``indexes/index.cdxj``, a line for
each with its place.  The reader parses the ZIP directories itself (end record, ZIP64 end record
and locator, central directory, ZIP64 extra fields, local headers), finds where a stored
member's bytes begin, and reads the index and single records by range.  Nothing is extracted.

Archives lie in the cluster's shared folder; any store that Arrow's file systems open will do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import membership, storage
from quillstream.llm import text as tx

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: An archive is closed at the first of these many bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 20_000
_END, _END64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int  # offset of its local header


class ZipDirectory:
    """The directory of a ZIP archive in a seekable file (``size``, ``read_at``)."""

    def __init__(self, file):
        self.file = file
        self.members = {m.name: m for m in self._central()}

    def _read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.file.size():
            raise ValueError(f"the archive has no bytes {at} to {at + n}")
        return self.file.read_at(n, at)

    def _central(self) -> Iterator[Member]:
        size = self.file.size()
        tail = self._read(max(0, size - 65_557), min(size, 65_557))
        # The end record is the last one whose comment ends with the file.
        at = tail.rfind(_END)
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        end = size - len(tail) + at
        if end >= 20 and (locator := self._read(end - 20, 20))[:4] == _LOCATOR:
            far = struct.unpack_from("<Q", locator, 8)[0]
            record = self._read(far, 56)
            if record[:4] != _END64:
                raise ValueError("no ZIP64 end of central directory where its locator points")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
        directory, at = self._read(offset, length), 0
        for _ in range(count):
            if directory[at : at + 4] != _CENTRAL:
                raise ValueError("broken central directory")
            method, _, _, packed, full = struct.unpack_from("<H4sIII", directory, at + 10)
            names, extras, comments = struct.unpack_from("<HHH", directory, at + 28)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + names].decode()
            extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
            while k + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, k)
                if tag == 1:  # 64-bit values, of the fields that are full, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                k += 4 + n
            yield Member(name, method, full, packed, header)
            at += 46 + names + extras + comments

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin: after its local header, whose name and extras differ from the directory's."""
        member = self.members[name]
        if member.method != zipfile.ZIP_STORED or member.size != member.packed:
            raise ValueError(f"{name} isn't stored: its records can't be read in place")
        head = self._read(member.header, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"no local header of {name}")
        names, extras = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + names + extras

    def range(self, name: str, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.members[name].size:
            raise ValueError(f"{name} has no bytes {offset} to {offset + length}")
        return self._read(self.start(name) + offset, length)

    def whole(self, name: str) -> bytes:
        return self.range(name, 0, self.members[name].size)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A WARC/1.1 record: a response, or where ``refers_to`` is given a revisit without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    body = head
    if refers_to is None:
        body += payload
    else:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (both by lower-case name) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}, payload


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


class Writer:
    """Archives of one task: a record at a time, to a name of its own, so a repeated task harms nothing."""

    def __init__(self, folder: str):
        self.folder, self.zip = folder, None

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> dict | None:
        """Closes the archive once it is full, and then returns its row of the manifest."""
        if self.zip is None:
            self.uri = f"{self.folder}/{uuid.uuid4().hex}.wacz"
            fs, path = _store(self.uri)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out = fs.open_output_stream(path)
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
            self.data, self.at, self.lines = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, []
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(record(page_id, url, payload, refers_to)) + packer.flush()
        self.data.write(packed)
        self.lines.append(json.dumps({"page": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)
        return self.close() if self.at >= ARCHIVE_BYTES or len(self.lines) >= ARCHIVE_RECORDS else None

    def close(self) -> dict | None:
        if self.zip is None:
            return None
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.out.close()
        self.zip = None
        return {"archive": self.uri, "records": len(self.lines), "bytes": self.at}


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archive all pages below ``folder``; returns the manifest (archive, records, bytes).

    Of pages with equal payloads (the html as UTF-8; null: empty), one with the least page_id becomes the
    response and the others revisits of it; of several rows with that page_id, one with the least url
    (nulls last).  A null page_id is no candidate for the least one, so such a page revisits any numbered
    one and else is a response.  Columns besides page_id, url (may be missing) and html are left out; no
    pages give no archive.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sha = F.sha1(F.encode("html", "UTF-8"))
    keyed = rows.select("page_id", sha.alias("sha"))
    # counted by page first: a payload that a third of all pages have is a row a page_id at most, and written, so that Spark can split it
    each = storage.written(keyed.groupBy("page_id", "sha").agg(F.count("*").alias("n")), "payloads")
    firsts = storage.written(each.groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("n").alias("copies")).where("copies > 1 and first is not null"), "firsts")
    # Only the few ids of copies meet the payloads again; a bitmap of them leaves all other rows where they are.
    copies = each.join(firsts, "sha").where("page_id is null or page_id > first or n > 1").select(F.col("page_id").alias("id"), F.col("sha").alias("copy_sha"), "first")
    copies = storage.written(copies, "copies")
    flags = pages.sparkSession.sparkContext.broadcast(membership.bitmap(copies, "id", "copy_sha"))

    # only the cells go to Python; pages stay
    @F.arrow_udf("boolean")
    def may_copy(cells: pa.Array) -> pa.Array:
        return pa.array(flags.value.inside(cells.to_numpy()))

    named = rows.withColumn("sha", sha).withColumn("cell", membership.cell("page_id", "sha"))
    alone = named.where(~may_copy("cell")).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    told = named.where(may_copy("cell")).join(copies, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("copy_sha")), "left")
    tied = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    chosen = told.where(~tied).select("page_id", "url", "html", F.col("first").alias("refers_to"))
    # rows of the least page_id several times over: equal ones are counted, and one of them all is the response
    equal = told.where(tied).groupBy("page_id", "sha", "url").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    least = equal.groupBy("page_id", "sha").agg(F.min(F.struct(F.col("url").isNull(), "url")).alias("least"))
    led = equal.join(least, ["page_id", "sha"]).withColumn("leads", F.struct(F.col("url").isNull(), "url") == F.col("least"))
    numbered = led.select("page_id", "url", "html", "leads", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    chosen = alone.unionByName(chosen).unionByName(numbered.select("page_id", "url", "html", F.when(~(F.col("leads") & (F.col("k") == 1)), F.col("page_id")).alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder)
        for batch in batches:
            for part in tx.slices(batch, "html"):
                ids, urls, refers = (part.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
                html = part.column("html").cast(pa.binary()).to_pylist()
                for row in zip(ids, urls, html, refers, strict=True):
                    if (done := writer.add(*row)) is not None:
                        yield pa.RecordBatch.from_pylist([done])
        if (done := writer.close()) is not None:
            yield pa.RecordBatch.from_pylist([done])

    manifest = chosen.mapInArrow(run, "archive string, records long, bytes long")
    return storage.written(manifest, "manifest")


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def _number(urn: str | None) -> int | None:
    inside = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inside) if inside else None


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the manifest's archives, read by range through their indexes.

    A response's digest and size are taken from its payload and held against its headers; a revisit's
    are those of its headers.  ``payloads`` adds the html (null for revisits).  Rows of equal or null
    page_id stay apart; an empty manifest gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                fs, path = _store(uri)
                with fs.open_input_file(path) as file:
                    directory = ZipDirectory(file)
                    base = directory.start(DATA)
                    limit = directory.members[DATA].size
                    rows = []
                    for line in directory.whole(INDEX).decode().splitlines():
                        entry = json.loads(line)
                        if entry["offset"] + entry["length"] > limit:
                            raise ValueError(f"the index of {uri} points beyond its data")
                        fields, http, payload = parse(zlib.decompress(file.read_at(entry["length"], base + entry["offset"]), 31))
                        sha = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        size = int(http["content-length"])
                        if not revisit and (digest(payload) != sha or len(payload) != size):
                            raise ValueError(f"the payload of page {entry['page']} in {uri} isn't the one its headers tell")
                        rows.append({"page_id": _number(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": sha, "record_type": fields["warc-type"], "refers_to": _number(fields.get("warc-refers-to")), "url": fields["warc-target-uri"], "html": payload.decode() if payloads and not revisit else None})
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    spread = manifest.select("archive").repartition(max(8, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
    return out if payloads else out.drop("html")
