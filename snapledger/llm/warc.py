"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The writer's tasks put their records into archive files and return one
row per file; only files in that list are ever read, so what a lost or repeated task leaves behind does
no harm. The reader cuts every file into byte ranges. A task looks for the gzip magic in its range,
accepts a candidate if a WARC header and the member's checksum decode, owns the records that start
inside its range, and follows each accepted member to its end, also beyond the range.

Files are opened through the storage layer that the folder's URL names (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import settle
from snapledger.session import new_folder

MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 20
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
LEAST_REVISIT_BYTES = 0
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f0a6f4c-5b0e-4a53-9d4e-3c1f5f8f2a11")
FILES = "path string, size bigint, records bigint"
RECORDS = (
    "path string, offset bigint, record_id string, record_type string, uri string, page_id bigint, refers_to bigint, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


def opened(url: str) -> tuple[fs.FileSystem, str]:
    if "://" not in url and not url.startswith("file:"):
        url = "file://" + url
    return fs.FileSystem.from_uri(url)


def record_id(page_id: int | None) -> str:
    return uuid.uuid5(NAMESPACE, str(page_id)).urn


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def clean(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def encoded(row: dict, date: str) -> bytes:
    """One record as a gzip member. A revisit carries the HTTP header of the full payload, but no payload."""
    payload = (row["html"] or "").encode("utf-8", "replace")
    revisit = row["first"] is not None
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(row['page_id'])}>",
        f"WARC-Target-URI: {clean(row['url'])}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(row['sha1'])}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(row['first'])}>", f"X-Refers-To-Page-Id: {row['first']}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    plain = ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    return packer.compress(plain) + packer.flush()


def with_first(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Add `sha1`, and `first`: the page whose payload a row repeats, else null.

    A digest that a third of all pages share would be one hot join key. Digests with more than a
    thousandth of all pages number at most a thousand and are broadcast; their rows, and rows whose
    payload is unique, do not travel by the digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.sha1(html).alias("sha1"), F.octet_length(html).alias("bytes"),
    )
    digest = F.struct("sha1", "bytes")
    groups = rows.filter(F.col("bytes") >= least_bytes).groupBy(digest.alias("same")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    groups = settle(groups, "warc-digests")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    wide = F.broadcast(groups.filter((F.col("n") * 1000 > total) & (F.col("n") > 1)).select(F.col("same").alias("_wide"), F.col("first").alias("_first")))
    marked = rows.join(wide, digest == F.col("_wide"), "left")
    hot = marked.filter("_wide is not null").drop("_wide")
    cold = marked.filter("_wide is null").drop("_wide", "_first")
    repeated = groups.filter((F.col("n") > 1) & (F.col("n") * 1000 <= total))
    joined = cold.join(repeated.select(F.col("same").alias("_same"), F.col("first").alias("_first")), digest == F.col("_same"), "left").drop("_same")
    both = hot.unionByName(joined)
    later = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return both.withColumn("first", F.when(later, F.col("_first"))).drop("_first", "bytes")


def write_warc(pages: DataFrame, folder: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write one record per row of `pages` (page_id, url, html) into `folder`; return the list of files.

    Of equal payloads of at least `least_bytes` bytes the one with the smallest page_id is a response, the others
    revisit it. Rows that repeat that page_id all stay responses; so do rows without an id if no equal
    payload has one. A null html is an empty payload, a null url an empty address.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        out, path, size, count = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"path": f"{folder}/{path}", "size": size, "records": count}],
                pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]),
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        path, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{path}", compression=None)
                    member = encoded(row, date)
                    out.write(member)
                    size, count = size + len(member), count + 1
                    if size >= FILE_BYTES:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    rows = with_first(pages, least_bytes).select("page_id", "url", "html", "sha1", "first")
    return settle(rows.mapInArrow(written, FILES), "warc-files")


class Source:
    """A file of the store, read in blocks of READ_BYTES of which the last one is kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.number, self.block = file, size, -1, b""

    def piece(self, at: int, most: int) -> memoryview:
        """At most `most` bytes from this offset; fewer at the end of a block."""
        if at // READ_BYTES != self.number:
            self.number = at // READ_BYTES
            self.file.seek(self.number * READ_BYTES)
            self.block = self.file.read(READ_BYTES)
        begin = at - self.number * READ_BYTES
        return memoryview(self.block)[begin : begin + most]

    def blocks(self, at: int) -> Iterator[memoryview]:
        step = 4096
        while at < self.size and len(block := self.piece(at, step)):
            yield block
            at, step = at + len(block), min(step * 4, READ_BYTES)

    def member(self, at: int) -> tuple[bytes, int] | None:
        """Content and end of the WARC member at this offset, or None if there is none."""
        unpack, content, known, seen = zlib.decompressobj(31), bytearray(), False, 0
        for block in self.blocks(at):
            try:
                data = unpack.decompress(block)
            except zlib.error:
                return None
            seen += len(block)
            fresh = max(0, len(content) - 3)  # the header's end may straddle two blocks
            content += data
            if not known:
                if not content[:7] == b"WARC/1."[: len(content[:7])]:
                    return None
                # a header has no longest length: an address may be one line of any size
                known = content.find(b"\r\n\r\n", fresh) >= 0
                if known and header(content) is None:
                    return None
            if unpack.eof:  # checksum and length of the member were right
                return (bytes(content), at + seen - len(unpack.unused_data)) if known else None
        return None

    def candidates(self, start: int, stop: int) -> Iterator[int]:
        """Offsets in [start, stop) where the magic stands; `send` an offset to go on from there."""
        at = start
        while at < stop:
            data = bytes(self.piece(at, 4096))
            if len(data) < 4096:  # the magic may straddle two blocks
                data += bytes(self.piece(at + len(data), len(MAGIC) - 1)) if at + len(data) < self.size else b""
            found = data.find(MAGIC)
            if found < 0:
                at += max(1, len(data) - len(MAGIC) + 1)
            elif at + found >= stop:
                return
            else:
                low = at + found
                jump = yield low
                at = jump if jump is not None else low + 1


def header(data: bytes | bytearray) -> dict[str, str] | None:
    """Fields of a WARC header by lower-case name, or None if it is not one."""
    lines = data.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not lines[0].startswith("WARC/1.") or "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    return fields


def number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def parsed(data: bytes) -> dict | None:
    """The row of a record; None if its block is shorter than its header says."""
    fields = header(data)
    body = data.split(b"\r\n\r\n", 1)[1]
    length = int(fields["content-length"])
    if len(body) < length:
        return None
    block = body[:length]
    http, payload = {}, block
    if fields.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = dict(x.decode("latin-1").lower().split(": ", 1) for x in top.split(b"\r\n")[1:] if b": " in x)
    kind = fields["warc-type"]
    full = number(http.get("content-length")) if kind == "revisit" else len(payload)
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "record_type": kind,
        "uri": fields.get("warc-target-uri"),
        "page_id": number(fields.get("x-page-id")),
        "refers_to": number(fields.get("x-refers-to-page-id")) if kind == "revisit" else None,
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload_bytes": full,
        "payload": payload if kind != "revisit" else None,
    }


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of archive files, given rows (path, size); `payloads` False leaves the payload null.

    Ranges may cut records anywhere: a record belongs to the range in which it starts. Bytes between
    records that are no WARC member are skipped. The rows are typed as in RECORDS.
    """
    pieces = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.col("size") - 1), F.lit(range_bytes).cast("bigint"))).alias("start"))
    kinds = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
        ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                store, inner = opened(piece["path"])
                rows, held = [], 0
                with store.open_input_file(inner) as file:
                    source = Source(file, piece["size"])
                    walk = source.candidates(piece["start"], min(piece["start"] + range_bytes, piece["size"]))
                    at = next(walk, None)
                    while at is not None:
                        member = source.member(at)
                        row = parsed(member[0]) if member else None
                        if row is not None:
                            held += len(row["payload"] or b"") if payloads else 0
                            rows.append(row | {"path": piece["path"], "offset": at} | ({} if payloads else {"payload": None}))
                        if held > READ_BYTES or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                        try:
                            at = walk.send(member[1]) if row is not None else next(walk)
                        except StopIteration:
                            at = None
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    # a number given here keeps the ranges apart: their rows are tiny, but each stands for much reading
    tasks = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / range_bytes)), F.lit(0)).alias("n")).first()["n"]
    return pieces.repartition(max(1, tasks), "path", "start").mapInArrow(read, RECORDS)


def archive_files(spark, folder: str) -> DataFrame:
    """path and size of the archives below a folder, as Spark lists them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path", F.col("length").alias("size"))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, read these back, one row per page from its record."""
    files = write_warc(pages, new_folder(pages.sparkSession, "corpus-warc"))
    return read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
