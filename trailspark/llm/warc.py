"""WARC archives of pages: written as whole gzip streams, normalised, and read by offset.

`write_archives` turns pages into WARC/1.1 records, an archive per task or several where a task
holds much, each archive one gzip stream as simple tools write it. Such a file can be read only
from its start. `normalise_archives` inflates each stream once, from front to back, rewrites
every record as a gzip member of its own, and gives a row per record with the offset of its
member: the sidecar index. `read_archives` cuts archives into ranges by that index and inflates
the ranges in parallel, so one archive that holds a third of all records is no longer one task.

The Parquet tables of archives and of the index are written by Spark's committer. A task that is
run again writes files under another name, and only the files of the attempt that succeeded are
in the table; what a lost attempt left is never read. Archives are opened by `pyarrow.fs` at
the address of the shared folder. Streams are handled in blocks: a record of any size passes
through a task in bounded memory except in `read_archives`, which returns its payload as a value.

Payloads are compared by digest: of records with equal payloads of `revisit_from` bytes or more
the one with the smallest page id is the response and the others are revisits of it, which hold
the headers and no payload. The groups of two or more are found from ids and digests alone and
joined to the pages; whether that side is broadcast is left to Spark, which knows the size of
the table it is written to.

Defined cases: a null html is the empty payload; a null url leaves the target out, control
characters in one are percent-encoded; rows with the id of the response are all responses, so a
page that occurs twice is written twice under one record id; a page without an id is a revisit
where a page with one has its payload, else a response; an empty table gives an archive
without records or none; other columns do not enter the archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from trailspark.llm.batches import importable
from trailspark.llm.tables import saved, scratch

# The parts of a record.
VERSION = b"WARC/1.1"
RESPONSE, REVISIT = "response", "revisit"
RECORD_TYPES = (RESPONSE, REVISIT)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
HTTP_TYPE = "application/http;msgtype=response"

ARCHIVES = StructType(
    [StructField("archive", StringType()), StructField("records", LongType()), StructField("bytes", LongType())]
)
INDEX = StructType(
    [
        StructField("archive", StringType()),
        StructField("offset", LongType()),
        StructField("length", LongType()),
        StructField("record_type", StringType()),
        StructField("record_id", StringType()),
        StructField("target_uri", StringType()),
        StructField("payload_digest", StringType()),
    ]
)
RECORDS = StructType(
    [
        StructField("record_id", StringType()),
        StructField("record_type", StringType()),
        StructField("target_uri", StringType()),
        StructField("refers_to", StringType()),
        StructField("payload_digest", StringType()),
        StructField("payload_bytes", LongType()),
        StructField("payload", BinaryType()),
    ]
)

#: Bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Compressed bytes that one range of an archive has at least.
RANGE_BYTES = 16 << 20
#: Archives or ranges beyond this number share tasks.
MOST_TASKS = 50_000
#: Bytes read, inflated or returned at a time.
BLOCK = 1 << 20
_BATCH_BYTES = 8 << 20
_BATCH_ROWS = 2000
_LEVEL = 4


# --- records -----------------------------------------------------------------------------


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(payload: Column) -> Column:
    """The same as a column: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    groups = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", text)


def record_bytes(
    record_id: str, kind: str, target: str | None, refers_to: str | None, digest: str, size: int, payload: bytes, date: str
) -> bytes:
    """One record; the block is an HTTP response, without its body for a revisit."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload if kind == RESPONSE else b""
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target and _header_value(target)),
        ("WARC-Refers-To", refers_to and f"<{refers_to}>"),
        ("WARC-Profile", REVISIT_PROFILE if kind == REVISIT else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", HTTP_TYPE),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in headers if value is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields of a record or of an HTTP block by lower-case name; folded lines are joined."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields


def _plain_id(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _plain_digest(value: str | None) -> str | None:
    return value.partition(":")[2] or value if value else None


# --- streams -----------------------------------------------------------------------------


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _blocks(file, size: int | None = None) -> Iterator[bytes]:
    """Blocks of a file up to its end, or `size` bytes of it."""
    left = size
    while left is None or left > 0:
        block = file.read(BLOCK if left is None else min(BLOCK, left))
        if not block:
            return
        if left is not None:
            left -= len(block)
        yield block


def inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of gzip members standing one after another, in pieces of a block at most."""
    stream = zlib.decompressobj(wbits=31)
    begun = False
    for block in blocks:
        while block:
            begun = True
            piece = stream.decompress(block, BLOCK)
            if piece:
                yield piece
            if stream.eof:
                block, stream, begun = stream.unused_data, zlib.decompressobj(wbits=31), False
            else:
                block = stream.unconsumed_tail
    while begun and not stream.eof:
        piece = stream.decompress(stream.unconsumed_tail, BLOCK)
        if not piece and not stream.eof:
            raise ValueError("the gzip stream ends too early")
        yield piece


class _Reader:
    """Bytes of a stream of pieces, taken by line end or by count."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer, self.at = pieces, b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buffer, self.at = self.buffer[self.at :] + piece, 0
        return True

    def head(self) -> bytes | None:
        """Up to the next empty line, which is taken too; None at the end of the stream."""
        searched = 0
        while True:
            # line ends before a record are padding
            while self.buffer[self.at : self.at + 2] == b"\r\n":
                self.at += 2
            end = self.buffer.find(b"\r\n\r\n", self.at + searched)
            if end >= 0:
                head, self.at = self.buffer[self.at : end], end + 4
                return head
            searched = max(0, len(self.buffer) - self.at - 3)
            if not self.more():
                if self.buffer[self.at :].strip():
                    raise ValueError("a record ends within its headers")
                return None

    def take(self, size: int) -> Iterator[bytes]:
        while size > 0:
            if self.at == len(self.buffer) and not self.more():
                raise ValueError("a record ends before its length")
            piece = self.buffer[self.at : self.at + size]
            self.at += len(piece)
            size -= len(piece)
            yield piece


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """(head, its fields, pieces of the block) of each record; take the block before the next."""
    reader = _Reader(pieces)
    while (head := reader.head()) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {head[:40]!r}")
        fields = parse_headers(head)
        block = reader.take(int(fields["content-length"]))
        yield head, fields, block
        for _ in block:
            pass


def normalise_stream(blocks: Iterator[bytes], write) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Rewrite every record of a gzip stream as one member; (offset, length, fields) of each."""
    offset = 0
    for head, fields, block in records_of(inflated(blocks)):
        member, length = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), 0
        for piece in (head, b"\r\n\r\n"):
            length += _put(write, member.compress(piece))
        for piece in block:
            length += _put(write, member.compress(piece))
        length += _put(write, member.compress(b"\r\n\r\n") + member.flush())
        yield offset, length, fields
        offset += length


def _put(write, data: bytes) -> int:
    if data:
        write(data)
    return len(data)


# --- jobs --------------------------------------------------------------------------------


def _rows(rows: Iterator[tuple], schema: StructType, sizes=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Batches bounded in rows and in bytes."""
    arrow = to_arrow_schema(schema)
    held, total = [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in held], field.type) for k, field in enumerate(arrow)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    for row in rows:
        held.append(row)
        total += sizes(row)
        if len(held) >= _BATCH_ROWS or total >= _BATCH_BYTES:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def judged_pages(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0
) -> DataFrame:
    """`page_id, url, payload, digest, payload_bytes, first`: `first` is the page a revisit refers to."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    )
    size = F.octet_length("payload").cast("bigint")
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "payload_bytes": size})
    large = rows.filter(F.col("payload_bytes") >= revisit_from).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = saved(groups.select("digest", "first"), "equal-payloads")
    joined = rows.join(groups, "digest", "left")
    revisit = (F.col("payload_bytes") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("first", F.when(revisit, F.col("first")))


def write_archives(
    judged: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write the pages of `judged_pages` as archives, one gzip stream each; the table of archives."""
    importable(judged.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)

        def archives() -> Iterator[tuple]:
            out = None
            for batch in batches:
                for page, url, payload, digest, size, first in zip(*(batch.column(k) for k in range(6))):
                    first = first.as_py()
                    record = record_bytes(
                        f"{RECORD_URN}{page.as_py()}", RESPONSE if first is None else REVISIT, url.as_py(),
                        None if first is None else f"{RECORD_URN}{first}", digest.as_py(), size.as_py(),
                        payload.as_py() if first is None else b"", date,
                    )
                    if out is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out, stream = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                        records = raw = written = 0
                    written += _put(out.write, stream.compress(record))
                    records, raw = records + 1, raw + len(record)
                    if raw >= archive_bytes:
                        written += _put(out.write, stream.flush())
                        out.close()
                        out = None
                        yield f"{folder}/{name}", records, written
            if out is not None:
                written += _put(out.write, stream.flush())
                out.close()
                yield f"{folder}/{name}", records, written

        return _rows(archives(), ARCHIVES)

    columns = judged.select("page_id", "url", "payload", "digest", "payload_bytes", "first")
    return saved(columns.mapInArrow(run, ARCHIVES), "archives")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a gzip member per record; the sidecar index, a row per record.

    A gzip stream has one reader: an archive is a task.
    """
    importable(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)

        def index() -> Iterator[tuple]:
            for batch in batches:
                for archive in batch.column(0).to_pylist():
                    source, path = _opened(archive)
                    stem = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".warc")
                    name = f"{stem}-{uuid.uuid4().hex[:12]}.warc.gz"
                    with (
                        source.open_input_stream(path, compression=None) as file,
                        system.open_output_stream(f"{root}/{name}", compression=None) as out,
                    ):
                        for offset, length, fields in normalise_stream(_blocks(file), out.write):
                            yield (
                                f"{folder}/{name}", offset, length, fields.get("warc-type"),
                                _plain_id(fields.get("warc-record-id")), fields.get("warc-target-uri"),
                                _plain_digest(fields.get("warc-payload-digest")),
                            )

        return _rows(index(), INDEX)

    n = min(max(1, archives.count()), MOST_TASKS)
    dealt = archives.select("archive").repartition(n)
    return saved(dealt.mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame, types: tuple[str, ...] = RECORD_TYPES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Response and revisit records with their payloads (null for a revisit).

    The index gives the ranges; every member is inflated once, and a payload whose digest is not
    the one in its record is an error. Without records of other types a range is read on end.
    """
    spark = index.sparkSession
    importable(spark)
    part = (F.col("offset") / F.lit(range_bytes)).cast("bigint")
    end = F.col("offset") + F.col("length")
    ranges = index.groupBy("archive", part.alias("part")).agg(F.min("offset").alias("start"), F.max(end).alias("end"))
    n = min(max(1, ranges.count()), MOST_TASKS)
    ranges = ranges.select("archive", "start", "end").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for archive, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                    system, path = _opened(archive)
                    with system.open_input_file(path) as file:
                        file.seek(start)
                        for _, fields, block in records_of(inflated(_blocks(file, stop - start))):
                            if fields.get("warc-type") in types:
                                yield read_record(fields, b"".join(block))

        return _rows(rows(), RECORDS, lambda row: len(row[-1] or b""))

    return ranges.mapInArrow(run, RECORDS)


def read_record(fields: dict[str, str], block: bytes) -> tuple:
    """The columns of `RECORDS`; the length of the full payload of a revisit is in its HTTP headers."""
    head, _, body = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], _plain_digest(fields.get("warc-payload-digest"))
    if kind == REVISIT:
        size, payload = int(parse_headers(head).get("content-length", 0)), None
    else:
        size, payload = len(body), body
        if digest is not None and base32_digest(body) != digest:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} does not have its digest")
    return (
        _plain_id(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"),
        _plain_id(fields.get("warc-refers-to")), digest, size, payload,
    )


def page_number(urn: Column | str) -> Column:
    """The page id in a record id; null for a record without one."""
    urn = F.col(urn) if isinstance(urn, str) else urn
    return F.regexp_extract(urn, f"^{RECORD_URN}(-?[0-9]+)$", 1).try_cast("bigint")


def round_trip(pages: DataFrame, *, revisit_from: int = 0) -> DataFrame:
    """Pages through archives, normalised archives and back: the columns of `RECORDS`."""
    spark: SparkSession = pages.sparkSession
    folder = scratch(spark, "warc")
    archives = write_archives(judged_pages(pages, revisit_from=revisit_from), f"{folder}/whole")
    return read_archives(normalise_archives(archives, f"{folder}/members"))
