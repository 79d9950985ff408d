"""WARC archives: a writer that deduplicates payloads, and a salvage reader.

Writing: each task writes archives of one gzip member for each record into the shared folder, under names of its own
attempt, and returns their paths; only what a task that ended well returned is an archive, so lost executors and repeated
attempts leave nothing that is read. Of records with equal payloads (SHA-1) of at least LEAST_BYTES bytes the one with the
largest page_id is a response and the others are revisits that refer to it.

Reading: members and records are checked (gzip CRC, version line, Content-Length, closing blank lines, block digest).
After a failed check the reader looks for the next member or version line that reads well, goes on there and logs the
bytes between as a quarantined gap, so that one damaged record costs that record alone. A record whose framing is sound and
whose digest alone differs is a gap as it stands: what its payload quotes is never taken for a record. In a damaged member of several records
it looks for version lines in what could be inflated, and logs the inner gaps with the member's place.

Defined results: a null html is an empty payload; a null url is left out; a null page_id gets a record of its own whose
page_id reads as null; rows repeated with the largest page_id are all responses; an empty table writes and reads no
record; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairoscope.llm.common import fresh_path, stored

LEAST_BYTES = 0
#: An archive is closed when it has grown beyond this.
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 16
#: pyarrow's name of the storage that Spark's URI schemes name; other schemes are the same in both.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
ID = "urn:kairoscope:page:"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."

RECORD = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


class DigestError(ValueError):
    """A record whose framing is sound, and whose block isn't what its digest says; end is where it ends."""

    def __init__(self, end: int) -> None:
        super().__init__("block digest differs")
        self.end = end


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record, uncompressed; a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def decided(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses) for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    hashed = rows.withColumn("digest", F.sha1("payload"))
    shared = hashed.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    found = hashed.join(stored(shared, "payloads"), "digest", "left")
    return found.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages as archives into a folder of the shared storage; the rows (path, records, bytes) that were written."""
    target = uri_of(pages.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(target)
        out, path, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": [n], "bytes": [size]})

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    where.create_dir(root, recursive=True)
                    out = where.open_output_stream(f"{root}/{path}", compression=None)
                data = member(encode_record(*(x.as_py() for x in row)))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size > ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(decided(pages, least_bytes).mapInArrow(write, "path string, records long, bytes long"), "archives")


def uri_of(spark: SparkSession, folder: str) -> str:
    """The folder as a full URI for pyarrow; what a path without a scheme means is asked of Spark's own file system, once, here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    scheme, _, rest = found.partition(":")
    return f"{SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else f'//{rest}'}"


def inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member that begins at a position, and where it ends; zlib.error if it is damaged or cut off."""
    unpacker, parts, end = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        if end >= len(data):
            raise zlib.error("truncated member")
        piece = data[end : end + CHUNK]
        parts.append(unpacker.decompress(piece))
        end += len(piece)
    return b"".join(parts), end - len(unpacker.unused_data)


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers and block of the record whose version line begins at a position, and where it ends; ValueError if a check fails."""
    if data[at : at + len(VERSION)] != VERSION:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("headers not closed")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d+", headers.get("content-length", "")):
        raise ValueError("no Content-Length")
    begin, end = stop + 4, stop + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record not closed")
    block = bytes(data[begin:end])
    if (told := headers.get("warc-block-digest", "")).startswith("sha1:") and told[5:] != base32_sha1(block):
        raise DigestError(end + 4)
    return headers, block, end + 4


def read_at(data: bytes, view: memoryview, at: int) -> tuple[list[tuple[dict, bytes]], int]:
    """The records that begin at a position, all checked, and where they end."""
    if view[at : at + 3] != GZIP:
        headers, block, end = parse(data, at)
        return [(headers, block)], end
    inner, end = inflate(view, at)
    found, own = [], 0
    while own < len(inner):
        headers, block, own = parse(inner, own)
        found.append((headers, block))
    if not found:
        raise ValueError("empty member")
    return found, end


def inflated(data: memoryview, at: int) -> tuple[bytes, int | None]:
    """What a damaged gzip member gives before its fault, and where it ends, if that is known."""
    unpacker, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and end < len(data):
            piece, before = data[end : end + CHUNK], unpacker.copy()
            try:
                parts.append(unpacker.decompress(piece))
            except zlib.error:
                for i in range(len(piece)):
                    parts.append(before.decompress(piece[i : i + 1]))
            end += len(piece)
    except zlib.error:
        return b"".join(parts), None
    return b"".join(parts), end - len(unpacker.unused_data) if unpacker.eof else None


def _next_version(data: bytes, at: int) -> int:
    """The next version line after a position that begins a good record, or one whose digest alone differs; the end if there is none."""
    while (at := data.find(VERSION, at + 1)) >= 0:
        try:
            parse(data, at)
            return at
        except DigestError:
            return at
        except ValueError:
            continue
    return len(data)


def inside(view: memoryview, at: int) -> tuple[list[tuple], int | None]:
    """("record", headers, block) and ("gap", reason) of a damaged member, and where it ends, if known.

    None if no record is good, or if one record is all there is: that member's own check counts against it.
    """
    if view[at : at + 3] != GZIP:
        return [], None
    inner, end = inflated(view, at)
    items, own = [], 0
    while own < len(inner):
        try:
            headers, block, own = parse(inner, own)
            items.append(("record", headers, block))
        except ValueError as fault:
            begin, own = own, fault.end if isinstance(fault, DigestError) else _next_version(inner, own)
            items.append(("gap", f"{fault}: bytes {begin} to {own} of the inflated member"))
    return (items, end) if len(items) > 1 and any(kind == "record" for kind, *_ in items) else ([], None)


def following(data: bytes, view: memoryview, at: int, known: list[tuple]) -> int:
    """The next position after this one that reads well, or of a damaged member that holds a good record.

    Stored blocks of a member show its records as they are: known ones are passed over.
    """
    end = at
    while True:
        ahead = [p for mark in (GZIP, VERSION) if (p := data.find(mark, end + 1)) >= 0]
        end = min(ahead, default=len(data))
        if end == len(data):
            return end
        try:
            if not all(x in known for x in read_at(data, view, end)[0]):
                return end
        except (ValueError, zlib.error) as fault:
            if isinstance(fault, DigestError) or inside(view, end)[0]:
                return end


def _framed(view: memoryview, at: int, fault: Exception) -> int | None:
    """Where the record at a position ends, if its digest alone differs; as a member, if that reads well to its end."""
    if not isinstance(fault, DigestError):
        return None
    return inflate(view, at)[1] if view[at : at + 3] == GZIP else fault.end


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", position, end, headers, block) and ("gap", position, end, reason), in order; they cover every byte."""
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            found, end = read_at(data, view, at)
        except (ValueError, zlib.error) as fault:
            items, end = inside(view, at)
            if not items and (whole := _framed(view, at, fault)):
                yield "gap", at, whole, str(fault)
                at = whole
                continue
            cut = end is None
            end = following(data, view, at, [tuple(x) for kind, *x in items if kind == "record"]) if cut else end
            for kind, *rest in items:
                yield kind, at, end, *rest
            if cut:
                yield "gap", at, end, str(fault)
        else:
            for headers, block in found:
                yield "record", at, end, headers, block
        at = end


def row_of(archive: str, item: tuple, keep_payload: bool) -> dict:
    kind, at, end, *rest = item
    row = dict.fromkeys(RECORD.names) | {"archive": archive, "position": at, "length": end - at, "kind": kind}
    if kind == "gap":
        return row | {"reason": rest[0]}
    headers, block = rest
    head, _, payload = block.partition(b"\r\n\r\n")
    row |= {"record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"), "url": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to")}
    if row["record_type"] == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return row | {"payload_bytes": int(told[1]) if told else None, "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    return row | {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "payload": payload if keep_payload else None}


def read_archives(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of archives, compressed or not; files has path and content, as Spark's binaryFile source does."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, {"long": pa.int64(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.string())) for f in RECORD.fields])
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                rows, size = [], 0
                for item in salvage(content.as_py() or b""):
                    rows.append(row_of(path.as_py(), item, keep_payload))
                    size += len(rows[-1]["payload"] or b"")
                    if len(rows) >= 5000 or size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(read, RECORD)


def archives(spark: SparkSession, written: DataFrame, folder: str) -> DataFrame:
    """path and content of the archives that write_archives() returned."""
    there = written.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    if not there.head(1):
        return spark.createDataFrame([], "path string, content binary")
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.join(there, F.element_at(F.split("path", "/"), -1) == there["name"], "left_semi")


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, keep_payload: bool = True) -> DataFrame:
    """Writes the pages and reads the archives back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    return read_archives(archives(spark, write_archives(pages, folder, least_bytes), folder), keep_payload)


def digest(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record."""

    def key(uri: str):
        return F.regexp_extract(uri, rf"{ID}(-?\d+)>", 1).try_cast("long")

    return read.filter("kind = 'record'").select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"))
