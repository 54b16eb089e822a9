"""WARC archives: a writer that deduplicates payloads into revisits, and a splittable reader.

The writer makes each record a gzip member of its own and lets Spark's text sink lay them down: a value is a member's
bytes, and the "line separator" is an empty gzip member (20 fixed bytes, which decode to nothing). So files are plain
concatenations of gzip members, and Spark's commit protocol covers lost executors and repeated tasks.

The reader needs no index. The file listing is cut into byte ranges; a task scans its range for gzip magic, takes a
candidate as a record if its first bytes decode to a WARC header, and owns the records that start inside its range,
reading past the range's end for the last one.

A response's block is an HTTP head and the payload; a revisit's block is the HTTP head alone, whose Content-Length still
tells the payload's size. Which records are revisits is found from (page_id, digest) alone; a digest that very many pages
share is dealt over many tasks.

Defined cases: a null payload is empty; a null url gives no target; white space and control characters of a url are
percent-encoded, all else is kept; a null page_id is written as "null" and read as null; rows that repeat the smallest
page_id of a payload are all responses. A payload is held whole in one task. Extra columns are ignored. An empty table
gives archives without responses, and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_of, join_spread, materialize, new_folder

MAGIC = b"\x1f\x8b\x08"
#: Fixed bytes: a gzip member that decodes to nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
SPLIT = 8 << 20
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")
ID = "urn:cachefold:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return _member(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html, ...); payloads under ``least_bytes`` never revisit."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.when(F.length("payload") >= least_bytes, F.sha1("payload")))
    told = rows.select("page_id", "sha").where("sha is not null").distinct()
    told = materialize(told, "digests")
    first = materialize(told.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "first")
    later = join_spread(told, first.select("sha", "first"), "sha", hot_of(first.select("sha", "n"), "sha"), ["page_id"])
    later = later.where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first")
    rows = rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _record("warcinfo", [("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        yield pa.RecordBatch.from_arrays([pa.array([info], pa.binary())], ["value"])
        for batch in batches:
            out = []
            for page, url, payload, original in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                revisit = original is not None
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                headers = [("WARC-Record-ID", f"<{ID}{'null' if page is None else page}>"), ("WARC-Date", DATE)]
                if url is not None:
                    headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: quote(m[0]), url)))
                headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
                if revisit:
                    headers += [("WARC-Refers-To", f"<{ID}{original}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                out.append(_record("revisit" if revisit else "response", headers, http if revisit else http + payload))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = rows.select("page_id", "url", "payload", "first").mapInArrow(run, "value binary")
    lines = members.select(F.col("value").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(folder)


class RangeReader:
    """Bytes of a file from any offset, a step at a time."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        path = re.sub(r"^file:/(?!/)", "file:///", path)
        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        self.at, self.held = 0, b""

    def close(self) -> None:
        self.file.close()

    def bytes_from(self, at: int, least: int) -> bytes:
        """At least ``least`` bytes from ``at``, fewer only at the end of the file."""
        if at < self.at or at + least > self.at + len(self.held):
            self.held, self.at = self.file.read_at(max(least, STEP), at), at
        return self.held[at - self.at :]


def _header_of(reader: RangeReader, at: int) -> bool:
    """Whether a gzip member at ``at`` begins a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(reader.bytes_from(at, 512)[:512], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member_at(reader: RangeReader, at: int) -> tuple[bytes, int]:
    """The decoded member and the offset behind it."""
    unpack, parts = zlib.decompressobj(31), []
    while not unpack.eof:
        data = reader.bytes_from(at, 1)
        if not data:
            raise ValueError("a record is cut off")
        parts.append(unpack.decompress(data))
        at += len(data) - len(unpack.unused_data)
    return b"".join(parts), at


def records_in(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records that start in [start, end)."""
    reader = RangeReader(path)
    try:
        while start < end:
            data = reader.bytes_from(start, len(MAGIC))
            found = data.find(MAGIC)
            if found < 0:
                if len(data) < len(MAGIC):
                    return
                start += len(data) - len(MAGIC) + 1
                continue
            start += found
            if start >= end:
                return
            if not _header_of(reader, start):
                start += 1
                continue
            record, start = _member_at(reader, start)
            head, _, rest = record.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
            yield headers, rest[: int(headers.get("Content-Length", 0))]
    finally:
        reader.close()


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url[, payload]) of all responses and revisits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, min(ranges.count(), 20_000))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]

    def page(value: str | None) -> int | None:
        number = (value or "").strip("<>").removeprefix(ID)
        return int(number) if re.fullmatch(r"-?\d+", number) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names)

        for batch in batches:
            for path, length, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held = 0
                for headers, block in records_in(path, start, min(start + split_bytes, length)):
                    if (kind := headers.get("WARC-Type")) not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
                    told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or digest(payload) != told):
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not match its digest")
                    rows.append((page(headers["WARC-Record-ID"]), size, told, kind, page(headers.get("WARC-Refers-To")), headers.get("WARC-Target-URI"), payload)[: len(names)])
                    held += len(payload) * with_payload + 200
                    if held > 8 << 20:
                        yield made()
                        rows.clear()
                        held = 0
            yield made()
            rows.clear()

    return ranges.repartition(tasks, "path", "start").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = new_folder(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
