"""WARC archives: a writer, and a sequential reader with checks.

Each record is one gzip member, so archives can be cut and joined between records.  The
reader goes through an archive once, decompressing piece by piece; it frames blocks by
Content-Length, verifies block and payload digests, and never holds more than one record.

Archives are written by the executors straight into the shared folder, under names that
depend only on the rows, first as a temporary file and then renamed, so a task that runs
again leaves the same archive.  They are read back through Spark's binary file source.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept, scratch, shared_dir

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of pages in an archive, about; an archive holds one page at least.
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 1 << 16
#: Repeated payloads that are broadcast at most (about 80 bytes each).
BROADCAST_GROUPS = 200_000


class WarcError(ValueError):
    """An archive that isn't well formed, or a digest that doesn't agree."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n".encode()
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def _field(text: str) -> str:
    """A header value: line breaks would end it, so they are percent-encoded."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in text for c in "\r\n") or "%0" in text or "%25" in text else text


def _unfield(text: str) -> str:
    return text.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def write_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, is_first: bool) -> bytes:
    """A response record, or a revisit record that refers to the first page of this payload."""
    block = http_head(len(payload)) + (payload if is_first else b"")
    headers = [("WARC-Type", "response" if is_first else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _field(url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if not is_first:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first))]
    return member(headers, block)


class Reader:
    """The records of an archive, in order: (headers, block) pairs."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream = stream
        self.left = b""  # compressed bytes read and not yet used

    def _members(self) -> Iterator[Iterator[bytes]]:
        while True:
            if not self.left:
                self.left = self.stream.read(READ_BYTES)
                if not self.left:
                    return
            yield self._one()

    def _one(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.left:
                self.left = self.stream.read(READ_BYTES)
                if not self.left:
                    raise WarcError("the archive ends within a record")
            try:
                out = z.decompress(self.left, READ_BYTES)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            self.left = z.unused_data if z.eof else z.unconsumed_tail
            if out:
                yield out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for pieces in self._members():
            held = bytearray()
            for p in pieces:
                held += p
                if b"\r\n\r\n" in held:
                    break
            at = held.find(b"\r\n\r\n")
            if at < 0:
                raise WarcError("a record without an end of its headers")
            version, *lines = bytes(held[:at]).split(b"\r\n")
            if not version.startswith(b"WARC/1."):
                raise WarcError(f"not a WARC record: {version[:20]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines)}
            try:
                size = int(headers["content-length"])
            except (KeyError, ValueError) as e:
                raise WarcError("a record without a Content-Length") from e
            del held[: at + 4]
            for p in pieces:
                held += p
                if len(held) > size + 4:
                    raise WarcError("a record is longer than its Content-Length says")
            if len(held) != size + 4 or held[size:] != b"\r\n\r\n":
                raise WarcError("a record doesn't end where its Content-Length says")
            block = bytes(held[:size])
            want = headers.get("warc-block-digest")
            if want and want != f"sha1:{digest(block)}":
                raise WarcError(f"the block digest of {headers.get('warc-record-id')} doesn't agree")
            yield headers, block


def parse(headers: dict[str, str], block: bytes) -> dict:
    """The page that a record describes; a response's payload is verified against its digest."""
    at = block.find(b"\r\n\r\n")
    if at < 0:
        raise WarcError("a record without an HTTP head")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.decode("latin-1").partition(":") for x in block[:at].split(b"\r\n")[1:])}
    payload, said = block[at + 4 :], headers["warc-payload-digest"].removeprefix("sha1:")
    size, kind = int(http["content-length"]), headers["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise WarcError(f"the payload of {headers['warc-record-id']} doesn't agree with its digest")
    url = headers.get("warc-target-uri")
    return {
        "page_id": page_of(headers["warc-record-id"]), "url": None if url is None else _unfield(url), "payload_bytes": size, "payload_digest": said, "record_type": kind,
        "refers_to": page_of(headers["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def put(folder: str, name: str, data: bytes) -> str:
    """Write a file under a temporary name in its folder and rename it."""
    files, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
    files.create_dir(base, recursive=True)
    temporary = f"{base}/_{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, f"{base}/{name}")
    return f"{folder}/{name}"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write the rows of a partition, sorted by archive, to one file for each archive number."""
    parts: list[bytes] = []
    now, seen, n = None, set(), 0

    def close() -> pa.RecordBatch:
        put(folder, f"part-{now:08d}.warc.gz", b"".join(parts))
        return pa.RecordBatch.from_pydict({"archive": pa.array([now], pa.int32()), "records": pa.array([n], pa.int64())})

    for batch in batches:
        for row in batch.to_pylist():
            if row["archive"] != now:
                if now is not None:
                    yield close()
                now, n = row["archive"], 0
                parts.clear()
                seen.clear()
            key = (row["digest"], row["page_id"])
            # rows that repeat an id and a payload meet here; one of them is first
            is_first = not row["has_first"] or row["page_id"] == row["first"] and key not in seen
            if row["has_first"] and row["page_id"] == row["first"]:
                seen.add(key)
            parts.append(write_record(row["page_id"], row["url"], row["payload"], row["first"], is_first))
            n += 1
    if now is not None:
        yield close()


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> int:
    """Write a record for every row of pages into .warc.gz files in a folder; the number of records.

    Of records with equal payloads of at least `least` bytes, the one with the smallest
    page_id is the response and the others revisit it; smaller payloads are all responses.
    Null html is an empty payload, a null url has no target header, and a null page_id sorts
    after all others.  Rows that repeat a page_id and a payload are one response and revisits
    of it.  Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    with scratch(pages.sparkSession):
        return _write_all(rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload")), folder, least)


def _write_all(rows: DataFrame, folder: str, least: int) -> int:
    # groups of one need no reference, so there is a row for each payload that repeats
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "size", "first", F.lit(True).alias("has_first"))
    groups = kept(groups, "payloads")
    few = groups.count() <= BROADCAST_GROUPS
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    archives = max(1, min(total["n"], -(-total["b"] // ARCHIVE_BYTES)))
    known = rows.join(F.broadcast(groups) if few else groups, ["digest", "size"], "left").withColumn("has_first", F.coalesce("has_first", F.lit(False)))
    known = known.withColumn("archive", F.pmod(F.xxhash64("page_id"), F.lit(archives)).cast("int"))
    dealt = known.repartition(archives, "archive").sortWithinPartitions("archive", F.col("page_id").asc_nulls_last(), "url")
    cols = dealt.select("archive", "page_id", "url", "payload", "digest", "first", "has_first")
    done = cols.mapInArrow(partial(_write, folder=folder), "archive int, records long").agg(F.sum("records")).first()[0] or 0
    if done != total["n"]:
        raise WarcError(f"{total['n']} rows, but {done} records were written")
    return done


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for headers, block in Reader(io.BytesIO(content.as_buffer())):
                row = parse(headers, block)
                if not payloads:
                    row["payload"] = None
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= 5000 or held > 8 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    i64, s = pa.int64(), pa.string()
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", i64), ("url", s), ("payload_bytes", i64), ("payload_digest", s), ("record_type", s), ("refers_to", i64), ("payload", pa.binary())]))


def read_archives(spark, folder: str, *, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records in a folder.

    payload is null for revisits, and for all records without `payloads`.  An archive that is
    cut off, framed wrongly or whose digests don't agree raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInArrow(partial(_read, payloads=payloads), _READ)


def through_archives(pages: DataFrame, **options) -> DataFrame:
    """Write pages into archives in the shared folder and read them back, without payloads."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if not write_archives(pages, folder, **options):
        return spark.createDataFrame([], _READ)
    return read_archives(spark, folder, payloads=False)
