"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC
records, and a last skippable frame with the seek table of the published
seekable format (compressed and plain size of each frame).  The index maps a
record's identifier to its bundle, its frame and its offset within the frame,
so that one record is read by one seek and the decompression of one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.common import Bloom, bounded, release, shared_path, text_column, written

# Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

#: Plain bytes after which a frame ends, compressed bytes after which a bundle does.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
#: Bundles that a task reads.
BUNDLES = 8
#: A payload on more than one in so many of the repeated pages is hot.
HOT = 1000
INDEX = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_bytes long, record_start long, record_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None, salt: str = "") -> str:
    """The identifier of a page's record; a row without an id is told apart by ``salt``."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'page::{salt}')}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, salt: str = "") -> tuple[str, bytes]:
    """One WARC record: its identifier and bytes.  A revisit has no payload of
    its own, only its digest and length."""
    name = record_id(page_id, salt)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    if page_id is not None:
        head["X-Page-ID"] = page_id
    head["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    head["X-Payload-Length"] = len(payload)
    block = HTTP % len(payload) + (b"" if revisit else payload)
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{record_id(refers_to)}>", "X-Refers-To-Page-ID": refers_to}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return name, b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Builds one bundle in memory; its size is bounded by BUNDLE_BYTES and one record."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[tuple] = []
        self.open: list[bytes] = []
        self.filled = self.bytes = 0

    def add(self, page_id: int | None, name: str, data: bytes) -> None:
        self.entries.append((page_id, name, len(self.frames), self.filled, len(data)))
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = zstandard.ZstdCompressor(level=3).compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.bytes += len(frame)
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table

    def index(self, bundle: str) -> Iterator[tuple]:
        starts = [0]
        for size, _ in self.sizes:
            starts.append(starts[-1] + size)
        for page_id, name, frame, start, size in self.entries:
            yield page_id, name, bundle, frame, starts[frame], self.sizes[frame][0], start, size


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, plain bytes) of each frame, from the footer."""
    frames, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width, start, out = 12 if flags & 0x80 else 8, 0, []
    at = len(data) - 9 - frames * width
    for i in range(frames):
        packed, plain = struct.unpack_from("<II", data, at + i * width)
        out.append((start, packed, plain))
        start += packed
    return out


def parse(data: bytes) -> Iterator[tuple]:
    """The records of a plain frame, as rows of RECORD; a response's digest is checked."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        page_id = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
        found, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        payload, length = None, int(head["X-Payload-Length"])
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if digest(payload) != found or len(payload) != length:
                raise ValueError(f"record {head['WARC-Record-ID']}: the payload does not match its digest")
        refers = head.get("X-Refers-To-Page-ID")
        yield page_id, head.get("WARC-Target-URI"), kind, int(refers) if refers is not None else None, length, found, payload


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_INDEX = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), *((n, pa.int64()) for n in ("frame_start", "frame_bytes", "record_start", "record_bytes"))])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit) of every page.

    Of pages with equal payloads of at least ``min_bytes`` that with the
    smallest id is the response, and the others revisit it.  Rows that repeat
    that smallest id with that payload are all responses, and so are rows of
    a payload that has no id at all; other rows without an id are revisits.
    Digests are counted; a page whose digest occurs once passes by a Bloom
    filter and is not moved.  The others' digests meet their first page: those
    on more than one in HOT of the repeated pages by a broadcast of HOT rows at most,
    the rest by a join, in which no digest has more pages than that.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_column(html).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    count = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(count.where("n > 1"), "digests")
    many = (first.agg(F.sum("n")).first()[0] or 0) / HOT
    repeats = Bloom(first.select(F.xxhash64("sha").alias("h")), "h")
    short = F.octet_length("payload") < min_bytes
    some = rows.where(repeats(F.xxhash64("sha")) & ~short)
    alone = rows.where(~repeats(F.xxhash64("sha")) | short).withColumn("first", F.lit(None).cast("long"))
    hot = F.broadcast(first.where(F.col("n") > many).select("sha", "first"))
    rest = first.where(F.col("n") <= many).select("sha", "first")
    found = alone.select("page_id", "url", "payload", "first")
    found = found.union(some.join(hot, "sha").select("page_id", "url", "payload", "first"))
    found = found.union(some.join(hot, "sha", "left_anti").join(rest.hint("shuffle_merge"), "sha", "left").select("page_id", "url", "payload", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each page to bundles under ``path``; return the index.

    ``path`` is a folder that all executors see, as a URI.  A bundle gets its
    name when it is complete, and a task that is run again writes bundles of
    other names: only those that the index names count.  The index itself is
    written to ``path``/index.  A null url gives a record without a target.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(f"{folder}/bundles", recursive=True)

        def flush(bundle: Bundle) -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.warc.zst", bundle.finish()
            with store.open_output_stream(f"{folder}/bundles/_{name}", compression=None) as f:
                f.write(data)
            store.move(f"{folder}/bundles/_{name}", f"{folder}/bundles/{name}")
            return _rows(list(bundle.index(name)), _INDEX)

        bundle = Bundle()
        for batch in batches:
            for page, where, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle.add(page, *record(page, where, payload, refers_to, revisit, "" if page is not None else uuid.uuid4().hex))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield flush(bundle)
                    bundle = Bundle()
        if bundle.entries:
            yield flush(bundle)

    spark = bounded(pages).sparkSession
    roles(pages, page_id, url, html, min_bytes).mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archive at ``path``, as rows of RECORD, frame by frame.

    The bundles that the index names are dealt to tasks by name, BUNDLES each,
    and read there: no content is moved, and no other file is opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{folder}/bundles/{name}") as f:
                    data = f.read()
                for start, packed, plain in seek_table(data):
                    frame = zstandard.ZstdDecompressor().decompress(data[start : start + packed], plain)
                    rows = list(parse(frame))
                    if rows:
                        yield _rows(rows, _RECORD)
        release()

    named = spark.read.schema(INDEX).parquet(f"{path}/index").select("bundle").distinct()
    tasks = max(spark.sparkContext.defaultParallelism, -(-named.count() // BUNDLES))
    return named.repartition(tasks).mapInArrow(run, RECORD)


def lookup(wanted: DataFrame, path: str) -> DataFrame:
    """The records of the index rows in ``wanted``, each by one seek."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{folder}/bundles/{row['bundle']}") as f:
                    f.seek(row["frame_start"])
                    frame = zstandard.ZstdDecompressor().decompress(f.read(row["frame_bytes"]))
                rows = list(parse(frame[row["record_start"] : row["record_start"] + row["record_bytes"]]))
                yield _rows(rows, _RECORD)

    return wanted.select(*_INDEX.names).mapInArrow(run, RECORD)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to an archive and read it back.

    A null html is an empty payload, a null url no target; other columns are
    not read; an empty table gives an empty archive.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write(pages, path)
    return read(spark, path)


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}',
    CAST(((('0x' || substr(hex, CAST(10 * (i // 8) + 1 AS INT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
