"""Reading FLAC captures: headers alone, or all frame headers.

Both are Python data sources, because ``binaryFile`` reads whole files of at
most 2 GB and captures are far larger.  They read through pyarrow's file
systems, so that a path can be a local one or a URI.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from capturelake.schema import FRAMES, HEADER
from capturelake.shared import shared_path, spread

# Block types and the parts of a frame header.
STREAMINFO, VORBIS_COMMENT = 0, 4
#: Longest frame header, how much of a file a task scans at least, and how much
#: of it is read at once.
LOOK, RANGE, STEP = 17, 64 << 20, 4 << 20
#: Files whose headers a task reads.
FILES = 64
#: Bytes of ranges that one task scans where many files are small, and what opening one counts.
BIN, OPEN = 64 << 20, 256 << 10
#: The setting that lets filters reach the sources.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: How a frame header begins: its sync bits, then codes of the block size, the
#: rate, the channels and the sample size of which none is reserved in every use.
_BEGIN = re.compile(rb"\xff[\xf8\xf9](?=[\x10-\xff][\x00-\xaf])")


def located_file(path: str) -> tuple[Any, str, int]:
    """A file's store, its path there and its size, without opening it; a folder has size 0."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file: {path}")
    return store, inner, info.size or 0


def open_file(path: str) -> tuple[Any, int]:
    """A random-access file and its size."""
    store, inner, size = located_file(path)
    return store.open_input_file(inner), size


def read_header(f: Any) -> tuple[dict[str, Any], int]:
    """The metadata blocks' values and where the audio begins."""
    if f.read_at(4, 0) != b"fLaC":
        raise ValueError("not a FLAC stream (missing fLaC marker)")
    at, out = 4, {"tags": None}
    while True:
        head = f.read_at(4, at)
        if len(head) < 4:
            raise ValueError("not a FLAC stream (metadata ends early)")
        kind, size = head[0] & 0x7F, int.from_bytes(head[1:4], "big")
        if kind in (STREAMINFO, VORBIS_COMMENT):
            body = f.read_at(size, at + 4)
            if kind == STREAMINFO and len(body) >= 34:
                out |= parse_streaminfo(body)
            elif kind == VORBIS_COMMENT and out["tags"] is None:
                out["tags"] = parse_tags(body)
        at += 4 + size
        if head[0] & 0x80:
            break
    if "channels" not in out:
        raise ValueError("not a FLAC stream (no STREAMINFO)")
    return out, at


def parse_streaminfo(b: bytes) -> dict[str, Any]:
    word = int.from_bytes(b[10:18], "big")
    total = word & ((1 << 36) - 1)
    return {
        "min_block": int.from_bytes(b[0:2], "big"),
        "max_block": int.from_bytes(b[2:4], "big"),
        "min_frame": int.from_bytes(b[4:7], "big") or None,
        "max_frame": int.from_bytes(b[7:10], "big") or None,
        "rate": word >> 44,
        "channels": (word >> 41 & 7) + 1,
        "bps": (word >> 36 & 31) + 1,
        "total": total,
    }


def parse_tags(b: bytes) -> list[tuple[str, str]]:
    """The comments in order; what is cut off or has no name is left out."""
    size = lambda at: int.from_bytes(b[at : at + 4], "little")
    at = 4 + size(0)
    n, at, out = size(at), at + 4, []
    for _ in range(n):
        if at + 4 > len(b):
            break
        text = b[at + 4 : at + 4 + size(at)].decode("utf-8", "replace")
        at += 4 + size(at)
        name, eq, value = text.partition("=")
        if eq:
            out.append((name, value))
    return out


def header_row(path: str | None) -> tuple:
    """A row of HEADER; what is wrong with a file is in its error."""
    none = (None,) * 8
    if path is None:
        return (None, False, "null path", None, None, False, *none, None)
    try:
        f, size = open_file(path)
    except Exception as e:  # noqa: BLE001  any store's error is the row's
        return (path, False, f"open failed: {e}", None, None, False, *none, None)
    try:
        h, audio = read_header(f)
    except Exception as e:  # noqa: BLE001
        said = str(e) if isinstance(e, ValueError) and "missing fLaC" in str(e) else f"not a valid FLAC stream: {e}"
        return (path, False, said, None, None, False, None, None, None, None, None, None, size, None, None)
    finally:
        f.close()
    return (path, True, None, h["rate"], h["total"], h["total"] > 0, h["bps"], h["channels"], h["min_block"], h["max_block"], h["min_frame"], h["max_frame"], size, audio, h["tags"] or [])


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c << 1 ^ 7 * (c >> 7)) & 0xFF
        out.append(c)
    return out


_CRC = _crc_table()


def parse_frame(b: bytes, at: int = 0) -> tuple[int, int, int, bool] | None:
    """(block_size, header bytes, number, variable) of a valid frame header."""
    if len(b) < at + 5 or b[at] != 0xFF or b[at + 1] not in (0xF8, 0xF9):
        return None
    sizes, layout = b[at + 2], b[at + 3]
    size_code, rate_code = sizes >> 4, sizes & 15
    if size_code == 0 or rate_code == 15 or layout >> 4 > 10 or (layout >> 1 & 7) in (3, 7) or layout & 1:
        return None
    coded = read_coded(b, at + 4)
    if coded is None:
        return None
    number, used = coded
    p = at + 4 + used
    extra = {6: 1, 7: 2}.get(size_code, 0)
    end = p + extra + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if end >= len(b):
        return None
    if extra:
        block = int.from_bytes(b[p : p + extra], "big") + 1
        if block > 65535:
            return None
    else:
        block = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    crc = 0
    for x in b[at:end]:
        crc = _CRC[crc ^ x]
    return (block, end + 1 - at, number, b[at + 1] == 0xF9) if crc == b[end] else None


def read_coded(b: bytes, at: int) -> tuple[int, int] | None:
    """A number in up to eight bytes, written as UTF-8 writes characters: the
    first byte 0xFF is that of eight."""
    first = b[at]
    if first < 0x80:
        return first, 1
    n = 8 - (first ^ 0xFF).bit_length()
    if n < 2 or at + n > len(b):
        return None
    value = first & (0x7F >> n)
    for x in b[at + 1 : at + n]:
        if x & 0xC0 != 0x80:
            return None
        value = value << 6 | x & 0x3F
    return value, n


def candidates(data: bytes, base: int, limit: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(offset, block_size, header bytes, number, variable) of valid headers
    that begin before ``limit`` bytes of ``data``, which is at offset ``base``."""
    for m in _BEGIN.finditer(data, 0, min(limit + 3, len(data))):
        at = m.start()
        if at < limit and (found := parse_frame(data[at : at + LOOK])):
            yield (base + at, *found)


def scan_range(path: str, start: int, end: int | None, step: int = STEP) -> Iterator[tuple]:
    """(offset from the audio's start, block_size, header bytes, number,
    variable) of the frame headers that begin in a range of a file's bytes,
    of which ``step`` are read at once."""
    f, size = open_file(path)
    end = size if end is None else end
    try:
        audio = read_header(f)[1]
        for at in range(max(start, audio), end, step):
            stop = min(at + step, end)
            data = f.read_at(min(stop - at + LOOK, size - at), at)
            yield from candidates(data, at - audio, stop - at)
    finally:
        f.close()


class _Part(InputPartition):
    """Paths, or the file of a table of them, and a range of their bytes; or
    ``ranges`` (path, start, end) of several files."""

    def __init__(self, paths: list[str], start: int = 0, end: int | None = 0, table: str | None = None, ranges: list[tuple[str, int, int | None]] | None = None) -> None:
        self.paths, self.start, self.end, self.table, self.ranges = paths, start, end, table, ranges

    def all(self) -> list[str]:
        if self.table is None:
            return self.paths
        import pyarrow.parquet as pq

        f, _ = open_file(self.table)
        return [p for p in pq.read_table(f, columns=["path"]).column(0).to_pylist() if p is not None]

    def all_ranges(self) -> list[tuple[str, int, int | None]]:
        if self.table is None:
            return self.ranges or [(p, self.start, self.end) for p in self.paths]
        import pyarrow.parquet as pq

        f, _ = open_file(self.table)
        return [x for row in pq.read_table(f).to_pylist() for x in zip(row["path"], row["start"], row["end"], strict=True)]


def _bins(ranges: Iterable[tuple[str, int, int | None]]) -> Iterator[list[tuple[str, int, int | None]]]:
    """Ranges in runs that are worth a task each."""
    out, cost = [], 0
    for path, start, end in ranges:
        here = OPEN + (end - start if end is not None else 0)
        if out and cost + here > BIN:
            yield out
            out, cost = [], 0
        out.append((path, start, end))
        cost += here
    if out:
        yield out


def located(spark: SparkSession, kind: str, paths: list[str] | DataFrame) -> Any:
    """A reader of a source of this module or of ``companions``: with the driver's own
    list of paths, or a table of any number, of which tasks read parts."""
    reader = spark.read.format(kind).option("pushdown", _pushdown(spark))
    if isinstance(paths, DataFrame):
        folder = shared_path(spark, "paths")
        paths.select("path").where("path is not null").distinct().write.option("maxRecordsPerFile", FILES).parquet(folder)
        return reader.option("table", folder)
    return reader.option("paths", "\n".join(paths))


def listed(options: Any) -> list[_Part]:
    """The parts that a source's options name: FILES paths each."""
    if folder := options.get("table"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        head = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
        return [_Part([], 0, None, head + i.path) for i in store.get_file_info(fs.FileSelector(inner)) if i.path.endswith(".parquet")] or [_Part([])]
    paths = [p for p in options.get("paths", "").split("\n") if p]
    return [_Part(paths[i : i + FILES]) for i in range(0, max(1, len(paths)), FILES)]


class _Paths(DataSourceReader):
    """A reader of files, of frames from offset ``first`` to ``last``."""

    def __init__(self, options: Any) -> None:
        self.parts = listed(options)
        self.first, self.last, self.only = 0, None, None

    def own(self, partition: _Part) -> list[str]:
        return [p for p in partition.all() if self.only is None or p in self.only]


class _Pushed:
    """Keeps to the paths and offsets that a query asks for; Spark filters again.
    A reader may only have this where the session has PUSHDOWN."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("path",) and isinstance(f, EqualTo | EqualNullSafe | In):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.only = wanted if self.only is None else self.only & wanted
            elif name == ("off",):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first, f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.last = f.value if self.last is None else min(self.last, f.value)
        return filters


class _HeaderReader(_Paths):
    def partitions(self) -> list[_Part]:
        return [x for x in self.parts if x.table or self.own(x)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from map(header_row, self.own(partition))


class _PushedHeaderReader(_Pushed, _HeaderReader):
    pass


class FlacHeaders(DataSource):
    """``format("flac_headers")``: one row of HEADER for each of the paths in
    option ``paths``, one a line, or in the column ``path`` of the Parquet table in
    option ``table``; reads metadata blocks only."""

    @classmethod
    def name(cls) -> str:
        return "flac_headers"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: Any) -> DataSourceReader:
        kind = _PushedHeaderReader if self.options.get("pushdown") == "true" else _HeaderReader
        return kind(self.options)


class _FrameReader(_Paths):
    def __init__(self, options: Any) -> None:
        super().__init__(options)
        self.size = int(options.get("range", RANGE))

    def partitions(self) -> list[_Part]:
        if any(x.table for x in self.parts):
            return self.parts
        # sizes alone, all asked for at once: tasks find where the audio begins
        paths = [p for x in self.parts for p in self.own(x)]
        ranges = ((p, a, min(a + self.size, n)) for p, n in _sizes(paths) for a in range(0, n, self.size) if a + self.size > self.first)
        if len(paths) > FILES:
            return [_Part([], ranges=x) for x in _bins(ranges)] or [_Part([])]
        out = [_Part([p], a, b) for p, a, b in ranges]
        if self.last is not None:  # few enough to ask where their audio begins
            ends = {p: _audio(p) for p in paths}
            out = [x for x in out if ends[x.paths[0]] is None or x.start <= ends[x.paths[0]] + self.last]
        return out or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for p, start, end in partition.all_ranges():
            if (self.only is not None and p not in self.only) or (end is not None and end <= self.first):
                continue
            try:
                yield from ((p, *x, None) for x in scan_range(p, max(start, self.first), end, min(self.size, STEP)))
            except Exception as e:  # noqa: BLE001  a file that fails does not fail the others
                yield (p, None, None, None, None, None, str(e))


class _PushedFrameReader(_Pushed, _FrameReader):
    pass


def _audio(path: str) -> int | None:
    """Where a file's audio begins, if that can be told."""
    try:
        f, _ = open_file(path)
        try:
            return read_header(f)[1]
        finally:
            f.close()
    except Exception:  # noqa: BLE001  the task will tell
        return None


def _sizes(paths: list[str]) -> list[tuple[str, int]]:
    """The paths that are files, with their sizes."""
    from pyarrow import fs

    local = [p for p in paths if "://" not in p and not p.startswith("file:")]
    found = dict(zip(local, fs.LocalFileSystem().get_file_info(local), strict=True)) if local else {}
    for p in paths:
        if p not in found:
            store, inner = fs.FileSystem.from_uri(p)
            found[p] = store.get_file_info(inner)
    return [(p, found[p].size) for p in paths if found[p].type == fs.FileType.File]


class FlacFrames(DataSource):
    """``format("flac_frames")``: the valid frame headers of the paths in option
    ``paths`` or of a table of ranges (see ``read_frames``), with offsets from the audio's start; a task reads ``range`` bytes
    and a few more, so that one file is scanned by many, or ranges of many small files.  What cannot be read is
    a row of its own, with an error and without an offset; filters on path and
    off leave out whole ranges."""

    @classmethod
    def name(cls) -> str:
        return "flac_frames"

    def schema(self) -> str:
        return FRAMES + ", error string"

    def reader(self, schema: Any) -> DataSourceReader:
        kind = _PushedFrameReader if self.options.get("pushdown") == "true" else _FrameReader
        return kind(self.options)


def _pushdown(spark: SparkSession) -> str:
    return str(spark.conf.get(PUSHDOWN, "false")).lower()


def read_headers(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    spark.dataSource.register(FlacHeaders)
    return located(spark, "flac_headers", paths).load()


def header_table(paths: DataFrame, path: str = "path") -> DataFrame:
    """The headers of a table of paths, of any number: read where its rows are."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        names = [c.split(" ")[0] for c in HEADER.split(", ")]
        for batch in batches:
            rows = [header_row(p) for p in batch.iloc[:, 0]]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            out["tags"] = [None if t is None else [{"k": k, "v": v} for k, v in t] for t in out["tags"]]
            yield out

    return spread(paths.select(path), path).mapInPandas(run, HEADER)


def frame_table(paths: DataFrame, path: str = "path", size: int = RANGE) -> DataFrame:
    """The frame headers of a table of paths, as rows of FRAMES with ``error``:
    a row of its own, without an offset, for what could not be read.

    Ranges of ``size`` bytes are dealt to tasks, those of OPEN bytes of a file
    together, so that a small file is opened once; nothing is opened on the
    driver, and a file that fails does not fail the others.
    """

    def scan(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        names = ["path", "off", "block_size", "hlen", "number", "variable", "error"]
        out = []  # of many files: most have few frames
        for batch in batches:
            for p, start, end, error in batch.itertuples(index=False):
                if error is None:
                    try:
                        for x in scan_range(p, int(start), int(end), min(size, STEP)):
                            out.append((p, *x, None))
                            if len(out) >= 50_000:
                                yield pd.DataFrame(out, columns=names, dtype=object)
                                out = []
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                if error is not None:
                    out.append((p, None, None, None, None, None, error))
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    return _ranges(paths, path, size).mapInPandas(scan, FRAMES + ", error string")


def _ranges(paths: DataFrame, path: str, size: int) -> DataFrame:
    """(path, start, end, error): runs of ranges of ``size`` bytes of the files of a
    table, dealt to tasks.  A run is one range, or several small ones that cost
    less to read than the file to open; a file that is not there has one, from 0 to 0."""
    run = max(size, OPEN // size * size)

    def sized(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for batch in batches:
            out = []
            for p in batch.iloc[:, 0]:
                try:
                    n = located_file(p)[2]
                    if n > run:  # it fails here once, not in each of its runs
                        open_file(p)[0].close()
                    out.append((p, n, None))
                except Exception as e:  # noqa: BLE001  any store's error is the row's
                    out.append((p, 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "n", "error"], dtype=object)

    own = spread(paths.select(F.col(path).alias("path")).where("path is not null"), "path").distinct()
    files = own.mapInPandas(sized, "path string, n bigint, error string")
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("n", F.lit(1)) - 1, F.lit(run).cast("bigint")))
    starts = files.select("path", start.alias("start"), "n", "error")
    return spread(starts, "path", "start").select("path", "start", F.least(F.col("start") + run, "n").alias("end"), "error")


def read_frames(spark: SparkSession, paths: list[str] | DataFrame, size: int = RANGE) -> DataFrame:
    """The frame headers of files by the source ``flac_frames``, of the driver's
    own list of paths or of a table: its ranges are found by tasks and written
    to the shared folder, a file for each task of the scan."""
    spark.dataSource.register(FlacFrames)
    if not isinstance(paths, DataFrame):
        return located(spark, "flac_frames", paths).option("range", str(size)).load()

    def packed(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        rows = ((p, int(a), None if e is not None else int(b)) for batch in batches for p, a, b, e in batch.itertuples(index=False))
        for x in _bins(rows):
            yield pd.DataFrame([tuple(map(list, zip(*x, strict=True)))], columns=["path", "start", "end"], dtype=object)

    folder = shared_path(spark, "ranges")
    bins = _ranges(paths, "path", size).mapInPandas(packed, "path array<string>, start array<bigint>, end array<bigint>")
    bins.write.option("maxRecordsPerFile", 1).parquet(folder)
    reader = spark.read.format("flac_frames").option("pushdown", _pushdown(spark))
    return reader.option("table", folder).option("range", str(size)).load()


def read_tags(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """(path, total_samples, sample_rate, duration_seconds) of each file's RF
    tags; all null where anything fails."""
    from capturelake.functions.text import parse_f64, parse_u64, tag

    tags = F.coalesce("tags", F.array().cast("array<struct<k:string,v:string>>"))
    return read_headers(spark, paths).select("path", parse_u64(tag(tags, "RF_TOTAL_SAMPLES")).alias("total_samples"), parse_u64(tag(tags, "RF_SAMPLE_RATE")).alias("sample_rate"), parse_f64(tag(tags, "DURATION_SECONDS")).alias("duration_seconds"))


class Memory:
    """Bytes with the reading method of a file: headers that are in a column."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


PARSED = "ok boolean, error string, rate bigint, total bigint, bps int, channels int, min_block int, max_block int, min_frame int, max_frame int, audio_offset bigint, tags array<struct<k:string,v:string>>"


def parse_headers(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key and PARSED) of FLAC headers in a binary column; a null column has an error."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        names = [key, *(c.split(" ")[0] for c in PARSED.split(", "))]
        for batch in batches:
            out = []
            for k, data in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                try:
                    h, audio = read_header(Memory(bytes(data or b"")))
                    tags = [{"k": a, "v": b} for a, b in h["tags"] or []]
                    out.append((k, True, None, h["rate"], h["total"], h["bps"], h["channels"], h["min_block"], h["max_block"], h["min_frame"], h["max_frame"], audio, tags))
                except ValueError as e:
                    out.append((k, False, str(e), *[None] * 10))
            yield pd.DataFrame(out, columns=names, dtype=object)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, content).mapInPandas(run, f"{key} {kind}, {PARSED}")


def scan_frames(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, off, block_size, hlen, number, variable): the valid frame headers
    in a binary column of audio bytes."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for batch in batches:
            out = [(k, *c) for k, data in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) if data is not None for c in candidates(bytes(data), 0, len(data))]
            yield pd.DataFrame(out, columns=[key, "off", "block_size", "hlen", "number", "variable"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, content).mapInPandas(run, f"{key} {kind}, off bigint, block_size int, hlen int, number bigint, variable boolean")
