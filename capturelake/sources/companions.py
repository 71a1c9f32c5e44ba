"""Listing files, and reading the heads of logs and the headers of audio files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from capturelake.functions.text import LOG_BYTES, LOG_DURATION, log_duration, path_dir, path_ext, path_name, path_stem
from capturelake.schema import LOG, WAV
from capturelake.shared import spread
from capturelake.sources.flac import listed, located, open_file

#: Chunks of a WAV file that are walked at most; rows, and characters of logs, that a task gives on at once.
CHUNKS, ROWS, TEXT = 256, 10_000, 4 << 20
#: Bytes of a log that are read at once.
PIECE = 1 << 20
#: A log's duration, and what the end of a piece has of one that may go on: a part of the word, or the word and more.
_TIMED = re.compile(LOG_DURATION.encode())
_OPEN = re.compile(rb"(?i)(duration)[:= \t\n\f\r]*([0-9.]*)\Z|" + b"|".join(b"duration"[:n] + rb"\Z" for n in range(7, 0, -1)))


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, dir, stem, ext, name, file_size) of a folder's files: the scan
    prunes their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    p = F.col("path")
    return files.select(p, path_dir(p).alias("dir"), path_stem(p).alias("stem"), path_ext(p).alias("ext"), path_name(p).alias("name"), F.col("length").alias("file_size"))


def list_folders(folders: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, path, dir, stem, ext, name, file_size) of the files in each of a
    table of folders, of any number, listed where its rows are.  A folder that
    cannot be read has none."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            for name in batch.iloc[:, 0]:
                rows = []
                try:
                    store, inner = fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name or ".")
                    head = name[: len(name) - len(inner)] if name.endswith(inner) else ""
                    rows = [(name, head + i.path, i.size) for i in store.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File]
                except Exception:  # noqa: BLE001, S110  as if it were empty
                    pass
                for i in range(0, len(rows), ROWS):
                    yield pd.DataFrame(rows[i : i + ROWS], columns=["folder", "path", "file_size"], dtype=object)

    own = folders.select(F.col(folder).alias("folder")).where("folder is not null").distinct()
    p = F.col("path")
    return own.mapInPandas(run, "folder string, path string, file_size bigint").select("folder", p, path_dir(p).alias("dir"), path_stem(p).alias("stem"), path_ext(p).alias("ext"), path_name(p).alias("name"), "file_size")


def wav_duration(f: Any) -> float | None:
    """Seconds of a RIFF file by its headers: null if it is another kind, not
    finished, or its data come before their format."""
    head, at = f.read_at(12, 0), 12
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    form = None
    for _ in range(CHUNKS):
        chunk = f.read_at(8, at)
        if len(chunk) < 8:
            return None
        name, size = chunk[:4], int.from_bytes(chunk[4:8], "little")
        if name == b"fmt ":
            if size < 16:
                return None
            b = f.read_at(16, at + 8)
            if len(b) < 16:
                return None
            form = int.from_bytes(b[2:4], "little"), int.from_bytes(b[4:8], "little"), int.from_bytes(b[14:16], "little")
        elif name == b"data":
            if form is None or size in (0, 0xFFFFFFFF):
                return None
            channels, rate, bits = form
            width = channels * (bits / 8.0)
            return size / width / rate if width > 0 and rate > 0 else None
        at += 8 + size + size % 2
    return None


def _wav_row(path: str) -> tuple:
    try:
        f, _ = open_file(path)
        try:
            return path, wav_duration(f)
        finally:
            f.close()
    except Exception:  # noqa: BLE001  an unreadable companion tells nothing
        return path, None


def _log_row(path: str) -> tuple:
    try:
        f, size = open_file(path)
        try:
            return path, f.read_at(min(size, LOG_BYTES), 0).decode("utf-8", "replace")
        finally:
            f.close()
    except Exception:  # noqa: BLE001
        return path, None


def whole_log_duration(f: Any, size: int) -> float | None:
    """What :func:`log_duration` gives for all of a log, of any size, which is read
    in pieces; only a number is held whole."""
    held = b""
    for at in range(0, size, PIECE):
        data, last, end = held + f.read_at(min(PIECE, size - at), at), at + PIECE >= size, 0
        for found in _TIMED.finditer(data):
            if found.end() == len(data) and not last:  # the number may go on
                break
            end = found.end()
            try:
                return float(found[1])
            except ValueError:
                pass
        left = _OPEN.search(data, end)
        held = b"" if left is None else left[1] + left[2] if left[1] else left[0]
    return None


def _log_seconds(path: str) -> float | None:
    try:
        f, size = open_file(path)
        try:
            return whole_log_duration(f, size)
        finally:
            f.close()
    except Exception:  # noqa: BLE001
        return None


class _Reader(DataSourceReader):
    def __init__(self, options: Any, kind: str) -> None:
        self.parts, self.kind = listed(options), kind

    def partitions(self) -> list[InputPartition]:
        return self.parts

    def read(self, partition: Any) -> Iterator[tuple]:
        yield from map(_wav_row if self.kind == "wav" else _log_row, partition.all())


class WavHeaders(DataSource):
    """``format("wav_headers")``: rows of WAV for the paths in option ``paths`` or a ``table``."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return WAV

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options, "wav")


class LogHeads(DataSource):
    """``format("log_heads")``: the first 64 KiB of each log, as rows of LOG."""

    @classmethod
    def name(cls) -> str:
        return "log_heads"

    def schema(self) -> str:
        return LOG

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options, "log")


def read_wavs(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    spark.dataSource.register(WavHeaders)
    return located(spark, "wav_headers", paths).load()


def read_logs(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    spark.dataSource.register(LogHeads)
    return located(spark, "log_heads", paths).load()


def durations(files: DataFrame, whole: bool = False) -> DataFrame:
    """``files`` (path, ext and more) with ``duration_s`` of logs and WAV files,
    read where the rows are: of logs the first LOG_BYTES, or the ``whole``."""
    kept = files.where(F.lower("ext").isin("log", "wav"))
    kind = F.lower("ext")

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        names, rows, held = ["_path", "_text", "_wav"], [], 0
        for batch in batches:
            for p, k in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                text = _log_row(p)[1] if k == "log" else None
                rows.append((p, text, _wav_row(p)[1] if k == "wav" else None))
                held += len(text or "")
                if held >= TEXT or len(rows) >= ROWS:  # not the heads of a whole batch of logs
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def run_whole(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for batch in batches:
            found = [_log_seconds(p) if k == "log" else _wav_row(p)[1] for p, k in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True)]
            yield pd.DataFrame({"_path": batch.iloc[:, 0], "duration_s": pd.Series(found, dtype=object)})

    read = spread(kept.select("path", kind.alias("_kind")), "path").distinct()
    if whole:
        told = read.mapInPandas(run_whole, "_path string, duration_s double")
    else:
        read = read.mapInPandas(run, "_path string, _text string, _wav double")
        told = read.select("_path", F.coalesce(log_duration(F.col("_text")), "_wav").alias("duration_s"))
    return kept.join(told, kept["path"] == told["_path"]).drop("_path")
