"""Writing audio files from rows: a data source with commit and abort.

Rows that belong to one file come to one task in order and go straight through
it.  A task writes hidden files beside the outputs; only when all tasks are done
do they get their names, and when one fails none does and they are removed
(an executor that is lost at once may leave a hidden file).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from capturelake.shared import materialised, spread
from capturelake.sources.frames import stream_header
from capturelake.sources.seek import pcm

#: Bytes of samples in a WAV file at most (its sizes have 32 bits), and names that are tried.
WAV_BYTES, MOST = 1 << 30, 10_000
#: Files that get their names at once.
MOVES = 16


def _store(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def wav_header(rate: int, channels: int, bps: int, samples: int) -> bytes:
    width = (bps + 7) // 8
    size = samples * channels * width
    form = (1).to_bytes(2, "little") + channels.to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * channels * width).to_bytes(4, "little") + (channels * width).to_bytes(2, "little") + (8 * width).to_bytes(2, "little")
    return b"RIFF" + (36 + size + size % 2).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + form + b"data" + size.to_bytes(4, "little")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _AudioWriter(DataSourceWriter):
    """Of rows (path, first_sample, n, head, data): ``head`` begins a file."""

    def write(self, iterator: Iterator[Any]) -> WriterCommitMessage:
        done, path, out, follow = [], None, None, 0
        try:
            for row in iterator:
                if row["path"] != path:
                    if out is not None:
                        out.close()
                    path, follow = row["path"], 0
                    store, inner = _store(path)
                    folder, name = os.path.split(inner)
                    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                    done.append((temporary, path))
                if row["first_sample"] != follow:
                    raise ValueError(f"{path} has no samples from {follow} to {row['first_sample']}")
                if row["head"] is not None:
                    out.write(row["head"])
                out.write(row["data"])
                follow += row["n"]
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            for temporary, name in done:
                store, _ = _store(name)
                store.delete_file(temporary)
            raise
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        def named(file: tuple[str, str]) -> None:
            store, inner = _store(file[1])
            store.move(file[0], inner)

        with ThreadPoolExecutor(MOVES) as pool:  # a store's answers are waited for together
            for _ in pool.map(named, (x for m in messages if m is not None for x in m.files)):
                pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for temporary, path in (x for m in messages if m is not None for x in m.files):
            _store(path)[0].delete_file(temporary)


class AudioFiles(DataSource):
    """``format("audio_files")``: writes files from rows (path, first_sample, n,
    head, data), dealt by path and sorted by path and first_sample."""

    @classmethod
    def name(cls) -> str:
        return "audio_files"

    def schema(self) -> str:
        return "path string, first_sample bigint, n bigint, head binary, data binary"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return _AudioWriter()


def _save(rows: DataFrame) -> None:
    rows.sparkSession.dataSource.register(AudioFiles)
    rows = spread(rows, "path").sortWithinPartitions("path", "first_sample")
    rows.write.format("audio_files").mode("append").save()


def _whole(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` without those of cuts of which a part could not be read; and
    those cuts with the reason."""
    wrong = rows.where("error is not null").groupBy("out_path").agg(F.min("error").alias("why"))
    return rows.join(wrong, "out_path", "left_anti"), wrong.select("out_path", F.lit(False).alias("ok"), "why")


def write_wav(blocks: DataFrame, most: int = WAV_BYTES) -> DataFrame:
    """Write decoded blocks (see ``seek.read``; materialised, they are read three times) as WAV files with all
    channels, the rate of the stream's header and whole bytes of its depth;
    returns (out_path, path, ok, why), a row a file.

    A cut of more than ``most`` bytes of samples becomes several files, the later ones with
    ``.2``, ``.3`` ... before the extension, so that no task has to write more.
    A cut of which a part cannot be read has no file and is a row with the
    reason.
    """
    good, wrong = _whole(blocks)
    size = F.col("channels") * F.ceil(F.col("bps") / 8)
    most_samples = F.floor(F.lit(most) / size)
    at, n = F.col("first_sample"), F.size("samples") / F.col("channels")
    # a block that crosses into the next file is cut in two
    pieces = good.withColumn("_n", n.cast("bigint")).withColumn("_m", most_samples.cast("bigint"))
    pieces = pieces.withColumn("_part", F.explode(F.sequence(F.floor(at / F.col("_m")), F.floor((at + F.col("_n") - 1) / F.col("_m")))))
    a, b = F.greatest(at, F.col("_part") * F.col("_m")), F.least(at + F.col("_n"), (F.col("_part") + 1) * F.col("_m"))
    own = F.slice("samples", ((a - at) * F.col("channels") + 1).cast("int"), ((b - a) * F.col("channels")).cast("int"))
    name = F.when(F.col("_part") == 0, F.col("out_path")).otherwise(F.concat(F.regexp_replace("out_path", r"(?s)\.[^./]*$", ""), F.lit("."), F.col("_part") + 1, F.regexp_extract("out_path", r"(?s)(\.[^./]*)$", 1)))
    length = F.least(F.col("total") - F.col("_part") * F.col("_m"), F.col("_m"))
    head = F.udf(lambda rate, channels, bps, samples: wav_header(rate, channels, bps, samples), "binary")
    rows = pieces.select("out_path", name.alias("path"), (a - F.col("_part") * F.col("_m")).alias("first_sample"), (b - a).alias("n"), "rate", "channels", "bps", length.alias("length"), own.alias("samples"))
    files = rows.select("out_path", "path").distinct()
    data = rows.select("path", "first_sample", "n", F.when(F.col("first_sample") == 0, head(F.col("rate").cast("int"), "channels", "bps", "length")).alias("head"), pcm(F.col("samples"), F.col("bps")).alias("data"))
    _save(data)
    return files.select("out_path", "path", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("why")).unionByName(wrong.withColumn("path", F.lit(None).cast("string")))


def write_flac(frames: DataFrame) -> DataFrame:
    """Write frames (see ``seek.read_flac``; materialised) as FLAC files with
    the stream's rate, channels and depth; returns (out_path, path, ok, why).
    One cut is one file, and goes as a stream through one task."""
    good, wrong = _whole(frames)
    sizes = good.groupBy("out_path").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    head = F.udf(lambda rate, channels, bps, total, least, most: stream_header(rate, channels, bps, total, max(16, least), max(16, most)), "binary")
    rows = good.join(sizes, "out_path")
    data = rows.select(F.col("out_path").alias("path"), "first_sample", "n", F.when(F.col("first_sample") == 0, head("rate", "channels", "bps", "total", "least", "most")).alias("head"), "data")
    _save(data)
    return good.select("out_path").distinct().select("out_path", F.col("out_path").alias("path"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("why")).unionByName(wrong.withColumn("path", F.lit(None).cast("string")))


def claim(path: str) -> bool:
    """Take a name that no one has: whether it was free.

    On a local or mounted folder by exclusive creation.  Elsewhere by a mark
    beside the name: of those who leave one at the same time nobody has it,
    and each takes back its own and tries the next name.
    """
    from pyarrow import fs

    store, inner = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        try:
            os.close(os.open(inner, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    if store.get_file_info(inner).type != fs.FileType.NotFound:
        return False
    mark = f"{inner}.claim-{uuid.uuid4().hex}"
    store.open_output_stream(mark).close()
    folder = fs.FileSelector(os.path.dirname(inner))
    marks = [i.path for i in store.get_file_info(folder) if i.path.startswith(f"{inner}.claim-")]
    free = len(marks) == 1 and store.get_file_info(inner).type == fs.FileType.NotFound
    if free:
        store.open_output_stream(inner).close()
    store.delete_file(mark)
    return free


def reserve(inputs: DataFrame, path: str = "path", most: int = MOST) -> DataFrame:
    """(path, output) of every row: a name ``-cut``, ``-cut-2`` ... that now exists as an empty
    file and is no one else's, whoever asks at the same time; null where
    ``most`` are taken or the folder cannot be written.  Every evaluation takes
    new names, so it is written once to the shared folder."""
    from capturelake.functions.text import output_name, path_dir, path_ext, path_stem

    p = F.col(path)
    parts = inputs.select(p, path_dir(p).alias("_d"), path_stem(p).alias("_s"), path_ext(p).alias("_e"))
    parts = parts.select(p.alias("path"), output_name(F.col("_d"), F.col("_s"), F.col("_e")).alias("first"))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for batch in batches:
            out = []
            for name, first in batch.itertuples(index=False):
                made = None
                if first is not None:
                    stem, ext = os.path.splitext(first)
                    try:
                        made = next((x for n in range(1, most) if claim(x := first if n == 1 else f"{stem}-{n}{ext}")), None)
                    except OSError:
                        pass
                out.append((name, made))
            yield pd.DataFrame(out, columns=["path", "output"], dtype=object)

    return materialised(spread(parts, "path").mapInPandas(run, "path string, output string"), "reserved")
