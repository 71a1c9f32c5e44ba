"""Queries that cut real audio: captures with samples derived from ``supplier``
are written, indexed, cut and read again.

Captures have one or two channels of 8 or 16 bits, blocks of 64 samples that
are fixed or variable, and subframes of every kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions.text import path_name
from capturelake.operators import ranges
from capturelake.plans import derived
from capturelake.shared import materialised, shared_path, spread
from capturelake.sources import companions, seek, writer
from capturelake.sources import frames as audio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col
#: Small enough that captures of some hundred samples have many cells and ranges.
BLOCK, GRID, STRIDE, RANGE = 64, 256, 2, 512


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _samples(k: int, n: int) -> np.ndarray:
    i = np.arange(n)
    j = i // BLOCK % 4
    rows = []
    for ch in range(1 + k % 2):
        x = np.select([j == 0, j == 1, j == 2], [(k + i // BLOCK + ch) % 100 - 50, (i * i + 7 * k * (ch + 1)) % 200 - 100, (i * (ch + 2) + k) % 256 - 128], (i % 16 * (i % 16) + k + ch) % 128 - 64)
        rows.append(x if k % 4 < 2 else x * 100 + i % 7)
    return np.stack(rows)


def _stream(k: int) -> bytes:
    n, bps = 700 + k % 100 * 7, 8 if k % 4 < 2 else 16
    x, variable, out = _samples(k, n), k % 3 == 0, []
    for j, at in enumerate(range(0, n, BLOCK)):
        part = x[:, at : at + BLOCK]
        layout = (None, audio.LEFT_SIDE, audio.SIDE_RIGHT, audio.MID_SIDE)[j % 4] if k % 2 else None
        kinds = ("lpc",) * len(x) if j % 5 == 3 and part.shape[1] > 2 else ("verbatim",) if j % 5 == 4 else ()
        out.append(audio.encode_frame(part, bps, at if variable else j, variable, layout, kinds, taps=(2, -1), shift=0))
    return audio.stream_header(20000, len(x), bps, n, BLOCK, BLOCK) + b"".join(out)


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(k, path) of the captures, written by tasks."""
    root = shared_path(spark, "captures")

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(root)
        store.create_dir(inner, recursive=True)
        for batch in batches:
            out = []
            for k in map(int, batch.iloc[:, 0]):
                with store.open_output_stream(f"{inner}/cap_{k:08d}.flac") as f:
                    f.write(_stream(k))
                out.append((k, f"{root}/cap_{k:08d}.flac"))
            yield pd.DataFrame(out, columns=["k", "path"])

    rows = spread(derived.table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return materialised(rows.mapInPandas(run, "k bigint, path string"), "captures"), root


def _plans(captures: DataFrame, root: str, ext: str) -> DataFrame:
    name = F.concat(F.lit(f"{root}/cut_"), F.lpad(c("k").cast("string"), 8, "0"), F.lit(ext))
    return captures.select(c("path").alias("in_path"), name.alias("out_path"), (c("k") % 500 + 3).alias("start_samples"), (100 + c("k") % 200).alias("length_samples"))


def _index(paths: DataFrame) -> DataFrame:
    return seek.build(paths, grid=GRID, stride=STRIDE, size=RANGE)


def _values(blocks: DataFrame) -> DataFrame:
    """A row for each sample of each channel."""
    rows = blocks.select("in_path", "out_path", "first_sample", "channels", "bps", "rate", F.posexplode("samples").alias("i", "value"))
    return rows.select("in_path", "out_path", "rate", "bps", (c("first_sample") + F.floor(c("i") / c("channels"))).alias("pos"), (c("i") % c("channels")).cast("int").alias("ch"), "value")


@query
def seek_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of cuts, read through the index."""
    captures, root = _captures(spark, sf_dir)
    rows = _values(seek.read(_plans(captures, root, ".flac"), _index(captures.select("path")), GRID))
    return rows.select(path_name(c("in_path")).alias("name"), "pos", "ch", "value")


@query
def cut_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, rate and depth of the files that cuts have become."""
    captures, root = _captures(spark, sf_dir)
    frames = materialised(seek.read_flac(_plans(captures, root, ".flac"), _index(captures.select("path")), GRID), "frames")
    done = materialised(writer.write_flac(frames).where("ok"), "done")
    everything = done.select(c("path").alias("in_path"), c("path").alias("out_path"), F.lit(0).cast("long").alias("start_samples"), F.lit(1 << 40).alias("length_samples"))
    # a cut's own blocks: its end is told by its index
    index = _index(done.select("path"))
    ends = index.groupBy("path").agg(F.max("end").alias("end"))
    everything = everything.join(ends, c("in_path") == c("path")).select("in_path", "out_path", "start_samples", c("end").alias("length_samples"))
    return _values(seek.read(everything, index, GRID)).select(path_name(c("in_path")).alias("name"), "rate", "bps", "pos", "ch", "value")


@query
def cut_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What WAV files of cuts say of themselves, those of more than 300 bytes in several files."""
    captures, root = _captures(spark, sf_dir)
    blocks = materialised(seek.read(_plans(captures, root, ".wav"), _index(captures.select("path")), GRID), "blocks")
    done = materialised(writer.write_wav(blocks, 300), "done")
    told = companions.durations(done.where("ok").select("path", F.lit("wav").alias("ext")))
    return told.select(path_name(c("path")).alias("name"), "duration_s")


@query
def frame_chain_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain, folded in ranges of 30 bytes of each file."""
    return ranges.chain_in_ranges(derived.frames(spark, sf_dir), size=30).select(c("path").alias("capture_id"), "counted", "n_frames")


@query
def reserved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two batches take in one folder, which has some already."""
    captures, _ = _captures(spark, sf_dir)
    first = writer.reserve(captures.select("path"))
    second = writer.reserve(captures.where("k % 2 = 0").select("path"))
    rows = first.withColumn("batch", F.lit(1)).union(second.withColumn("batch", F.lit(2)))
    return rows.select(path_name(c("path")).alias("name"), "batch", path_name(c("output")).alias("output"))


_SQL = """WITH s AS (SELECT s_suppkey AS k, printf('%08d', s_suppkey) AS name, 700 + s_suppkey % 100 * 7 AS n, s_suppkey % 500 + 3 AS start, 100 + s_suppkey % 200 AS length FROM supplier),
p AS (SELECT k, name, least(length, n - start) AS length, start, unnest(range(start, least(start + length, n))) AS i FROM s WHERE start < n),
v AS (SELECT k, name, i - start AS pos, ch, CASE (i // 64) % 4 WHEN 0 THEN (k + i // 64 + ch) % 100 - 50 WHEN 1 THEN (i * i + 7 * k * (ch + 1)) % 200 - 100 WHEN 2 THEN (i * (ch + 2) + k) % 256 - 128 ELSE ((i % 16) * (i % 16) + k + ch) % 128 - 64 END AS x, i
  FROM p, range(2) r(ch) WHERE ch <= k % 2),
o AS (SELECT k, name, pos::BIGINT AS pos, ch::INT AS ch, CASE WHEN k % 4 < 2 THEN x ELSE x * 100 + i % 7 END::BIGINT AS value FROM v)
"""
ORACLE: dict[str, str] = {
    "seek_cut": _SQL + "SELECT 'cap_' || name || '.flac' AS name, pos, ch, value FROM o",
    "cut_flac": _SQL + "SELECT 'cut_' || name || '.flac' AS name, 20000::BIGINT AS rate, CASE WHEN k % 4 < 2 THEN 8 ELSE 16 END AS bps, pos, ch, value FROM o",
    "cut_wav": _SQL
    + """, w AS (SELECT k, name, least(length, n - start) AS n, 300 // ((1 + k % 2) * CASE WHEN k % 4 < 2 THEN 1 ELSE 2 END) AS most FROM s WHERE start < n),
q AS (SELECT *, unnest(range(0, (n + most - 1) // most)) AS part FROM w)
SELECT 'cut_' || name || CASE WHEN part > 0 THEN '.' || (part + 1) ELSE '' END || '.wav' AS name, least(n - part * most, most)::DOUBLE / 20000 AS duration_s FROM q""",
    "reserved_names": """SELECT printf('cap_%08d.flac', s_suppkey) AS name, batch::INT AS batch, printf('cap_%08d-cut', s_suppkey) || CASE WHEN batch = 2 THEN '-2' ELSE '' END || '.flac' AS output
FROM supplier, range(1, 3) r(batch) WHERE batch = 1 OR s_suppkey % 2 = 0""",
}
