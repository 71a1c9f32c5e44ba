"""From a sample to the bytes that hold it, and cuts read that way.

The index has a row for each cell of GRID samples of a capture: sorted arrays
of first samples, byte offsets and numbers of some of the frames in it, the first always
among them.  A cut takes the cells that it crosses, searches each one's arrays
and reads from the last indexed frame before its part to the first one behind
it, so that what is read does not depend on the size of the file, and that
parts of one cut are read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.operators import ranges
from capturelake.shared import materialised, spread
from capturelake.sources import flac
from capturelake.sources.frames import crc16_of, decode_frame, encode_frame, renumbered

#: Samples of a cell, frames between two that are indexed, bytes that are read at
#: once where no indexed frame tells the end, and where one does.
GRID, STRIDE, STEP, WIDE = 1 << 26, 16, 1 << 16, 1 << 20

INDEX = "path string, cell bigint, first array<bigint>, off array<bigint>, number array<bigint>, variable boolean, end bigint, audio bigint, rate bigint, channels int, bps int"


def build(paths: DataFrame, path: str = "path", grid: int = GRID, stride: int = STRIDE, size: int = flac.RANGE) -> DataFrame:
    """The index of a table of captures, written to the shared folder: rows of
    INDEX.  ``end`` is the capture's last sample and one more.  Headers of
    frames are scanned and chained in ranges of ``size`` bytes; a capture that
    cannot be read, or has no frames, has no rows."""
    head = materialised(flac.header_table(paths.select(F.col(path).alias("path")).where("path is not null").distinct()), "headers").where("ok")
    found = flac.frame_table(head.select("path"), size=size).where("error is null")
    skip = head.select("path", F.coalesce("min_frame", F.lit(0)).alias("min_frame"))
    found = materialised(found.join(skip, "path").select("path", "off", "block_size", "hlen", "number", "variable", "min_frame"), "candidates")
    taken = materialised(ranges.chain_frames(found, "path", "min_frame", size=size), "chain")
    # the frames behind a cell's last sample are told to it, so that a read of it knows where to end
    before = F.greatest(F.col("first_sample") - F.col("block_size"), F.lit(0))
    cells = F.sequence(F.floor(before / grid), F.floor((F.col("first_sample") + F.col("block_size") - 1) / grid))
    at = F.col("cell") * grid
    rows = taken.withColumn("cell", F.explode(cells)).where((F.col("nth") % stride == 0) | (F.col("first_sample") <= at) | (F.col("first_sample") >= at + grid))
    entry = F.struct("first_sample", "off", "number")
    rows = rows.groupBy("path", "cell").agg(F.array_sort(F.collect_list(entry)).alias("x"), F.bool_or("variable").alias("variable"))
    ends = taken.groupBy("path").agg(F.max(F.col("first_sample") + F.col("block_size")).alias("end"))
    own = head.select("path", F.col("audio_offset").alias("audio"), F.col("header_sample_rate").alias("rate"), "channels", F.col("bits_per_sample").alias("bps"))
    rows = rows.join(ends, "path").join(own, "path")
    return materialised(rows.select("path", "cell", F.col("x.first_sample").alias("first"), F.col("x.off").alias("off"), F.col("x.number").alias("number"), "variable", "end", "audio", "rate", "channels", "bps"), "index")


def _parts(plans: DataFrame, index: DataFrame, grid: int) -> DataFrame:
    """A row for each cell that a plan crosses: which samples of it are wanted."""
    end = F.col("start_samples") + F.col("length_samples")
    wanted = plans.where("start_samples >= 0 and length_samples > 0").select("in_path", "out_path", "start_samples", "length_samples")
    wanted = wanted.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_samples") / grid), F.floor((end - 1) / grid))))
    own = index.withColumnsRenamed({"path": "_path", "cell": "_cell"})
    rows = wanted.join(own, (F.col("in_path") == F.col("_path")) & (F.col("cell") == F.col("_cell"))).drop("_path", "_cell")
    first, last = F.greatest("start_samples", F.col("cell") * grid), F.least(end, (F.col("cell") + 1) * grid, "end")
    return rows.withColumn("a", first).withColumn("b", last).where("a < b").withColumn("total", F.least(end, "end") - F.col("start_samples"))


class _Counted:
    """A file that counts what is read of it."""

    def __init__(self, path: str) -> None:
        self.file, self.size = flac.open_file(path)
        self.read = 0

    def read_at(self, n: int, at: int) -> bytes:
        data = self.file.read_at(max(0, min(n, self.size - at)), at)
        self.read += len(data)
        return data


def frames_of(f: Any, part: Any, step: int = STEP) -> Iterator[tuple[int, bytes]]:
    """(first sample, bytes) of the frames with samples from ``part.a`` up to
    ``part.b``.  A frame ends before a header that the chain takes, if its
    checksum fits there; the last is cut off where its samples end."""
    i = int(np.searchsorted(part.first, part.a, side="right")) - 1
    j = int(np.searchsorted(part.first, part.b, side="left"))
    sample, number = int(part.first[i]), int(part.number[i])
    base = part.audio + int(part.off[i])
    known = j < len(part.first)
    limit = part.audio + int(part.off[j]) if known else None
    data, at = b"", 0

    def more() -> bool:
        nonlocal data
        here = base + len(data)
        new = f.read_at(step if limit is None else min(WIDE, limit - here), here)
        data += new
        return bool(new)

    while sample < part.b:
        while len(data) - at < flac.LOOK and more():
            pass
        head = flac.parse_frame(data[at : at + flac.LOOK])
        if head is None or head[2] != number or head[3] != part.variable:
            raise ValueError(f"no frame with number {number} where one should begin")
        n, size = head[:2]
        follow = number + (n if part.variable else 1)
        after = at + size
        while True:
            end = next((m.start() for m in flac._BEGIN.finditer(data, after) if (x := flac.parse_frame(data[m.start() : m.start() + flac.LOOK])) and x[2:] == (follow, part.variable)), None)
            if end is None:
                after = max(after, len(data) - flac.LOOK)
                if not more():
                    break
            elif crc16_of(data[at : end - 2]) == int.from_bytes(data[end - 2 : end], "big"):
                break
            else:
                after = end + 1  # a header by chance, inside the frame
        frame = data[at:end]
        if end is None and not known:  # the file's last frame, and what may stand behind it
            frame = frame[: decode_frame(frame, part.bps)[1]]
        if sample + n > part.a:
            yield sample, frame
        sample, number, at = sample + n, follow, len(data) if end is None else end
        if at > 1 << 20:
            base, data, at = base + at, data[at:], 0


def read(plans: DataFrame, index: DataFrame, grid: int = GRID) -> DataFrame:
    """(in_path, out_path, first_sample, channels, bps, rate, total, samples,
    bytes_read, error) of cuts (in_path, out_path, start_samples,
    length_samples): decoded blocks, their first sample counted from the cut's
    own start; in ``samples`` the channels' values stand together, first
    sample first.  A part that cannot be read is a row with an error."""
    names = ["in_path", "out_path", "first_sample", "channels", "bps", "rate", "total", "samples", "bytes_read", "error"]

    def run(part: Any) -> Iterator[tuple]:
        shared = (part.in_path, part.out_path)
        f = None
        try:
            f = _Counted(part.in_path)
            for sample, frame in frames_of(f, part):
                x = decode_frame(frame, part.bps)[0]
                x = x[:, max(0, part.a - sample) : part.b - sample]
                yield (*shared, max(sample, part.a) - part.start_samples, len(x), part.bps, part.rate, part.total, x.T.reshape(-1), f.read, None)
                f.read = 0
        except Exception as e:  # noqa: BLE001  any store's or frame's error is the row's
            yield (*shared, part.a - part.start_samples, part.channels, part.bps, part.rate, part.total, None, f.read if f else 0, str(e))

    schema = "in_path string, out_path string, first_sample bigint, channels int, bps int, rate bigint, total bigint, samples array<bigint>, bytes_read bigint, error string"
    return _mapped(_parts(plans, index, grid), run, names, schema)


def read_flac(plans: DataFrame, index: DataFrame, grid: int = GRID) -> DataFrame:
    """(in_path, out_path, first_sample, n, channels, bps, rate, total, data,
    error): the same cuts as FLAC frames.  Inner frames keep their
    subframes as they are, with a new number in their header; the two at the
    ends are decoded and written anew."""
    names = ["in_path", "out_path", "first_sample", "n", "channels", "bps", "rate", "total", "data", "error"]

    def run(part: Any) -> Iterator[tuple]:
        shared = (part.in_path, part.out_path)
        try:
            for sample, frame in frames_of(_Counted(part.in_path), part):
                n = flac.parse_frame(frame)[0]
                a, b = max(sample, part.a), min(sample + n, part.b)
                at = a - part.start_samples
                if b - a == n:
                    data = renumbered(frame, at)
                else:
                    data = encode_frame(decode_frame(frame, part.bps)[0][:, a - sample : b - sample], part.bps, at)
                yield (*shared, at, b - a, part.channels, part.bps, part.rate, part.total, data, None)
        except Exception as e:  # noqa: BLE001
            yield (*shared, part.a - part.start_samples, 0, part.channels, part.bps, part.rate, part.total, None, str(e))

    schema = "in_path string, out_path string, first_sample bigint, n bigint, channels int, bps int, rate bigint, total bigint, data binary, error string"
    return _mapped(_parts(plans, index, grid), run, names, schema)


def _mapped(parts: DataFrame, run: Any, names: list[str], schema: str, rows: int = 64) -> DataFrame:
    def mapped(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        out = []
        for batch in batches:
            for part in batch.itertuples(index=False):
                for x in run(part):
                    out.append(x)
                    if len(out) >= rows:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    # parts differ in what they cost and not in size
    return spread(parts, "in_path", "cell", "out_path").mapInPandas(mapped, schema)


def pcm(samples: Column, bps: Column) -> Column:
    """Interleaved samples as WAV files have them: whole bytes, little end
    first, unsigned up to 8 bits."""

    def run(x: Any, bps: Any) -> Any:
        import pyarrow as pa

        return pa.array([None if not s.is_valid else pcm_bytes(s.values.to_numpy(zero_copy_only=False), b.as_py()) for s, b in zip(x, bps, strict=True)], pa.binary())

    return F.arrow_udf(lambda x, bps: run(x, bps), "binary")(samples, bps)


def pcm_bytes(x: np.ndarray, bps: int) -> bytes:
    width = (bps + 7) // 8
    x = x << (8 * width - bps)  # a sample stands in the upper bits of its bytes
    if width == 1:
        return (x + 128).astype(np.uint8).tobytes()
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
