"""Counting samples along the chain of frame headers.

Candidates are headers that pass their checksum; false ones occur.  The chain
takes, in the order of offsets, those whose number is the expected one: the
next frame, or with variable block sizes the next sample.  A file that begins
in the middle may take its start from the first candidate beyond RELEASE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From this offset into the audio on, a chain that has not begun may begin anywhere.
RELEASE = (8 << 20) - 17 + 1


def _candidate() -> Column:
    return F.struct(F.col("off").cast("bigint").alias("off"), F.col("block_size").cast("bigint").alias("bs"), F.col("hlen").cast("bigint").alias("hlen"), F.col("number").cast("bigint").alias("number"), F.col("variable").alias("variable"))


def chain(frames: DataFrame, keys: list[str], min_frame: Column | None = None, release: int = RELEASE) -> DataFrame:
    """(keys, counted, n_frames): the chain of each file as one ordered fold.

    For files of up to some million candidates; ``chain_in_order`` has no such
    limit.  ``min_frame``, per file, is how far the next frame is at least.
    """
    skip = F.coalesce(F.first(min_frame, ignorenulls=True), F.lit(0)).cast("bigint") if min_frame is not None else F.lit(0).cast("bigint")
    rows = frames.where("off is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(_candidate())).alias("x"), skip.alias("skip"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("running"), zero.alias("n"), zero.alias("next"), F.lit(False).alias("begun"))

    def step(a: Column, f: Column) -> Column:
        here = f["off"] >= a["next"]
        expected = F.when(f["variable"], a["running"]).otherwise(a["n"])
        seed = here & ~a["begun"] & (f["off"] >= release)
        take = here & (seed | (f["number"] == expected))
        # where a chain begins in the middle, its start is not counted: it shifts what is expected
        running = F.when(seed & f["variable"], f["number"]).otherwise(a["running"]) + f["bs"]
        number = F.when(seed & ~f["variable"], f["number"]).otherwise(a["n"]) + 1
        return F.when(take, F.struct(running.alias("running"), number.alias("n"), (f["off"] + F.greatest(f["hlen"], F.col("skip"))).alias("next"), F.lit(True).alias("begun"))).otherwise(a)

    # the counts beside the state: a second fold over the same array would walk it again
    both = F.struct(start.alias("a"), zero.alias("counted"), zero.alias("frames"))

    def with_counts(s: Column, f: Column) -> Column:
        new = step(s["a"], f)
        took = new["next"] != s["a"]["next"]
        return F.struct(new.alias("a"), (s["counted"] + F.when(took, f["bs"]).otherwise(0)).alias("counted"), (s["frames"] + F.when(took, 1).otherwise(0)).alias("frames"))

    rows = rows.withColumn("end", F.aggregate("x", both, with_counts))
    return rows.select(*keys, F.col("end.counted").alias("counted"), F.col("end.frames").alias("n_frames"))


class Chain:
    """The state of one file's chain, carried along batches of candidates."""

    def __init__(self, skip: int = 0, release: int = RELEASE) -> None:
        self.running = self.number = self.next = self.counted = self.frames = 0
        self.begun, self.skip, self.release = False, skip, release

    def take(self, off: int, size: int, hlen: int, number: int, variable: bool) -> bool:
        if off < self.next:
            return False
        if not self.begun and off >= self.release:
            if variable:
                self.running = number
            else:
                self.number = number
        elif number != (self.running if variable else self.number):
            return False
        self.running += size
        self.counted += size
        self.number += 1
        self.frames += 1
        self.begun, self.next = True, off + max(hlen, self.skip)
        return True


def chain_in_order(frames: DataFrame, key: str = "path", min_frame: str | None = None, release: int = RELEASE) -> DataFrame:
    """(key, counted, n_frames) for files of any number of candidates: each
    file's candidates stream through one task in order of offset and only the
    state is held."""
    rows = frames.select(key, "off", "block_size", "hlen", "number", "variable", (F.coalesce(F.col(min_frame), F.lit(0)) if min_frame else F.lit(0)).cast("bigint").alias("skip"))
    rows = rows.where("off is not null").repartition(key).sortWithinPartitions(key, "off")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, off, size, hlen, number, variable, skip in batch.itertuples(index=False):
                if not begun or k != name:
                    if begun:
                        out.append((name, state.counted, state.frames))
                    name, state, begun = k, Chain(int(skip), release), True
                state.take(off, size, hlen, number, variable)
            if out:
                yield pd.DataFrame(out, columns=[key, "counted", "n_frames"])
        if begun:
            yield pd.DataFrame([(name, state.counted, state.frames)], columns=[key, "counted", "n_frames"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"{key} {kind}, counted bigint, n_frames bigint")


def sums(frames: DataFrame, key: str = "path") -> DataFrame:
    return frames.groupBy(key).agg(F.sum(F.col("block_size").cast("bigint")).alias("counted"), F.count("*").alias("n_frames"))


def running_position(frames: DataFrame, key: str = "path") -> DataFrame:
    """The sample at which each frame begins if all before it count."""
    w = Window.partitionBy(key).orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("start_sample", F.coalesce(F.sum(F.col("block_size").cast("bigint")).over(w), F.lit(0)).cast("bigint"))


def gaps(frames: DataFrame, key: str = "path") -> DataFrame:
    """Whether each frame's number follows the one before; the same as the
    chain only where no candidate is false."""
    before = F.lag("number").over(Window.partitionBy(key).orderBy("off"))
    return frames.withColumn("in_sequence", F.when(before.isNull(), F.col("number") == 0).otherwise(F.col("number") == before + 1))
