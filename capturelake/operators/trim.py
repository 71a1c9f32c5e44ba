"""Cutting by position: the samples from ``start`` up to ``start + length``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plans whose bounds become one filter each.
EXACT = 64


def trim_rows(samples: DataFrame, start: Column, length: Column, pos: str = "pos") -> DataFrame:
    """One row a sample: a filter, which reaches the scan where the bounds are constants."""
    return samples.where((F.col(pos) >= start) & (F.col(pos) < start + length))


def trim_array(signal: Column, start: Column, length: Column) -> Column:
    """One array a capture; beyond its end is nothing."""
    return F.slice(signal, (start + 1).cast("int"), F.greatest(length, F.lit(0)).cast("int"))


def to_blocks(samples: DataFrame, size: int = 65536, key: str = "capture_id", pos: str = "pos", value: str = "value") -> DataFrame:
    """(key, first_sample, n, samples): the layout for large captures.  Written
    in order of first_sample, its statistics let a cut read its blocks alone."""
    block = F.floor(F.col(pos) / size)
    packed = samples.groupBy(F.col(key), block.alias("_b")).agg(F.min(pos).alias("first_sample"), F.array_sort(F.collect_list(F.struct(pos, value))).alias("_x"))
    return packed.select(key, "first_sample", F.size("_x").cast("bigint").alias("n"), F.transform("_x", lambda x: x[value]).alias("samples"))


def trim_blocks(blocks: DataFrame, plans: DataFrame, key: str = "capture_id", size: int | None = None) -> DataFrame:
    """The parts of blocks within each plan (key, start_samples, length_samples):
    inner blocks whole, edge blocks sliced.

    With the ``size`` of the blocks (those of :func:`to_blocks`) plans and blocks
    meet by the number of the block, and the blocks' scan gets the bounds as
    constants: of each plan, where they are EXACT at most, so that one early and
    one late cut read little, else the least start and the greatest end.
    """
    if size is not None:
        return _numbered(blocks, plans, key, size)
    end = F.col("start_samples") + F.col("length_samples")
    rows = blocks.join(plans.select(key, "start_samples", "length_samples"), key).where((F.col("first_sample") < end) & (F.col("first_sample") + F.col("n") > F.col("start_samples")))
    return _sliced(rows, key)


def _numbered(blocks: DataFrame, plans: DataFrame, key: str, size: int) -> DataFrame:
    own = plans.where("length_samples > 0 and start_samples is not null").select(key, "start_samples", "length_samples")
    first, end = F.col("first_sample"), F.col("start_samples") + F.col("length_samples")
    asked = own.select(key, F.col("start_samples").alias("a"), end.alias("b"))
    few = asked.limit(EXACT + 1).collect()
    if len(few) <= EXACT:
        wanted = F.lit(False)
        for k, a, b in few:
            wanted = wanted | ((F.col(key) == F.lit(k)) & (first > F.lit(a - size)) & (first < F.lit(b)))
    else:
        a, b = asked.agg(F.min("a"), F.max("b")).first()
        wanted = (first > F.lit(a - size)) & (first < F.lit(b))
    number = F.explode(F.sequence(F.floor(F.col("start_samples") / size), F.floor((end - 1) / size)))
    own = own.withColumn("_b", number)
    rows = blocks.where(wanted).withColumn("_b", F.floor(first / size)).join(own, [key, "_b"])
    return _sliced(rows.where((first < end) & (first + F.col("n") > F.col("start_samples"))), key)


def _sliced(rows: DataFrame, key: str) -> DataFrame:
    """Of blocks that meet a plan the samples in it."""
    end = F.col("start_samples") + F.col("length_samples")
    skip = F.greatest(F.col("start_samples") - F.col("first_sample"), F.lit(0))
    keep = F.least(end - F.col("first_sample"), F.col("n")) - skip
    cut = F.slice("samples", (skip + 1).cast("int"), F.greatest(keep, F.lit(0)).cast("int"))
    return rows.select(key, (F.col("first_sample") + skip - F.col("start_samples")).alias("first_sample"), keep.alias("n"), cut.alias("samples"))
