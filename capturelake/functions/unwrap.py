"""The true sample count behind a 36-bit field.

Counts up to 2**36 and byte bounds up to 2**60 fit a BIGINT; divisions are
integer divisions in the order of the definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.staged import staged

MOD = 1 << 36
MOST_WRAPS = 4096


def _div(a: Column, b: Column | int) -> Column:
    """Integer division of non-negative numbers; null by zero."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else F.nullif(b.cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", a.cast("bigint"), b)


def bytes_per_sample(channels: Column, bps: Column) -> Column:
    """Whole bytes of all channels: bits are divided by eight without rest."""
    return channels.cast("bigint") * _div(bps, 8)


def payload(file_size: Column, audio_offset: Column) -> Column:
    return F.greatest(file_size - audio_offset, F.lit(0).cast("bigint"))


def bound(declared: Column, min_block: Column, max_frame: Column, channels: Column, bps: Column) -> Column:
    """The most bytes that the declared samples can take: by the frames'
    statistics if there are any, else uncompressed with a margin."""
    stats = (min_block > 0) & F.coalesce(max_frame > 0, F.lit(False))
    by_frames = (_div(declared, F.when(min_block > 0, min_block)) + 1) * max_frame.cast("bigint")
    plain = _div(declared * bytes_per_sample(channels, bps) * 105, 100) + 65536
    return F.when(stats, by_frames).otherwise(plain)


def trusted(declared: Column, audio_bytes: Column, min_block: Column, max_frame: Column, channels: Column, bps: Column) -> Column:
    """Whether the count can be right; zero is unknown, not wrapped."""
    return F.when(audio_bytes == 0, True).when(declared == 0, False).otherwise(audio_bytes <= bound(declared, min_block, max_frame, channels, bps))


def frame_range(audio_bytes: Column, min_block: Column, max_block: Column, min_frame: Column, max_frame: Column) -> tuple[Column, Column]:
    """The fewest and the most samples that the payload can hold by the frames'
    statistics; null without them."""
    stats = (min_block > 0) & (max_block > 0) & F.coalesce(min_frame > 0, F.lit(False)) & F.coalesce(max_frame > 0, F.lit(False))
    return F.when(stats, _div(audio_bytes, max_frame) * min_block.cast("bigint")), F.when(stats, _div(audio_bytes, min_frame) * max_block.cast("bigint"))


def _over(samples: Column, declared: Column) -> Column:
    return F.greatest(samples - declared, F.lit(0).cast("bigint"))


def precise_wraps(declared: Column, lower: Column, upper: Column) -> Column:
    """How often the field wrapped, if only one number of times gives a count
    from ``lower`` to ``upper``: that is, if once (or more, where once is too
    few) is also the most."""
    first = F.greatest(F.lit(1).cast("bigint"), _div(_over(lower, declared) + (MOD - 1), MOD))
    last = _div(_over(upper, declared), MOD)
    return F.when((declared > 0) & (first == last), last)


def fallback_wraps(declared: Column, audio_bytes: Column, channels: Column, bps: Column) -> Column:
    """The least number of wraps with which the samples, uncompressed, hold the
    payload; null above MOST_WRAPS or without whole bytes."""
    width = bytes_per_sample(channels, bps)
    lower = _div(audio_bytes + width - 1, width)
    k = F.greatest(F.lit(1).cast("bigint"), _div(_over(lower, declared) + (MOD - 1), MOD))
    return F.when(k <= MOST_WRAPS, k)


def with_corrected(
    rows: DataFrame, total: str = "total", declared: str = "declared", audio_bytes: str = "audio_bytes", min_block: str = "min_block", max_block: str = "max_block", min_frame: str = "min_frame", max_frame: str = "max_frame", channels: str = "channels", bps: str = "bps"
) -> DataFrame:
    """``rows`` with ``total``, trusted, wraps, estimated and beyond (no number
    of wraps fits) of their declared counts.

    The parts are staged, so that none is computed twice.
    """
    c = F.col
    lower, upper = frame_range(c(audio_bytes), c(min_block), c(max_block), c(min_frame), c(max_frame))
    rows = staged(rows, trusted=trusted(c(declared), c(audio_bytes), c(min_block), c(max_frame), c(channels), c(bps)), _lower=lower, _upper=upper)
    rows = staged(rows, _precise=precise_wraps(c(declared), c("_lower"), c("_upper")), _rough=fallback_wraps(c(declared), c(audio_bytes), c(channels), c(bps))).drop("_lower", "_upper")
    rows = rows.withColumn("wraps", F.when(c("trusted"), 0).otherwise(F.coalesce("_precise", "_rough", F.lit(0))).cast("int"))
    rows = rows.withColumn("estimated", ~c("trusted") & c("_precise").isNull() & c("_rough").isNotNull()).withColumn("beyond", ~c("trusted") & c("_precise").isNull() & c("_rough").isNull())
    return rows.withColumn(total, c(declared) + c("wraps") * F.lit(MOD)).drop("_precise", "_rough")
