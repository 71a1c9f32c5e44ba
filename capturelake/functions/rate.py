"""The true sample rate: header, file-name hint, embedded tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Audio sample rates in Hz, and the tolerance around each.
AUDIO_RATES = [22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 176400, 192000, 352800, 384000]
TOLERANCE = 0.05


def is_audio_rate(rate: Column) -> Column:
    """Whether a rate is within the tolerance of an audio rate, ends included."""
    h = rate.cast("double")
    return F.exists(F.array(*(F.lit(float(a)) for a in AUDIO_RATES)), lambda a: F.abs(h - a) <= a * F.lit(TOLERANCE))


def real_rate(rate: Column, msps: Column) -> Column:
    """The rate in Hz: an audio rate as it is, else the hint in MSPS if
    positive, else the header's kHz."""
    return F.when(is_audio_rate(rate), rate.cast("double")).when((msps > 0) & ~F.isnan(msps), msps * 1000000.0).otherwise(rate.cast("double") * 1000.0)


def is_rf(rate: Column) -> Column:
    return ~is_audio_rate(rate)


def tag_scale(tag_rate: Column) -> Column:
    """1000 if the tag is in kHz (under a million), else 1."""
    return F.when((tag_rate > 0) & (tag_rate < 1000000), F.lit(1000)).otherwise(F.lit(1)).cast("bigint")


def with_tag_rate(rate: Column, rf: Column, tag_rate: Column) -> tuple[Column, Column, Column]:
    """(rate, is_rf, from the tag): a positive tag overrides any other rate."""
    given = F.coalesce(tag_rate > 0, F.lit(False))
    return F.when(given, tag_rate.cast("double") * tag_scale(tag_rate)).otherwise(rate), given | rf, given


def audio_rate_table(spark: SparkSession) -> DataFrame:
    """The rates as a table with the ends of their bands (12 rows, fixed)."""
    return spark.createDataFrame([(r,) for r in AUDIO_RATES], "rate bigint").selectExpr("rate", f"rate - rate * {TOLERANCE}D AS low", f"rate + rate * {TOLERANCE}D AS high")


def match_audio_rates(captures: DataFrame, rate: str = "header_rate") -> DataFrame:
    """The captures whose rate is in any band: a semi join with the fixed table,
    so that overlapping bands give one row."""
    bands = F.broadcast(audio_rate_table(captures.sparkSession))
    return captures.join(bands, F.abs(captures[rate] - bands["rate"]) <= bands["rate"] * F.lit(TOLERANCE), "left_semi")
