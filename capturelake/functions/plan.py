"""Wall-clock requests as sample ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is wrong with a request, in the order of the checks.
BAD_RATE = "sample rate is zero or invalid"
BAD_LENGTH = "length must be > 0"
BAD_START = "start must be >= 0"
PAST_END = "start is at or past the end of the file"
_LIMIT = 9.2e18


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def samples(seconds: Column, rate: Column) -> Column:
    """Seconds as samples, rounded half away from zero; null if negative or not finite."""
    x = F.round(seconds * rate)
    return F.when(_finite(x) & (x >= 0), F.least(x, F.lit(_LIMIT)).cast("bigint"))


def with_plan(rows: DataFrame, start: str, length: str, rate: str, total: str, known: str) -> DataFrame:
    """``rows`` with error, start_samples, length_samples, end_sample and
    real_total_seconds.

    A length beyond the end is clamped, one below a sample is one sample.  An
    unknown total neither clamps nor is past its end; a total is told in
    seconds whenever it is known and the request's numbers are valid.
    """
    c, most = F.col, F.lit((1 << 63) - 1)
    numbers = F.when(~(_finite(c(rate)) & (c(rate) > 0)), BAD_RATE).when(~_finite(c(length)) | (c(length) <= 0), BAD_LENGTH).when(~_finite(c(start)) | (c(start) < 0), BAD_START)
    rows = rows.withColumn("_numbers", numbers).withColumn("_first", F.when(c("_numbers").isNull(), samples(c(start), c(rate)))).withColumn("_own", F.when(c("_numbers").isNull(), samples(c(length), c(rate))))
    rows = rows.withColumn("error", F.coalesce(c("_numbers"), F.when(c(known) & (c("_first") >= c(total)), PAST_END)))
    # the room is compared before anything is added, so that no sum overflows
    room = F.when(c(known) & (c("_own") > c(total) - c("_first")), c(total) - c("_first")).otherwise(c("_own"))
    rows = rows.withColumn("length_samples", F.when(c("error").isNull(), F.greatest(room, F.lit(1).cast("bigint"))))
    rows = rows.withColumn("start_samples", F.when(c("error").isNull(), c("_first")))
    rows = rows.withColumn("end_sample", c("start_samples") + F.least(c("length_samples"), most - c("start_samples")))
    seconds = F.when(c(known) & c("_numbers").isNull(), c(total).cast("double") / c(rate))
    return rows.withColumn("real_total_seconds", seconds).drop("_numbers", "_first", "_own")
