"""Requests on captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions.plan import with_plan


def plan_cuts(cuts: DataFrame, captures: DataFrame, key: str = "path") -> DataFrame:
    """``cuts`` (key, start_sec, len_sec) with the plan of each on its capture.

    A request for a capture that is not there has the error of an invalid rate.
    """
    own = captures.select(key, "real_rate_hz", F.col("total_samples").cast("bigint").alias("_total"), F.coalesce("total_samples_known", F.lit(False)).alias("_known"))
    rows = cuts.join(own, key, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    rows = rows.withColumn("_start", F.col("start_sec").cast("double")).withColumn("_length", F.col("len_sec").cast("double"))
    return with_plan(rows, "_start", "_length", "real_rate_hz", "_total", "_known").drop("_start", "_length", "_total", "_known")
