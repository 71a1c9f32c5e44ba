"""Companion files: logs and audio beside a capture that share its name's start.

Files whose names carry a time stamp join by equality of directory and the name
up to the stamp; that is the same as one name starting with the other's.  For
names without a stamp the other names of the directory are cut to the lengths
that such names have there, and join by equality as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions.staged import staged
from capturelake.functions.text import capture_base

# Companions by rank, logs before audio.
RANKS = {"log": 0, "wav": 1}


def _stamped(base: str) -> F.Column:
    return F.col(base).rlike(r"[0-9]{4}\.[0-9]{2}\.[0-9]{2}_[0-9]{2}\.[0-9]{2}\.[0-9]{2}$")


def _starts(plain: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """``other`` (dir and ``name``) once for each length of the ``_base`` that
    ``plain`` has in that directory (``_dir``), with so much of the name as
    ``_start``."""
    lengths = plain.groupBy(F.col("_dir").alias("_in")).agg(F.collect_set(F.length("_base")).alias("_lengths"))
    rows = other.join(lengths, F.col("dir") == F.col("_in")).withColumn("_length", F.explode(F.filter("_lengths", lambda n: n <= F.length(name))))
    return rows.withColumn("_start", F.substring(name, F.lit(1), F.col("_length"))).drop("_in", "_lengths", "_length")


def join_companions(captures: DataFrame, companions: DataFrame, key: str = "path", how: str = "left") -> DataFrame:
    """Each capture with each of its companions.

    ``captures`` has key, dir, stem; ``companions`` dir, stem, ext, name,
    duration_s.  Extensions are compared in any case, names are not.  With
    ``how`` 'left' captures without a companion have nulls; duplicates give a
    row each.
    """
    own = staged(captures.select(F.col(key), F.col("dir").alias("_dir"), F.col("stem").alias("_stem")), _base=capture_base(F.col("_stem")))
    other = companions.where(F.lower("ext").isin(*RANKS)).select("dir", F.col("stem").alias("c_stem"), F.lower("ext").alias("kind"), "name", "duration_s")
    other = staged(other, _cbase=capture_base(F.col("c_stem")))
    stamped, plain = own.where(_stamped("_base")), own.where(~_stamped("_base"))
    found = stamped.join(other, (F.col("_dir") == F.col("dir")) & (F.col("_base") == F.col("_cbase")))
    started = plain.join(_starts(plain, other, "c_stem"), (F.col("_dir") == F.col("dir")) & (F.col("_base") == F.col("_start")))
    columns = [key, "_base", "c_stem", "kind", "name", "duration_s"]
    pairs = found.select(*columns).unionByName(started.select(*columns)).withColumnRenamed("_base", "base")
    if how == "inner":
        return pairs
    return own.select(key).join(pairs, key, "left")


def first_duration(captures: DataFrame, companions: DataFrame, key: str = "path") -> DataFrame:
    """(key, duration_s, name, n_companions) of each capture's first companion
    with a positive duration: logs first, then by name."""
    pairs = join_companions(captures, companions, key, "inner")
    rank = F.when(F.col("kind") == "log", RANKS["log"]).otherwise(RANKS["wav"])
    order = F.struct(rank, F.col("name"))
    good = F.col("duration_s") > 0
    return pairs.groupBy(key).agg(F.min_by("duration_s", F.when(good, order)).alias("duration_s"), F.min_by("name", F.when(good, order)).alias("name"), F.count("*").alias("n_companions")).where("name is not null")


def first_by_window(captures: DataFrame, companions: DataFrame, key: str = "path") -> DataFrame:
    """The same by a window, ranked by log before audio and name."""
    from pyspark.sql import Window

    rank = F.when(F.col("kind") == "log", RANKS["log"]).otherwise(RANKS["wav"])
    pairs = join_companions(captures, companions, key, "inner").where("duration_s > 0")
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(rank, "name"))).where("_n = 1").select(key, "duration_s", "name")


def ambiguous(captures: DataFrame) -> DataFrame:
    """Captures without a time stamp whose name starts another's: their
    companions may be the other's.  (path, ambiguous)"""
    own = staged(captures.select("path", F.col("dir").alias("_dir"), F.col("stem").alias("_stem")), _base=capture_base(F.col("_stem")))
    plain = own.where(~_stamped("_base"))
    other = _starts(plain, captures.select("dir", F.col("stem").alias("_other")), "_other")
    hit = plain.join(other, (F.col("_dir") == F.col("dir")) & (F.col("_base") == F.col("_start")) & (F.col("_stem") != F.col("_other")), "left_semi")
    return own.select("path").join(hit.select("path", F.lit(True).alias("ambiguous")), "path", "left").fillna(False, ["ambiguous"])
