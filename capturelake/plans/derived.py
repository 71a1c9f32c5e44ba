"""Captures, companions, frames and requests derived from the standard tables.

The expressions mean the same in Spark and in DuckDB, so that both engines
begin with the same rows; only the time stamp's format differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_STAMP = "date_format(o_orderdate, 'yyyy.MM.dd_HH.mm.ss')"
DUCK_STAMP = "strftime(o_orderdate, '%Y.%m.%d_%H.%M.%S')"


def _cases(of: str, *values: object) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


CAPTURES = {
    "capture_id": "o_orderkey",
    "header_rate": f"CAST({_cases('o_orderkey % 11', 8000, 10000, 20000, 40000, 44100, 47900, 48000, 96000, 192000, 22050, 28636)} AS BIGINT)",
    "dir": "concat('/cap/', CAST(o_custkey % 10 AS STRING))",
    "stem": "CASE WHEN o_orderkey % 50 = 7 THEN concat('Plain_', CAST(o_custkey AS STRING)) ELSE concat('Tape_', CAST(o_custkey AS STRING), '_', {stamp}, '_rf', " + _cases("o_orderkey % 4", "'_20msps'", "'_28.6MSPS_x'", "''", "'_0msps_40msps'") + ") END",
    "declared": "CASE WHEN o_orderkey % 17 = 0 THEN CAST(0 AS BIGINT) ELSE ((o_orderkey % 100000) * 49528274364) % 68719476736 END",
    "channels": "CAST(1 + o_custkey % 2 AS INT)",
    "bps": f"CAST({_cases('o_orderkey % 3', 8, 16, 12)} AS INT)",
    "min_block": f"CAST({_cases('o_custkey % 3', 0, 65535, 4096)} AS INT)",
    "max_block": f"CAST({_cases('o_custkey % 3', 0, 65535, 4096)} AS INT)",
    "min_frame": f"CAST({_cases('o_custkey % 3', 'NULL', 60000, 'CASE WHEN o_orderkey % 2 = 0 THEN 3500 END')} AS INT)",
    "max_frame": f"CAST({_cases('o_custkey % 3', 'NULL', 74000, 4400)} AS INT)",
    "audio_bytes": "(o_custkey * 7919 % 1000) * 400000000",
    "audio_offset": "CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 4718682 END AS BIGINT)",
    "file_size": "CASE WHEN o_orderkey % 29 = 0 THEN CAST(1000 AS BIGINT) ELSE (o_custkey * 7919 % 1000) * 400000000 + CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 4718682 END END",
    "tag_total": "CASE WHEN o_orderkey % 5 < 2 THEN (o_custkey % 977) * CAST(120000001 AS BIGINT) WHEN o_orderkey % 5 = 2 THEN CAST(0 AS BIGINT) END",
    "tag_rate": "CASE WHEN o_orderkey % 7 < 2 THEN CAST(20000 AS BIGINT) WHEN o_orderkey % 7 = 2 THEN CAST(40000000 AS BIGINT) WHEN o_orderkey % 7 = 3 THEN CAST(0 AS BIGINT) END",
    "tag_duration": "CASE WHEN o_orderkey % 3 < 2 THEN CAST((o_custkey % 977) * 6 AS DOUBLE) + 0.5 END",
    "scanned": "CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 100) * CAST(1000000 AS BIGINT) END",
}
#: Logs and audio files beside some captures; the stem adds a suffix to the capture's base.
COMPANIONS = {
    "dir": "concat('/cap/', CAST((o_custkey + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END) % 10 AS STRING))",
    "stem": "CASE WHEN o_orderkey % 50 = 7 THEN concat('Plain_', CAST(o_custkey AS STRING), '_x') ELSE concat('Tape_', CAST(o_custkey AS STRING), '_', {stamp}, '_side') END",
    "ext": _cases("o_orderkey % 7", "'log'", "'WAV'", "'wav'", "'txt'", "'md'", "'Log'", "'jpg'"),
    "name": "concat('n', CAST(o_orderkey AS STRING))",
    "duration_s": "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 7000 AS DOUBLE) + 0.25 END",
}
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
FRAMES = f"""
SELECT l_orderkey AS path, off, CAST(bs AS INT) AS block_size, CAST(6 AS INT) AS hlen, variable,
  CASE WHEN fake THEN 5000 + off WHEN variable THEN starts - bs ELSE nth - 1 END AS number
FROM (
  SELECT l_orderkey, off, bs, fake, l_orderkey % 2 = 1 AS variable,
    CAST(sum(CASE WHEN fake THEN 0 ELSE bs END) OVER (PARTITION BY l_orderkey ORDER BY off) AS BIGINT) AS starts,
    CAST(sum(CASE WHEN fake THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY off) AS BIGINT) AS nth
  FROM (
    SELECT l_orderkey, l_partkey % 7 = 0 AS fake, CAST(l_quantity AS BIGINT) AS bs,
      CAST(10 * row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS BIGINT) AS off
    FROM lineitem) a) b
"""
CUTS = {
    "event_id": "event_id",
    "capture_id": "CASE WHEN event_id % 97 = 0 THEN event_id + 1000000000000 ELSE CAST(floor(event_id * 3 / 2) AS BIGINT) END",
    "start_sec": "CASE WHEN event_id % 37 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 41 = 0 THEN CAST(-1 AS DOUBLE) ELSE value END",
    "len_sec": "CASE WHEN event_id % 43 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 47 = 0 THEN CAST(1e14 AS DOUBLE) ELSE CAST(event_id % 50 AS DOUBLE) / 4 END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(columns: dict[str, str], stamp: str) -> list[str]:
    return [f"{v.replace('{stamp}', stamp)} AS {k}" for k, v in columns.items()]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_select(CAPTURES, SPARK_STAMP))


def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_select(COMPANIONS, SPARK_STAMP))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FRAMES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(CUTS, SPARK_STAMP))


DUCK_CAPTURES = f"captures AS (SELECT {', '.join(_select(CAPTURES, DUCK_STAMP))} FROM orders)"
DUCK_COMPANIONS = f"companions AS (SELECT {', '.join(_select(COMPANIONS, DUCK_STAMP))} FROM orders)"
DUCK_FRAMES = f"frames AS ({FRAMES})"
DUCK_CUTS = f"cuts AS (SELECT {', '.join(_select(CUTS, DUCK_STAMP))} FROM events)"
