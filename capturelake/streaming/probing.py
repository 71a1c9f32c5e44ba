"""Probing folders as files arrive.

New files come from Spark's own file stream.  Of each micro-batch the new
captures are probed, and of those that a companion can still change the ones in
folders with a new companion; what has changed is appended.  So the last row of
each capture is that of a batch probe of the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from capturelake import api
from capturelake.functions.text import path_dir, path_ext
from capturelake.shared import materialised

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_OPEN = "path string, dir string, provenance string, total_samples bigint"


def watch(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(path, dir, ext, file_size): the files below a folder, as a stream of
    those that are new; their content is not read."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").options(**options).load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(path.alias("path"), path_dir(path).alias("dir"), path_ext(path).alias("ext"), F.col("length").alias("file_size"))


def probe_changes(files: DataFrame, out: str, scan: bool = True) -> DataStreamWriter:
    """A writer of the changes to ``out/changes`` (rows of a probe with ``batch``);
    start it with a ``checkpointLocation``.

    A capture that no tag and no header resolves waits in ``out/open/<batch>``;
    a batch that is run again writes the same folders again.  The state is a
    table of waiting captures, which each batch reads once and writes once.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = materialised(batch.select("path", "dir", F.lower("ext").alias("ext")), "new")
        before = _waiting(spark, out, number)
        touched = new.where("ext in ('log', 'wav')").select("dir").distinct()
        again = before.join(touched, "dir", "left_semi").select("path")
        asked = materialised(new.where("ext = 'flac'").select("path").union(again).distinct(), "asked")
        probed = materialised(api.probe_table(asked, scan=scan), "probed")
        told = before.select(F.col("path").alias("_path"), F.col("provenance").alias("_provenance"), F.col("total_samples").alias("_total"))
        rows = probed.join(told, F.col("path") == F.col("_path"), "left")
        same = F.col("_path").isNotNull() & F.col("provenance").eqNullSafe(F.col("_provenance")) & F.col("total_samples").eqNullSafe(F.col("_total"))
        rows.where(~same).drop("_path", "_provenance", "_total").write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        can_change = F.col("ok") & (F.col("total_samples").isNull() | F.col("provenance").isin("companion-file", "scanned-from-frames"))
        still = probed.where(can_change).select("path", path_dir(F.col("path")).alias("dir"), "provenance", "total_samples")
        before.join(asked, "path", "left_anti").select("path", "dir", "provenance", "total_samples").union(still).write.mode("overwrite").parquet(f"{out}/open/{number}")

    return files.writeStream.foreachBatch(each)


def _waiting(spark: SparkSession, out: str, number: int) -> DataFrame:
    if number == 0:
        return spark.createDataFrame([], _OPEN)
    return spark.read.schema(_OPEN).parquet(f"{out}/open/{number - 1}")
