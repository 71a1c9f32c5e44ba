"""The folder that the driver and all executors see, and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where the session names none and runs in one process (tests) a temporary
    folder is made and set, so that ``checkpoint()`` works as well; elsewhere
    that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("capturelake.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="capturelake-")
        spark.conf.set("capturelake.shared.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        atexit.register(remove, spark, base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has been stopped
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialised(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: several branches of
    a plan then read what was computed once, and a lost executor costs no more
    than a read."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to several tasks for each core.  For rows that
    name work (a file to write or to read): a table of them is small, so that
    Spark reads it as one partition, or makes one of what a shuffle leaves."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)
