"""The engine by its entry points: probe, plan, cut, name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions import hms
from capturelake.functions.text import path_dir, path_stem
from capturelake.operators import companions, cuts, frames, naming, resolve, trim
from capturelake.shared import materialised
from capturelake.sources import companions as companion_files
from capturelake.sources import flac, sink

plan_cuts = cuts.plan_cuts
trim_rows, trim_array, trim_blocks = trim.trim_rows, trim.trim_array, trim.trim_blocks
output_paths = naming.free_names
cut_files, tool_available = sink.cut_files, sink.tool_available

#: Sums above this are not written as BIGINT.
_LARGEST = (1 << 63) - 1


def probe(spark: SparkSession, paths: list[str], scan: bool = True, whole_logs: bool = True) -> DataFrame:
    """A row of ``schema.PROBE``, with provenance and exactness, for each path.

    A file that cannot be read has ``ok`` false and its error.  Companions are
    looked for in the files' folders; frames are scanned, if ``scan``, only of
    files that nothing else resolves.  Logs are read to their end, or without
    ``whole_logs`` their first 64 KiB.  The list of paths is the driver's own;
    for a table of paths see :func:`probe_table`.
    """
    return probe_headers(flac.read_headers(spark, paths), scan, whole_logs)


def probe_table(paths: DataFrame, path: str = "path", scan: bool = True, whole_logs: bool = True) -> DataFrame:
    """The same for a table of paths, of any number: no path reaches the driver.
    A null path has a row with that error."""
    return probe_headers(flac.header_table(paths, path), scan, whole_logs)


def probe_headers(headers: DataFrame, scan: bool = True, whole_logs: bool = True) -> DataFrame:
    """The same from rows of ``schema.HEADER``, which are written to the shared
    folder, so that no file is opened again for its header."""
    spark = headers.sparkSession
    headers = materialised(headers, "headers")
    rows = resolve.headers_to_captures(headers.where("ok"))

    def told(open_: DataFrame) -> DataFrame:
        own = open_.select("path", path_dir(F.col("path")).alias("dir"), path_stem(F.col("path")).alias("stem"))
        files = companion_files.list_folders(own.select(F.col("dir").alias("folder"))).withColumn("dir", F.col("folder"))
        return companions.first_duration(own, companion_files.durations(files, whole_logs)).select("path", "duration_s")

    def counted(left: DataFrame) -> DataFrame:
        if not scan:
            return spark.createDataFrame([], "path string, scanned bigint")
        found = materialised(flac.frame_table(left.select("path")), "frames")
        wrong = found.where("error is not null").groupBy("path").agg(F.min("error").alias("scan_error"))
        chain = frames.chain_in_order(found.join(left.select("path", "min_frame").distinct(), "path"), "path", "min_frame")
        return chain.select("path", F.col("counted").alias("scanned")).join(wrong, "path", "full")

    done = resolve.resolve_total(rows, told, counted)
    failed = headers.where("not ok").select("path", "ok", "error", "file_size")
    out = done.withColumn("total_samples", F.when(F.col("total_samples") <= _LARGEST, F.col("total_samples")).cast("bigint"))
    return out.drop("tags").unionByName(failed, allowMissingColumns=True)


def report(probed: DataFrame) -> DataFrame:
    """The fields that a person reads, with the duration as text."""
    seconds = hms.duration(F.col("total_samples"), F.col("real_rate_hz"))
    return probed.select("path", "ok", "error", "header_sample_rate", "bits_per_sample", "channels", "file_size", "audio_offset", "real_rate_hz", "is_rf", "declared_total_samples", "total_samples", "total_samples_wraps", "provenance", hms.format(seconds).alias("duration"), F.concat_ws("; ", "warnings").alias("warnings"))
