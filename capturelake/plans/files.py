"""Queries that read files: bytes derived from ``supplier`` are written to the
shared folder and read back through the sources.

Each supplier has a capture; some have a log or an audio file beside it, some
captures are not what their name says.  In sizes and times k is the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake import api, sql
from capturelake.functions.text import path_name
from capturelake.plans.derived import table
from capturelake.shared import materialised, shared_path, spread
from capturelake.sources import companions, flac

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _capture(k: int) -> bytes:
    if k % 10 == 7:
        return b"no stream at all"
    word = (48000 if k % 3 == 0 else 20000) << 44 | 7 << 36 | (k * 1000 + 1 if k % 2 == 0 else 0)
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + word.to_bytes(8, "big") + bytes(16)
    tags = [f"RF_TOTAL_SAMPLES={k * 77 + 1000}".encode()] if k % 5 == 0 else []
    body = bytes(4) + len(tags).to_bytes(4, "little") + b"".join(len(t).to_bytes(4, "little") + t for t in tags)
    data = b""
    for i in range(k // 2 % 4):
        head = bytes([0xFF, 0xF8, 0x10, 0x00, i])
        crc = 0
        for x in head:
            crc = flac._CRC[crc ^ x]
        data += head + bytes([crc]) + bytes(10)
    return b"fLaC" + bytes([0, 0, 0, 34]) + info + b"\x84" + len(body).to_bytes(3, "big") + body + data + bytes(5)


def _log(k: int) -> bytes:
    return b"x" * (70_000 if k % 4 == 1 else 10) + f" duration={k % 1000}.5s".encode()


def _wav(k: int) -> bytes:
    size = (k % 1000 + 1) * 192_000
    return b"RIFF" + bytes(4) + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\2\0" + (48000).to_bytes(4, "little") + (192000).to_bytes(4, "little") + b"\4\0\x10\0" + b"data" + size.to_bytes(4, "little")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, kind, folder, path) of the files, written by tasks; of every ninth
    supplier also a capture that is not there."""
    root = shared_path(spark, "files")

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            out = []
            for k in map(int, batch.iloc[:, 0]):
                folder = f"d{k % 5}"
                if folder not in made:
                    store.create_dir(f"{inner}/{folder}", recursive=True)
                    made.add(folder)
                files = [("flac", _capture(k))]
                if k % 6 == 1:
                    files.append(("log", _log(k)))
                if k % 6 == 3:
                    files.append(("wav", _wav(k)))
                for kind, data in files:
                    name = f"cap_{k:08d}{'' if kind == 'flac' else '_side'}.{kind}"
                    with store.open_output_stream(f"{inner}/{folder}/{name}") as f:
                        f.write(data)
                    out.append((k, kind, f"{root}/{folder}", f"{root}/{folder}/{name}"))
                if k % 9 == 0:
                    out.append((k, "gone", f"{root}/{folder}", f"{root}/{folder}/gone_{k}.flac"))
            yield pd.DataFrame(out, columns=["k", "kind", "folder", "path"], dtype=object)

    rows = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return materialised(rows.mapInPandas(run, "k bigint, kind string, folder string, path string"), "written")


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).where("kind in ('flac', 'gone')").select("path")


@query
def file_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole probes, with companions (logs to their end) and frame scans, of files that are there
    and of some that are not, and of a path that is null."""
    paths = _written(spark, sf_dir).where("kind in ('flac', 'gone')").select("path")
    rows = api.probe_table(paths.union(spark.createDataFrame([(None,)], "path string")))
    return rows.select(path_name(c("path")).alias("name"), "ok", F.split("error", ":")[0].alias("said"), "total_samples", "provenance", "exactness", "real_rate_hz", F.size(F.coalesce("warnings", F.array().cast("array<string>"))).alias("n_warnings"))


@query
def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also of files that are no captures, or are not there."""
    rows = flac.read_headers(spark, _captures(spark, sf_dir))
    return rows.select(path_name(c("path")).alias("name"), "ok", "header_sample_rate", "declared_total_samples", "channels", "bits_per_sample", "file_size", "audio_offset")


@query
def probe_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers by the table function, in a lateral join; files that are not there are rows."""
    sql.register(spark)
    paths = _written(spark, sf_dir).where("kind in ('flac', 'gone')").select("path")
    rows = spark.sql("SELECT p.path AS own, h.* FROM {paths} p, LATERAL capture_header(p.path) h", paths=paths)
    return rows.select(path_name(c("own")).alias("name"), "ok", F.split("error", ":")[0].alias("said"), "header_sample_rate", "declared_total_samples", "file_size", F.size("tags").alias("n_tags"))


@query
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person reads of each probed file, by the heads of logs."""
    paths = _written(spark, sf_dir).where("kind in ('flac', 'gone')").select("path")
    rows = api.report(api.probe_table(paths, whole_logs=False))
    return rows.select(path_name(c("path")).alias("name"), "ok", "header_sample_rate", "real_rate_hz", "is_rf", "total_samples", "provenance", "duration", "warnings")


@query
def file_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flac.read_frames(spark, _captures(spark, sf_dir), 64).where("error is null")
    return rows.select(path_name(c("path")).alias("name"), "off", "block_size", "hlen", "number", "variable")


@query
def file_frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of paths, with a row for each that cannot be read."""
    paths = _written(spark, sf_dir).where("kind in ('flac', 'gone')").select("path")
    return flac.frame_table(paths, size=64).select(path_name(c("path")).alias("name"), "off", "number", c("error").isNotNull().alias("failed"))


@query
def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_tags(spark, _captures(spark, sf_dir)).select(path_name(c("path")).alias("name"), c("total_samples").cast("bigint").alias("total_samples"), c("sample_rate").cast("bigint").alias("sample_rate"), "duration_seconds")


@query
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the folders, and of one that is not there."""
    folders = _written(spark, sf_dir).select("folder")
    files = companions.list_folders(folders.union(folders.select(F.concat("folder", F.lit("/no")))))
    return files.select("name", "stem", "ext", c("file_size").cast("bigint").alias("file_size"))


@query
def file_listing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by Spark's own listing of the folder around them."""
    root = _written(spark, sf_dir).select(F.regexp_replace("folder", "/d[0-9]$", "")).first()
    return companions.list_files(spark, root[0]).select("name", "stem", "ext", "file_size")


@query
def file_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = companions.list_folders(_written(spark, sf_dir).select("folder"))
    return companions.durations(files).select("name", "duration_s")


@query
def file_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of logs, of 64 KiB at most."""
    paths = _written(spark, sf_dir).where("kind = 'log'").select("path")
    return companions.read_logs(spark, paths).select(path_name(c("path")).alias("name"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query
def file_wavs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _written(spark, sf_dir).where("kind = 'wav'").select("path")
    return companions.read_wavs(spark, paths).select(path_name(c("path")).alias("name"), "duration_s")


_ROWS = """WITH s AS (
  SELECT s_suppkey AS k, printf('cap_%08d', s_suppkey) AS stem, CASE WHEN s_suppkey % 3 = 0 THEN 48000 ELSE 20000 END AS rate, s_suppkey // 2 % 4 AS frames,
    CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 1000 + 1 ELSE 0 END AS declared, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey * 77 + 1000 END AS tag,
    CASE WHEN s_suppkey % 6 = 1 AND s_suppkey % 4 <> 1 AND s_suppkey % 1000 + 0.5 > 0 THEN s_suppkey % 1000 + 0.5::DOUBLE WHEN s_suppkey % 6 = 3 THEN (s_suppkey % 1000 + 1)::DOUBLE END AS told,
    s_suppkey % 10 = 7 AS bad FROM supplier),
h AS (SELECT *, 54 + CASE WHEN tag IS NULL THEN 0 ELSE 4 + length('RF_TOTAL_SAMPLES=' || tag) END AS audio FROM s),
sizes AS (SELECT *, CASE WHEN bad THEN 16 ELSE audio + 16 * frames + 5 END AS size FROM h),
files AS (
  SELECT stem || '.flac' AS name, stem AS stem, 'flac' AS ext, size AS file_size FROM sizes
  UNION ALL SELECT stem || '_side.log', stem || '_side', 'log', CASE WHEN k % 4 = 1 THEN 70000 ELSE 10 END + length(' duration=' || (k % 1000) || '.5s') FROM sizes WHERE k % 6 = 1
  UNION ALL SELECT stem || '_side.wav', stem || '_side', 'wav', 44 FROM sizes WHERE k % 6 = 3),
found AS (SELECT k, stem || '.flac' AS name, i FROM sizes, range(0, 3) r(i) WHERE NOT bad AND i < frames)
"""
#: The same with the durations of whole logs.
_WHOLE = _ROWS.replace("s_suppkey % 6 = 1 AND s_suppkey % 4 <> 1 AND", "s_suppkey % 6 = 1 AND")
_FILES = "SELECT name, stem, ext, file_size::BIGINT AS file_size FROM files"
ORACLE: dict[str, str] = {
    "file_probe": _WHOLE
    + """SELECT stem || '.flac' AS name, NOT bad AS ok, CASE WHEN bad THEN 'not a FLAC stream (missing fLaC marker)' END AS said,
  CASE WHEN bad THEN NULL WHEN tag IS NOT NULL THEN tag WHEN declared > 0 THEN declared WHEN told IS NOT NULL THEN round(told * rate * CASE WHEN rate = 48000 THEN 1 ELSE 1000 END)::BIGINT WHEN frames > 0 THEN 192 * frames END::BIGINT AS total_samples,
  CASE WHEN bad THEN NULL WHEN tag IS NOT NULL THEN 'vorbis-tag' WHEN declared > 0 THEN 'header' WHEN told IS NOT NULL THEN 'companion-file' WHEN frames > 0 THEN 'scanned-from-frames' ELSE 'header' END AS provenance,
  CASE WHEN bad THEN NULL WHEN tag IS NULL AND declared = 0 AND told IS NOT NULL THEN 'rounded' ELSE 'exact' END AS exactness,
  CASE WHEN NOT bad THEN rate * CASE WHEN rate = 48000 THEN 1 ELSE 1000 END::DOUBLE END AS real_rate_hz, 0 AS n_warnings FROM sizes
UNION ALL SELECT 'gone_' || k || '.flac', false, 'open failed', NULL, NULL, NULL, NULL, 0 FROM sizes WHERE k % 9 = 0
UNION ALL SELECT NULL, false, 'null path', NULL, NULL, NULL, NULL, 0""",
    "probe_sql": _ROWS
    + """SELECT stem || '.flac' AS name, NOT bad AS ok, CASE WHEN bad THEN 'not a FLAC stream (missing fLaC marker)' END AS said, CASE WHEN NOT bad THEN rate END::BIGINT AS header_sample_rate,
  CASE WHEN NOT bad THEN declared END::BIGINT AS declared_total_samples, size::BIGINT AS file_size, CASE WHEN NOT bad THEN (tag IS NOT NULL)::INT END AS n_tags FROM sizes
UNION ALL SELECT 'gone_' || k || '.flac', false, 'open failed', NULL, NULL, NULL, NULL FROM sizes WHERE k % 9 = 0""",
    "file_report": _ROWS
    + """, f AS (SELECT stem || '.flac' AS name, NOT bad AS ok, CASE WHEN NOT bad THEN rate END::BIGINT AS header_sample_rate, CASE WHEN NOT bad THEN rate * CASE WHEN rate = 48000 THEN 1 ELSE 1000 END END::DOUBLE AS real_rate_hz, CASE WHEN NOT bad THEN rate <> 48000 END AS is_rf,
  CASE WHEN bad THEN NULL WHEN tag IS NOT NULL THEN tag WHEN declared > 0 THEN declared WHEN told IS NOT NULL THEN round(told * rate * CASE WHEN rate = 48000 THEN 1 ELSE 1000 END)::BIGINT WHEN frames > 0 THEN 192 * frames END::BIGINT AS total_samples,
  CASE WHEN bad THEN NULL WHEN tag IS NOT NULL THEN 'vorbis-tag' WHEN declared > 0 THEN 'header' WHEN told IS NOT NULL THEN 'companion-file' WHEN frames > 0 THEN 'scanned-from-frames' ELSE 'header' END AS provenance FROM sizes
  UNION ALL SELECT 'gone_' || k || '.flac', false, NULL, NULL, NULL, NULL, NULL FROM sizes WHERE k % 9 = 0),
m AS (SELECT *, (floor(total_samples / real_rate_hz) * 1000 + round((total_samples / real_rate_hz - floor(total_samples / real_rate_hz)) * 1000))::BIGINT AS ms FROM f)
SELECT name, ok, header_sample_rate, real_rate_hz, is_rf, total_samples, provenance, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS duration, '' AS warnings FROM m""",
    "file_headers": _ROWS
    + """SELECT stem || '.flac' AS name, NOT bad AS ok, CASE WHEN NOT bad THEN rate END::BIGINT AS header_sample_rate, CASE WHEN NOT bad THEN declared END::BIGINT AS declared_total_samples,
  CASE WHEN NOT bad THEN 1 END AS channels, CASE WHEN NOT bad THEN 8 END AS bits_per_sample, size::BIGINT AS file_size, CASE WHEN NOT bad THEN audio END::BIGINT AS audio_offset FROM sizes
UNION ALL SELECT 'gone_' || k || '.flac', false, NULL, NULL, NULL, NULL, NULL, NULL FROM sizes WHERE k % 9 = 0""",
    "file_frames": _ROWS + "SELECT name, (16 * i)::BIGINT AS off, 192 AS block_size, 6 AS hlen, i::BIGINT AS number, false AS variable FROM found",
    "file_frame_table": _ROWS
    + """SELECT name, (16 * i)::BIGINT AS off, i::BIGINT AS number, false AS failed FROM found
UNION ALL SELECT stem || '.flac', NULL, NULL, true FROM sizes WHERE bad UNION ALL SELECT 'gone_' || k || '.flac', NULL, NULL, true FROM sizes WHERE k % 9 = 0""",
    "file_tags": _ROWS + "SELECT stem || '.flac' AS name, CASE WHEN NOT bad THEN tag END::BIGINT AS total_samples, NULL::BIGINT AS sample_rate, NULL::DOUBLE AS duration_seconds FROM sizes UNION ALL SELECT 'gone_' || k || '.flac', NULL, NULL, NULL FROM sizes WHERE k % 9 = 0",
    "file_listing": _ROWS + _FILES,
    "file_listing_scan": _ROWS + _FILES,
    "file_durations": _ROWS + "SELECT stem || CASE WHEN k % 6 = 1 THEN '_side.log' ELSE '_side.wav' END AS name, told AS duration_s FROM sizes WHERE k % 6 IN (1, 3)",
    "file_logs": _ROWS + "SELECT name, least(file_size, 65536)::BIGINT AS n_bytes FROM files WHERE ext = 'log'",
    "file_wavs": _ROWS + "SELECT stem || '_side.wav' AS name, told AS duration_s FROM sizes WHERE k % 6 = 3",
}
