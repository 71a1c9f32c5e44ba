"""The queries over derived captures, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake import sql
from capturelake.functions import binary, hms, markers, plan, rate, text, unwrap
from capturelake.functions.staged import staged
from capturelake.operators import companions as comp
from capturelake.operators import cuts as cut_op
from capturelake.operators import frames as frame_op
from capturelake.operators import naming, resolve, trim
from capturelake.plans import cutting, derived, files
from capturelake.sources import companions as side_files
from capturelake.sources import flac

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = files.QUERIES | cutting.QUERIES
c = F.col


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(derived.captures(spark, sf_dir), msps=text.msps(c("stem")), audio=rate.is_audio_rate(c("header_rate")))
    return rows.withColumn("real", rate.real_rate(c("header_rate"), c("msps"))).withColumn("rf", ~c("audio"))


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate, wraps, duration and the plan of 10 seconds at 60 of every capture."""
    rows = unwrap.with_corrected(_rated(spark, sf_dir), "total_samples").withColumn("known", c("declared") > 0)
    rows = rows.withColumn("seconds", hms.duration(c("total_samples"), c("real"))).withColumn("at", F.lit(60.0)).withColumn("long", F.lit(10.0))
    rows = plan.with_plan(rows, "at", "long", "real", "total_samples", "known")
    return rows.select("capture_id", c("real").alias("real_rate_hz"), c("rf").alias("is_rf"), "total_samples", "wraps", "estimated", hms.format(c("seconds")).alias("duration"), "start_samples", "length_samples", "end_sample", "error")


@query
def rate_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("capture_id", c("real").alias("real_rate_hz"), c("rf").alias("is_rf"))


@query
def rate_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate.match_audio_rates(derived.captures(spark, sf_dir)).select("capture_id", "header_rate")


@query
def rate_tag_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rated(spark, sf_dir)
    real, rf, given = rate.with_tag_rate(c("real"), c("rf"), c("tag_rate"))
    return rows.select("capture_id", real.alias("real_rate_hz"), rf.alias("is_rf"), given.alias("rate_from_vorbis"), rate.tag_scale(c("tag_rate")).alias("scale"))


@query
def msps_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PART_PATH} AS path")
    return rows.select("p_partkey", text.msps(c("path")).alias("msps"))


PART_PATH = (
    "concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ' 18msps.flac' WHEN 1 THEN '35.5msps-take.flac' WHEN 2 THEN '4.5.6msps' "
    "WHEN 3 THEN '+0msps+12MSPS' WHEN 4 THEN '07.08.09.50msps' WHEN 5 THEN ' 12.msps' WHEN 6 THEN '18m-reel.flac' WHEN 7 THEN concat('/d/40Msps/', p_brand) ELSE '.flac' END)"
)


@query
def capture_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.captures(spark, sf_dir).select("capture_id", text.capture_base(c("stem")).alias("base"))


PATHS = "CASE p_partkey % 6 WHEN 0 THEN concat('/tmp/foo/', p_brand, '.flac') WHEN 1 THEN concat('/tmp/', p_brand) WHEN 2 THEN concat(p_name, '.x.wav') WHEN 3 THEN concat('/', p_brand, '.FLAC') WHEN 4 THEN concat('a/.', p_brand) ELSE concat('a.b/', p_brand, '.') END"


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PATHS} AS path")
    return rows.select("p_partkey", text.path_dir(c("path")).alias("dir"), text.path_stem(c("path")).alias("stem"), text.path_ext(c("path")).alias("ext"))


@query
def flac_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PATHS} AS path")
    return rows.where(text.flac_file(c("path"))).select("p_partkey", "path")


LOG_TEXT = (
    "concat(text, CASE doc_id % 6 WHEN 0 THEN concat(' stopped: duration=', CAST(doc_id AS STRING), '.25s') WHEN 1 THEN concat(' Capture Duration: ', CAST(doc_id AS STRING), ' seconds') "
    "WHEN 2 THEN ' duration=. then DURATION==[ duration = 7.5' WHEN 3 THEN ' duration=1.2.3' WHEN 4 THEN ' no timing here' ELSE ' durationx=5' END)"
)


@query
def log_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{LOG_TEXT} AS log")
    return rows.select("doc_id", text.log_duration(c("log")).alias("duration_s"))


HMS_TEXT = (
    "CASE event_id % 9 WHEN 0 THEN concat(CAST(event_id % 70 AS STRING), '.5') WHEN 1 THEN concat(CAST(event_id % 70 AS STRING), ':', CAST(event_id % 61 AS STRING)) "
    "WHEN 2 THEN concat(' ', CAST(event_id % 200 AS STRING), ':', CAST(event_id % 60 AS STRING), ':', CAST(event_id % 60 AS STRING), '.125 ') WHEN 3 THEN '' WHEN 4 THEN '1:2:3:4' "
    "WHEN 5 THEN 'nan' WHEN 6 THEN concat('-', CAST(event_id % 10 AS STRING)) WHEN 7 THEN '1:x:3' ELSE concat('0:0:', CAST(event_id % 60 AS STRING)) END"
)


@query
def hms_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "events").selectExpr("event_id", f"{HMS_TEXT} AS t")
    return rows.select("event_id", hms.parse(c("t")).alias("seconds"))


@query
def hms_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "events").selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN CAST(event_id AS DOUBLE) + 0.9996 WHEN 1 THEN CAST(-3 AS DOUBLE) WHEN 2 THEN 3599.9999 ELSE value * 10 END AS s")
    return rows.select("event_id", hms.format(c("s")).alias("hms"), hms.deciseconds(c("s")).alias("deciseconds"))


@query
def format_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.captures(spark, sf_dir).select("capture_id", text.thousands(c("declared")).alias("text"))


@query
def real_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("capture_id", hms.duration(c("declared"), c("real")).alias("seconds"))


TAG_VALUE = "CASE doc_id % 8 WHEN 0 THEN CAST(doc_id * 1000003 AS STRING) WHEN 1 THEN concat('+', CAST(doc_id AS STRING)) WHEN 2 THEN ' 5 ' WHEN 3 THEN '5d' WHEN 4 THEN '1e3' WHEN 5 THEN '18446744073709551616' WHEN 6 THEN '18446744073709551615' ELSE '' END"
TAG_TIME = "CASE doc_id % 5 WHEN 0 THEN '4403.980000' WHEN 1 THEN '-1.5e2' WHEN 2 THEN ' 1' WHEN 3 THEN '.5' ELSE 'x' END"


@query
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda k, v: f"named_struct('k', '{k}', 'v', {v})"
    tags = f"array({pair('ARTIST', 'source')}, {pair('Rf_Total_Samples', TAG_VALUE)}, {pair('RF_TOTAL_SAMPLES', chr(39) + '9' + chr(39))}, {pair('duration_seconds', TAG_TIME)}) AS tags"
    rows = derived.table(spark, sf_dir, "documents").selectExpr("doc_id", tags)
    return rows.select("doc_id", text.parse_u64(text.tag(c("tags"), "RF_TOTAL_SAMPLES")).cast("string").alias("total"), text.parse_f64(text.tag(c("tags"), "DURATION_SECONDS")).alias("duration"), text.tag(c("tags"), "ALBUM").alias("album"))


@query
def tag_total_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.captures(spark, sf_dir)
    return rows.select("capture_id", resolve.tag_total(c("tag_total"), c("tag_rate")).cast("bigint").alias("total"))


@query
def tag_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.captures(spark, sf_dir)
    return rows.select("capture_id", resolve.tag_mismatch(c("tag_total"), c("tag_rate"), c("tag_duration")).alias("warning"))


def _sane(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("scaled", resolve.tag_total(c("tag_total"), c("tag_rate"))).withColumn("payload", unwrap.payload(c("file_size"), c("audio_offset")))
    kept, warning = resolve.sane_tag_total(c("scaled"), c("payload"), c("channels"), c("bps"))
    return rows.withColumn("kept", kept).withColumn("warning", warning)


@query
def payload_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sane(derived.captures(spark, sf_dir)).select("capture_id", "payload", unwrap.bytes_per_sample(c("channels"), c("bps")).alias("bytes_per_sample"), c("kept").cast("bigint").alias("total"), "warning")


@query
def warnings_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sane(derived.captures(spark, sf_dir))
    return rows.select("capture_id", text.join_warnings(resolve.tag_mismatch(c("tag_total"), c("tag_rate"), c("tag_duration")), c("warning")).alias("warnings"))


@query
def wrap_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unwrap.with_corrected(derived.captures(spark, sf_dir)).select("capture_id", "trusted", "total", "wraps", "estimated", "beyond")


def _sided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derived.captures(spark, sf_dir).select(c("capture_id").alias("path"), "dir", "stem"), derived.companions(spark, sf_dir)


@query
def companion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.join_companions(*_sided(spark, sf_dir)).select(c("path").alias("capture_id"), "kind", "name", "duration_s")


@query
def companion_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.first_duration(*_sided(spark, sf_dir)).select(c("path").alias("capture_id"), "duration_s", "name", "n_companions")


@query
def companion_first_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.first_by_window(*_sided(spark, sf_dir)).select(c("path").alias("capture_id"), "duration_s", "name")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rated(spark, sf_dir)
    side = derived.companions(spark, sf_dir)
    real, rf, given = rate.with_tag_rate(c("real"), c("rf"), c("tag_rate"))
    rows = rows.withColumn("real_rate_hz", real).withColumn("is_rf", rf).withColumn("rate_from_vorbis", given)
    rows = rows.withColumnsRenamed({"capture_id": "path", "declared": "declared_total_samples", "bps": "bits_per_sample", "scanned": "would_scan"}).withColumn("total_samples_known", c("declared_total_samples") > 0).drop("audio_bytes")
    return resolve.resolve_total(rows, lambda left: comp.first_duration(left.select("path", "dir", "stem"), side).select("path", "duration_s"), lambda left: left.select("path", c("would_scan").alias("scanned")))


@query
def resolve_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _resolved(spark, sf_dir)
    return rows.select(c("path").alias("capture_id"), c("total_samples").cast("bigint").alias("total_samples"), "total_samples_known", "total_samples_wraps", "total_samples_estimated", "real_rate_hz")


@query
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy("provenance", "exactness").agg(F.count("*").alias("n"))


@query
def scan_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.captures(spark, sf_dir)
    return rows.select("capture_id", resolve.scan_warning(c("scanned"), c("audio_bytes"), c("channels"), c("bps")).alias("warning"))


@query
def frame_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_op.chain(derived.frames(spark, sf_dir), ["path"]).select(c("path").alias("capture_id"), "counted", "n_frames")


@query
def frame_chain_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_op.chain_in_order(derived.frames(spark, sf_dir)).select(c("path").alias("capture_id"), "counted", "n_frames")


@query
def frame_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_op.sums(derived.frames(spark, sf_dir)).select(c("path").alias("capture_id"), "counted", "n_frames")


@query
def frame_running_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_op.running_position(derived.frames(spark, sf_dir)).select(c("path").alias("capture_id"), "off", "start_sample")


@query
def frame_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_op.gaps(derived.frames(spark, sf_dir)).select(c("path").alias("capture_id"), "off", "in_sequence")


@query
def cut_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unwrap.with_corrected(_rated(spark, sf_dir), "total_samples")
    known = rows.select("capture_id", c("real").alias("real_rate_hz"), "total_samples", (c("declared") > 0).alias("total_samples_known"))
    made = cut_op.plan_cuts(derived.cuts(spark, sf_dir), known, "capture_id")
    return made.select("event_id", "error", "start_samples", "length_samples", "end_sample", "real_total_seconds")


@query
def cut_plan_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the session's SQL functions."""
    sql.register(spark)
    rows = unwrap.with_corrected(_rated(spark, sf_dir), "total_samples")
    known = rows.select("capture_id", c("real").alias("rate"), c("total_samples").cast("bigint").alias("total"), (c("declared") > 0).alias("known"))
    made = "SELECT event_id, capture_plan(CAST(start_sec AS DOUBLE), CAST(len_sec AS DOUBLE), rate, total, coalesce(known, false)) AS p FROM {cuts} LEFT JOIN {captures} USING (capture_id)"
    return spark.sql(f"SELECT event_id, p.error, p.start_samples, p.length_samples, p.end_sample, p.real_total_seconds FROM ({made})", cuts=derived.cuts(spark, sf_dir), captures=known)


@query
def rate_resolve_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("SELECT capture_id, capture_rate(header_rate, capture_msps(stem)) AS real_rate_hz, NOT capture_is_audio(header_rate) AS is_rf FROM {captures}", captures=derived.captures(spark, sf_dir))


@query
def capture_base_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("SELECT capture_id, capture_base(stem) AS base FROM {captures}", captures=derived.captures(spark, sf_dir))


MARKERS = {
    "event_id": "event_id",
    "t": "value - 20",
    "in_s": "CAST(event_id % 100 AS DOUBLE)",
    "out_s": "CAST(event_id % 100 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) / 4",
    "total_s": "CAST(event_id % 150 AS DOUBLE)",
    "lo": "CAST(event_id % 10 AS INT)",
    "hi": "CAST(event_id % 90 AS INT)",
    "a": "CAST(event_id % 50 AS INT)",
    "b": "CAST(event_id % 80 AS INT)",
    "v": "CAST(event_id % 120 AS INT)",
    "span": "CAST(event_id % 4 AS INT)",
}


@query
def marker_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "events").selectExpr(*(f"{v} AS {k}" for k, v in MARKERS.items()))
    high, in_, out = markers.slider_range(c("lo"), c("hi"), c("a"), c("b"), c("span"))
    return rows.select(
        "event_id",
        markers.set_in(c("t"), c("out_s")).alias("new_in"),
        markers.set_out(c("t"), c("in_s"), c("total_s")).alias("new_out"),
        markers.cut_error(c("in_s"), c("out_s")).alias("error"),
        markers.slider_in(c("v"), c("lo"), c("hi"), c("b"), c("span")).alias("slider_in"),
        markers.slider_out(c("v"), c("lo"), c("hi"), c("a"), c("span")).alias("slider_out"),
        high.alias("range_high"),
        in_.alias("range_in"),
        out.alias("range_out"),
    )


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "embeddings").select(c("vec_id").alias("capture_id"), F.posexplode("embedding").alias("pos", "value"))


@query
def trim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trim.trim_rows(_signal(spark, sf_dir), c("capture_id") % 40, c("capture_id") % 30 + 1)
    return rows.select("capture_id", c("pos").cast("bigint").alias("pos"), c("value").cast("double").alias("value"))


@query
def trim_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "embeddings").select(c("vec_id").alias("capture_id"), trim.trim_array(c("embedding"), c("vec_id") % 70, c("vec_id") % 30 + 1).alias("x"))
    return rows.select("capture_id", F.size("x").cast("bigint").alias("n"), F.get("x", F.lit(0)).cast("double").alias("first_value"), F.get("x", F.size("x") - 1).cast("double").alias("last_value"))


@query
def trim_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = _signal(spark, sf_dir).withColumn("pos", c("pos").cast("bigint"))
    plans = signal.select("capture_id").distinct().select("capture_id", (c("capture_id") % 40).alias("start_samples"), (c("capture_id") % 30 + 1).alias("length_samples"))
    cut = trim.trim_blocks(trim.to_blocks(signal, 16), plans, size=16)
    return cut.select("capture_id", "first_sample", F.posexplode("samples").alias("i", "value")).select("capture_id", (c("capture_id") % 40 + c("first_sample") + c("i")).cast("bigint").alias("pos"), c("value").cast("double").alias("value"))


@query
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PATHS} AS path")
    # two inputs that would have one name: with and without the extension
    rows = rows.union(rows.where("p_partkey % 6 = 1").select("p_partkey", F.concat("path", F.lit(".flac"))))
    parts = staged(rows, d=text.path_dir(c("path")), s=text.path_stem(c("path")), e=text.path_ext(c("path")))
    taken = lambda part, n: parts.where(part).select(text.output_name(c("d"), c("s"), c("e"), n).alias("path"))
    there = taken("p_partkey % 2 = 0", 1).union(taken("p_partkey % 4 = 0", 2)).union(taken("p_partkey % 3 = 0", 3))
    return naming.free_names(rows, there)


@query
def utf8_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(CASE p_partkey % 3 WHEN 0 THEN 'é€😀' WHEN 1 THEN 'ab' ELSE 'ü' END, p_name, 'éé') AS t")
    return rows.select("p_partkey", text.truncate_utf8(c("t"), 8).alias("short"), text.truncate_utf8(c("t"), 16).alias("long"))


@query
def crc8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "part").select("p_partkey", binary.crc8(c("p_name").cast("binary")).cast("int").alias("crc"))


_HEX = "concat(lpad(hex(min_block), 4, '0'), lpad(hex(max_block), 4, '0'), lpad(hex(coalesce(min_frame, 0)), 6, '0'), lpad(hex(coalesce(max_frame, 0)), 6, '0'), lpad(hex(shiftleft(header_rate, 44) + shiftleft(CAST(channels - 1 AS BIGINT), 41) + shiftleft(CAST(bps - 1 AS BIGINT), 36) + declared), 16, '0'), repeat('00', 16))"


@query
def streaminfo_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.captures(spark, sf_dir).select("capture_id", F.unhex(F.expr(_HEX)).alias("b")).withColumn("s", binary.streaminfo(c("b")))
    return rows.select("capture_id", "s.min_block", "s.max_block", "s.min_frame", "s.max_frame", "s.rate", "s.channels", "s.bps", "s.total", "s.known")


@query
def flac_header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = "concat('RF_TOTAL_SAMPLES=', CAST(tag_total AS STRING))"
    little = lambda x: f"concat(lpad(hex({x} % 256), 2, '0'), lpad(hex(CAST({x} / 256 AS BIGINT) % 256), 2, '0'), '0000')"
    body = f"CASE WHEN tag_total IS NULL THEN '0000000000000000' ELSE concat('0000000001000000', {little(f'length({tag})')}, hex({tag})) END"
    whole = f"concat('664C614300000022', {_HEX}, '84', lpad(hex(CAST(length({body}) / 2 AS BIGINT)), 6, '0'), {body})"
    rows = derived.captures(spark, sf_dir).select("capture_id", F.unhex(F.expr(whole)).alias("content"))
    found = flac.parse_headers(rows, "capture_id")
    return found.select("capture_id", "ok", "rate", "total", "bps", "channels", "min_block", "max_block", "min_frame", "max_frame", text.parse_u64(text.tag(c("tags"), "RF_TOTAL_SAMPLES")).cast("bigint").alias("tag_total"))


@query
def frame_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame headers found in bytes: two with a checksum that fits and one without."""
    rows = derived.captures(spark, sf_dir)
    head = lambda n: F.concat(F.unhex(F.lit("FFF81000")), F.unhex(F.lpad(F.hex(n), 2, "0")))
    rows = staged(rows.select("capture_id"), one=head(c("capture_id") % 128), two=head(c("capture_id") % 127))
    rows = staged(rows, crc1=binary.crc8(c("one")), crc2=binary.crc8(c("two")))
    byte = lambda n: F.unhex(F.lpad(F.hex(n % 256), 2, "0"))
    gap = F.unhex(F.repeat(F.lit("00"), (c("capture_id") % 20).cast("int")))
    data = F.concat("one", byte(c("crc1")), gap, "two", byte(c("crc2")), "one", byte(c("crc1") + 1))
    found = flac.scan_frames(rows.select("capture_id", data.alias("content")), "capture_id")
    return found.select("capture_id", "off", "block_size", "hlen", "number", "variable")


@query
def wav_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    little = lambda x: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(4)))
    word = lambda x: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(2)))
    rows = derived.captures(spark, sf_dir).withColumn("size", F.when(c("capture_id") % 9 == 0, 0).when(c("capture_id") % 9 == 1, 4294967295).otherwise(c("capture_id") * 192 % 4000000000).cast("bigint"))
    b = lambda s: F.lit(s).cast("binary")
    odd = F.when(c("capture_id") % 2 == 0, F.concat(b("LIST"), little(F.lit(33)), F.unhex(F.repeat(F.lit("00"), F.lit(34))))).otherwise(F.unhex(F.lit("")))
    form = F.concat(b("fmt "), little(F.lit(16)), word(F.lit(1)), word(c("channels")), little(c("header_rate")), little(F.lit(0)), word(F.lit(4)), word(c("bps")))
    data = F.concat(F.when(c("capture_id") % 11 == 0, b("FORM")).otherwise(b("RIFF")), little(F.lit(0)), b("WAVE"), odd, form, b("data"), little(c("size")))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            batch["duration_s"] = [side_files.wav_duration(flac.Memory(bytes(x))) for x in batch["content"]]
            yield batch[["capture_id", "duration_s"]]

    return rows.select("capture_id", data.alias("content")).mapInPandas(run, "capture_id bigint, duration_s double")
