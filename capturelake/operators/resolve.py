"""The true sample count of a capture, by priority of its sources.

First the embedded tag, then the header (with its wrap undone), then a
companion file, then the frame scan.  The costly sources are read only for
captures that the cheap ones leave open: each is a filter and a join back, not
a branch of an expression, which Spark would evaluate for every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions import rate, text, unwrap
from capturelake.functions.staged import staged
from capturelake.functions.text import MOST_U64
from capturelake.shared import materialised

_WIDE = "decimal(38,0)"


def tag_total(total: Column, tag_rate: Column) -> Column:
    """A positive tag's total in samples on disk, at most 2**64 - 1."""
    scaled = total.cast(_WIDE) * rate.tag_scale(F.coalesce(tag_rate.cast("bigint"), F.lit(0).cast("bigint"))).cast("decimal(5,0)")
    return F.when(total > 0, F.least(scaled, F.lit(str(MOST_U64)).cast(_WIDE)))


def _ms(seconds: Column) -> Column:
    return F.floor(seconds * 1000.0).cast("string")


def tag_mismatch(total: Column, tag_rate: Column, duration: Column) -> Column:
    """A warning if the tags' total over rate is over a second from their duration."""
    implied = total.cast("double") / F.when(tag_rate > 0, tag_rate.cast("double"))
    apart = F.abs(implied - duration)
    wrong = (total > 0) & ~F.isnan(apart) & (apart > 1.0)
    return F.when(wrong, F.concat(F.lit("tags disagree: total over rate is "), _ms(implied), F.lit(" ms, duration "), _ms(duration), F.lit(" ms")))


def sane_tag_total(total: Column, audio_bytes: Column, channels: Column, bps: Column) -> tuple[Column, Column]:
    """(total, warning): the payload must not be larger than the samples.  A
    total that is large enough times 1000 is taken so, another is dropped;
    unknown sizes are not checked."""
    width = unwrap.bytes_per_sample(channels, bps)
    size = total.cast(_WIDE) * width.cast("decimal(10,0)")
    small = (audio_bytes > 0) & (width > 0) & (size < audio_bytes.cast(_WIDE))
    kilo = size * F.lit(1000).cast("decimal(5,0)") >= audio_bytes.cast(_WIDE)
    kept = F.when(small & kilo, F.least(total.cast(_WIDE) * F.lit(1000).cast("decimal(5,0)"), F.lit(str(MOST_U64)).cast(_WIDE))).when(small, F.lit(None).cast(_WIDE)).otherwise(total)
    told = F.concat(F.lit("tag total "), total.cast("string"), F.lit(" is too small for "), audio_bytes.cast("string"), F.lit(" payload bytes: "))
    warning = F.when(total.isNull(), None).when(small & kilo, F.concat(told, F.lit("taken times 1000"))).when(small, F.concat(told, F.lit("ignored")))
    return kept, warning


def scan_warning(scanned: Column, audio_bytes: Column, channels: Column, bps: Column) -> Column:
    """A warning if the scanned samples are fewer than the payload's bytes can hold."""
    width = unwrap.bytes_per_sample(channels, bps)
    few = (width > 0) & (scanned.cast(_WIDE) * width.cast("decimal(10,0)") < audio_bytes.cast(_WIDE))
    return F.when(few, F.concat(F.lit("scanned "), scanned.cast("string"), F.lit(" samples are too few for "), audio_bytes.cast("string"), F.lit(" payload bytes")))


def provenance(from_tag: Column, from_companion: Column, scanned: Column, wraps: Column) -> Column:
    return F.when(from_tag, "vorbis-tag").when(from_companion, "companion-file").when(scanned, "scanned-from-frames").when(wraps > 0, "wrap-corrected").otherwise("header")


def exactness(from_tag: Column, from_companion: Column, scanned: Column, estimated: Column) -> Column:
    """How exact a total is: a companion's comes from a rounded duration."""
    return F.when(from_tag | scanned, "exact").when(from_companion, "rounded").when(estimated, "estimated").otherwise("exact")


def headers_to_captures(headers: DataFrame) -> DataFrame:
    """The header source's rows with their tags read and their rate resolved."""
    tags = F.coalesce("tags", F.array().cast("array<struct<k:string,v:string>>"))
    rows = headers.withColumn("tag_total", text.parse_u64(text.tag(tags, "RF_TOTAL_SAMPLES"))).withColumn("tag_rate", text.parse_u64(text.tag(tags, "RF_SAMPLE_RATE"))).withColumn("tag_duration", text.parse_f64(text.tag(tags, "DURATION_SECONDS")))
    hint = text.msps(F.col("path"))
    real, rf, given = rate.with_tag_rate(rate.real_rate(F.col("header_sample_rate"), hint), rate.is_rf(F.col("header_sample_rate")), F.col("tag_rate"))
    return rows.withColumn("real_rate_hz", real).withColumn("is_rf", rf).withColumn("rate_from_vorbis", given)


def resolve_cheap(captures: DataFrame) -> DataFrame:
    """Tag and header: adds total_samples (null if still unknown) and how it was found."""
    c = F.col
    rows = captures.withColumn("audio_bytes", unwrap.payload(c("file_size"), c("audio_offset")))
    scaled = tag_total(c("tag_total"), c("tag_rate"))
    rows = staged(rows, _tag=scaled, _w1=tag_mismatch(c("tag_total"), c("tag_rate"), c("tag_duration")))
    kept, warning = sane_tag_total(c("_tag"), c("audio_bytes"), c("channels"), c("bits_per_sample"))
    rows = staged(rows, _kept=kept, _w2=warning)
    body = (c("audio_offset") > 0) & (c("file_size") > c("audio_offset"))
    rows = unwrap.with_corrected(rows, "_total", "declared_total_samples", bps="bits_per_sample")
    own, tagged = c("_kept").isNull() & c("total_samples_known"), c("_kept").isNotNull()
    rows = rows.withColumn("_body", F.coalesce(body, F.lit(False)))
    beyond = F.when(own & c("_body") & c("beyond"), F.lit("the header's total does not fit the payload with any number of wraps"))
    return staged(
        rows,
        total_samples=F.when(tagged, c("_kept")).when(own & c("_body"), c("_total").cast(_WIDE)).when(own, c("declared_total_samples").cast(_WIDE)),
        total_samples_wraps=F.when(own & c("_body"), c("wraps")).otherwise(0),
        total_samples_estimated=F.when(own & c("_body"), c("estimated")).otherwise(F.lit(False)),
        total_samples_from_vorbis=tagged,
        warnings=F.array_compact(F.array("_w1", "_w2", beyond)),
    ).drop("_tag", "_w1", "_w2", "_kept", "_body", "_total", "trusted", "wraps", "estimated", "beyond")


def resolve_total(captures: DataFrame, companions: Callable[[DataFrame], DataFrame], scan: Callable[[DataFrame], DataFrame], key: str = "path") -> DataFrame:
    """Every capture with its total by priority.

    ``companions`` gives (key, duration_s), ``scan`` (key, scanned) and, if it
    likes, ``scan_error``, each for the captures it gets: those without a total
    so far (and with a payload, for the scan).  A key that is null or not
    unique is not resolved twice: its rows share what is found.  A scan that
    failed is a warning, with what was wrong.

    What tag and header give is written to the shared folder, since each later
    source reads it again.
    """
    c = F.col
    cheap = materialised(resolve_cheap(captures), "cheap")
    open_ = cheap.where(c("total_samples").isNull())
    told = companions(open_).where("duration_s > 0").groupBy(key).agg(F.min("duration_s").alias("duration_s"))
    left = open_.join(told, key, "left_anti").where((c("audio_offset") > 0) & (c("file_size") > c("audio_offset")))
    found = scan(left)
    if "scan_error" not in found.columns:
        found = found.withColumn("scan_error", F.lit(None).cast("string"))
    counted = found.groupBy(key).agg(F.max(F.when(c("scanned") > 0, c("scanned"))).alias("scanned"), F.min("scan_error").alias("scan_error"))
    rows = cheap.join(told, key, "left").join(counted, key, "left")
    need = c("total_samples").isNull()
    by_companion = need & c("duration_s").isNotNull()
    failed = need & c("duration_s").isNull() & c("scan_error").isNotNull()
    by_scan = need & c("duration_s").isNull() & c("scanned").isNotNull() & c("scan_error").isNull()
    warning = F.when(failed, F.concat(F.lit("frame scan failed: "), c("scan_error"))).when(by_scan, scan_warning(c("scanned"), c("audio_bytes"), c("channels"), c("bits_per_sample")))
    return (
        rows.withColumn("total_samples_from_companion", F.coalesce(by_companion, F.lit(False)))
        .withColumn("total_samples_scanned", F.coalesce(by_scan, F.lit(False)))
        .withColumn("warnings", F.array_compact(F.concat("warnings", F.array(warning))))
        .withColumn("total_samples", F.when(by_companion, F.round(c("duration_s") * c("real_rate_hz")).cast("decimal(38,0)")).when(by_scan, c("scanned").cast("decimal(38,0)")).otherwise(c("total_samples")))
        .withColumn("total_samples_known", c("total_samples").isNotNull())
        .withColumn("provenance", provenance(c("total_samples_from_vorbis"), c("total_samples_from_companion"), c("total_samples_scanned"), c("total_samples_wraps")))
        .withColumn("exactness", exactness(c("total_samples_from_vorbis"), c("total_samples_from_companion"), c("total_samples_scanned"), c("total_samples_estimated")))
        .drop("duration_s", "scanned", "scan_error")
    )
