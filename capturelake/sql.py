"""The engine for SQL users: functions and a table function for a session.

``register(spark)`` makes them temporary functions.  They are expressions that
the optimizer sees through, with the meaning of their namesakes in
``capturelake.functions``; ``capture_header`` opens files, one row a path, in
a lateral join: ``SELECT * FROM paths, LATERAL capture_header(path)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from capturelake.functions import plan, rate, text
from capturelake.schema import HEADER

_BANDS = " OR ".join(f"abs(CAST(header_rate AS DOUBLE) - {a}D) <= {a}D * {rate.TOLERANCE}D" for a in rate.AUDIO_RATES)
_PLAN = "STRUCT<error STRING, start_samples BIGINT, length_samples BIGINT, end_sample BIGINT, real_total_seconds DOUBLE>"
_ASKED = "start_sec DOUBLE, len_sec DOUBLE, rate DOUBLE, total BIGINT, known BOOLEAN"
_ARGS = "start_sec, len_sec, rate, total, known"
_MOST = (1 << 63) - 1

#: Each function's text, in the order in which they use each other.
FUNCTIONS = [
    "capture_finite(x DOUBLE) RETURNS BOOLEAN RETURN x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')",
    f"capture_is_audio(header_rate BIGINT) RETURNS BOOLEAN RETURN {_BANDS}",
    "capture_rate(header_rate BIGINT, msps DOUBLE) RETURNS DOUBLE RETURN CASE WHEN capture_is_audio(header_rate) THEN CAST(header_rate AS DOUBLE) WHEN msps > 0 AND NOT isnan(msps) THEN msps * 1000000D ELSE CAST(header_rate AS DOUBLE) * 1000D END",
    f"capture_msps(path STRING) RETURNS DOUBLE RETURN get(filter(transform(filter(regexp_extract_all(path, r'{text.MSPS_TOKENS}', 1), t -> endswith(lower(t), 'msps')), t -> try_cast(substring(t, 1, length(t) - 4) AS DOUBLE)), x -> x > 0), 0)",
    f"capture_log_duration(log STRING) RETURNS DOUBLE RETURN get(filter(transform(regexp_extract_all(log, r'{text.LOG_DURATION}', 1), t -> try_cast(t AS DOUBLE)), x -> x IS NOT NULL), 0)",
    f"capture_base(stem STRING) RETURNS STRING RETURN CASE WHEN regexp_extract(stem, r'{text.CAPTURE_BASE}', 1) = '' THEN stem ELSE regexp_extract(stem, r'{text.CAPTURE_BASE}', 1) END",
    "capture_output_name(dir STRING, stem STRING, ext STRING, n INT) RETURNS STRING RETURN concat(CASE dir WHEN '' THEN './' WHEN '/' THEN dir ELSE concat(dir, '/') END, stem, CASE WHEN n > 1 THEN concat('-cut-', CAST(n AS STRING)) ELSE '-cut' END, '.', coalesce(ext, 'flac'))",
    f"capture_samples(seconds DOUBLE, rate DOUBLE) RETURNS BIGINT RETURN CASE WHEN capture_finite(round(seconds * rate)) AND round(seconds * rate) >= 0 THEN CAST(least(round(seconds * rate), {plan._LIMIT}D) AS BIGINT) END",
    f"capture_plan_bad(start_sec DOUBLE, len_sec DOUBLE, rate DOUBLE) RETURNS STRING RETURN CASE WHEN NOT (capture_finite(rate) AND rate > 0) THEN '{plan.BAD_RATE}' WHEN NOT capture_finite(len_sec) OR len_sec <= 0 THEN '{plan.BAD_LENGTH}' WHEN NOT capture_finite(start_sec) OR start_sec < 0 THEN '{plan.BAD_START}' END",
    f"capture_plan_error({_ASKED}) RETURNS STRING RETURN coalesce(capture_plan_bad(start_sec, len_sec, rate), CASE WHEN known AND capture_samples(start_sec, rate) >= total THEN '{plan.PAST_END}' END)",
    f"capture_plan_length({_ASKED}) RETURNS BIGINT RETURN CASE WHEN capture_plan_error({_ARGS}) IS NULL THEN greatest(CASE WHEN known AND capture_samples(len_sec, rate) > total - capture_samples(start_sec, rate) THEN total - capture_samples(start_sec, rate) ELSE capture_samples(len_sec, rate) END, 1L) END",
    f"capture_plan({_ASKED}) RETURNS {_PLAN} RETURN named_struct('error', capture_plan_error({_ARGS}), 'start_samples', CASE WHEN capture_plan_error({_ARGS}) IS NULL THEN capture_samples(start_sec, rate) END, 'length_samples', capture_plan_length({_ARGS}), "
    f"'end_sample', CASE WHEN capture_plan_error({_ARGS}) IS NULL THEN capture_samples(start_sec, rate) + least(capture_plan_length({_ARGS}), {_MOST}L - capture_samples(start_sec, rate)) END, 'real_total_seconds', CASE WHEN known AND capture_plan_bad(start_sec, len_sec, rate) IS NULL THEN CAST(total AS DOUBLE) / rate END)",
]


class CaptureHeader:
    """``capture_header(path)``: a row of HEADER; what is wrong with a file is in it."""

    def eval(self, path: str) -> Iterator[Any]:
        from capturelake.sources.flac import header_row

        *values, tags = header_row(path)
        yield (*values, None if tags is None else [{"k": k, "v": v} for k, v in tags])


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    for text_ in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text_}")
    spark.udtf.register("capture_header", F.udtf(CaptureHeader, returnType=HEADER, useArrow=True))
