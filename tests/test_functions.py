"""Scalar functions against the fixed vectors."""

import math

import pytest
from pyspark.sql import functions as F

from capturelake.functions import binary, hms, markers, plan, rate, text, unwrap


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(rows.select("i", f(F.col("v"))).collect())] if len(values) else []


def test_msps(spark):
    given = {"deck b 18msps.flac": 18, "35.5msps-take.flac": 35.5, "q-7MSPS-z": 7, "reel.flac": None, "18m-reel.flac": None, "4.5.6msps": 6, "0msps+12MSPS": 12, "07.08.09.50msps": 9.5, "12.msps": 12, "": None}
    rows = spark.createDataFrame([(k,) for k in given], "v string").select("v", text.msps(F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in rows} == given


def test_log_duration(spark):
    given = {"reel done, duration=734.125s in all": 734.125, "Total DURATION: 88.5 of tape": 88.5, "nothing was timed": None, "duration=. DURATION = 4": 4.0, "duration=1.2.3": None}
    rows = spark.createDataFrame([(k,) for k in given], "v string").select("v", text.log_duration(F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in rows} == given


def test_log_head_cuts_characters_safely(spark):
    log = "duration=734.125s\n" + "é" * 40000
    rows = spark.createDataFrame([(bytearray(log.encode()),)], "v binary")
    assert rows.select(text.log_duration(text.log_head(F.col("v")))).first()[0] == 734.125


def test_capture_base(spark):
    given = {"Reel 3 of_1999.12.31_23.59.58 left-18msps": "Reel 3 of_1999.12.31_23.59.58", "a2001.01.01_00.00.00b2002.02.02_00.00.00": "a2001.01.01_00.00.00", "reel": "reel"}
    rows = spark.createDataFrame([(k,) for k in given], "v string").select("v", text.capture_base(F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in rows} == given


def test_output_name(spark):
    given = {"/reels/b/two.flac": "/reels/b/two-cut.flac", "/reels/THREE": "/reels/THREE-cut.flac", "four.wav": "./four-cut.wav"}
    p = F.col("v")
    rows = spark.createDataFrame([(k,) for k in given], "v string").select("v", text.output_name(text.path_dir(p), text.path_stem(p), text.path_ext(p)).alias("x")).collect()
    assert {r.v: r.x for r in rows} == given


def test_truncate_utf8(spark):
    rows = spark.createDataFrame([("ééé", "hello")], "a string, b string")
    assert tuple(rows.select(text.truncate_utf8(F.col("a"), 4), text.truncate_utf8(F.col("b"), 16)).first()) == ("é", "hello")


@pytest.mark.parametrize(("given", "value"), [("5", 5), ("+5", 5), (" 5 ", None), ("5d", None), ("1e3", None), ("18446744073709551615", 18446744073709551615), ("18446744073709551616", None), ("", None), ("0" * 30 + "7", 7)])
def test_parse_u64(spark, given, value):
    found = spark.createDataFrame([(given,)], "v string").select(text.parse_u64(F.col("v"))).first()[0]
    assert (found is None and value is None) or int(found) == value


def test_rates(spark):
    given = [(48000, None, 48000, False), (96000, None, 96000, False), (44100, None, 44100, False), (20000, None, 20e6, True), (40000, None, 40e6, True), (20000, 20.0, 20e6, True), (48000, 20.0, 48000, False), (47900, None, 47900, False), (10000, -1.0, 10e6, True)]
    rows = spark.createDataFrame([g[:2] for g in given], "h bigint, m double")
    found = rows.select(rate.real_rate(F.col("h"), F.col("m")), rate.is_rf(F.col("h"))).collect()
    assert [tuple(r) for r in found] == [(float(g[2]), g[3]) for g in given]


def test_unwrap(spark):
    given = [(1200000000, 1000000000, 65535, 65535, 64000, 70000, True, 0, False), (49528274364, 115000000000, 65535, 65535, 60000, 74000, False, 1, False), (49528274364, 115000000000, 65535, 65535, None, None, False, 1, True), (0, 5, 0, 0, None, None, False, 1, True), (5, 0, 0, 0, None, None, True, 0, False)]
    rows = spark.createDataFrame([(*g[:6], 1, 8) for g in given], "declared bigint, audio_bytes bigint, min_block int, max_block int, min_frame int, max_frame int, channels int, bps int")
    found = unwrap.with_corrected(rows).collect()
    assert [(r.trusted, r.wraps, r.estimated) for r in found] == [g[6:] for g in given]
    assert found[1].total == 118247751100


def test_plan(spark):
    nan, inf = math.nan, math.inf
    given = [
        (60.0, 10.0, 20e6, 4000000000, True, 1200000000, 200000000, None),
        (9.0, 5.0, 1000.0, 10000, True, 9000, 1000, None),
        (20.0, 5.0, 1000.0, 10000, True, None, None, plan.PAST_END),
        (10.0, 5.0, 1000.0, 10000, True, None, None, plan.PAST_END),
        (nan, 5.0, 1000.0, 10000, True, None, None, plan.BAD_START),
        (0.0, inf, 1000.0, 10000, True, None, None, plan.BAD_LENGTH),
        (1.0, 1.0, 44100.0, 0, False, 44100, 44100, None),
        (0.0, 10.0, 0.0, 0, False, None, None, plan.BAD_RATE),
        (0.0, 0.0, 20e6, 0, False, None, None, plan.BAD_LENGTH),
        (1.0, 1e-9, 1000.0, 10000, True, 1000, 1, None),
        (1.0, 1e300, 1000.0, 10000, True, 1000, 9000, None),
    ]
    rows = spark.createDataFrame([(i, *g[:5]) for i, g in enumerate(given)], "i int, s double, l double, r double, t bigint, k boolean")
    found = sorted(plan.with_plan(rows, "s", "l", "r", "t", "k").collect())
    assert [(r.start_samples, r.length_samples, r.error) for r in found] == [g[5:] for g in given]


def test_hms(spark):
    given = {"5": 5.0, "1:30": 90.0, " 01:42:00.27 ": 6120.27, "60": None, "1:60": None, "-1": None, "": None, "1:2:3:4": None, "nan": None, "inf": None, "x": None}
    rows = spark.createDataFrame([(k,) for k in given], "v string").select("v", hms.parse(F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in rows} == given
    made = spark.createDataFrame([(59.9996, -1.0, 3661.5)], "a double, b double, c double").select(hms.format(F.col("a")), hms.format(F.col("b")), hms.format(F.col("c"))).first()
    assert tuple(made) == ("00:01:00.000", "00:00:00.000", "01:01:01.500")


def test_markers(spark):
    row = spark.range(1).select(markers.set_in(F.lit(9.95), F.lit(10.0)), markers.set_out(F.lit(50.0), F.lit(3.0), F.lit(20.0)), markers.cut_error(F.lit(2.0), F.lit(2.0)), markers.slider_in(F.lit(9), F.lit(0), F.lit(10), F.lit(5), F.lit(0))).first()
    assert row[0] == pytest.approx(9.9) and tuple(row)[1:] == (20.0, markers.NOT_AFTER, 4)


def test_binary(spark):
    data = spark.createDataFrame([(bytearray.fromhex("FFF8100000"),)], "b binary")
    assert data.select(binary.crc8(F.col("b"))).first()[0] == 0x28
    assert data.select(binary.big_endian(F.col("b"), 0, 3), binary.little_endian(F.col("b"), 1, 2)).first()[:] == (0xFFF810, 0x10F8)
