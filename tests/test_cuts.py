"""Frames, chains in ranges, the seek index, writers and reserved names."""

import itertools
import random
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelake.operators import frames as frame_op
from capturelake.operators import ranges, trim
from capturelake.shared import materialised
from capturelake.sources import companions, flac, seek, sink, writer
from capturelake.sources import frames as audio


def crc16_brute(data):
    crc = 0
    for x in data:
        crc ^= x << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 100, 1000])
def test_checksums(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    assert audio.crc16_of(data) == crc16_brute(data)
    assert audio._behind(audio.crc16_of(data), 777) == crc16_brute(data + bytes(777))


@pytest.mark.parametrize("n", [0, 127, 128, 2047, 2048, 65535, 65536, 2**21, 2**26, 2**31, 2**36 - 1])
def test_coded_numbers(n):
    assert flac.read_coded(audio.coded_number(n) + bytes(9), 0) == (n, len(audio.coded_number(n)))


@pytest.mark.parametrize("bps", [8, 12, 16, 24])
@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_frames_round_trip(bps, n):
    """Every kind of subframe, both kinds of numbers, both channels stored apart and together."""
    rng, most = np.random.default_rng(n), (1 << bps - 1) - 1
    signals = [np.clip(np.cumsum(rng.integers(-3, 4, n)), -most, most), rng.integers(-most - 1, most + 1, n), np.full(n, -5), np.where(np.arange(n) % 2, -most - 1, most)]
    kinds = [(), ("verbatim", "fixed0"), *((f"fixed{o}", None) for o in range(min(5, n))), *([("lpc", None)] if n > 2 else [])]
    for a, b in itertools.product(signals, signals):
        for layout, kind in itertools.product((None, audio.LEFT_SIDE, audio.SIDE_RIGHT, audio.MID_SIDE), kinds):
            x = np.stack([a, b])
            data = audio.encode_frame(x, bps, 77, True, layout, kind, taps=(3, -1), shift=1)
            y, size = audio.decode_frame(data + b"behind")
            assert np.array_equal(x, y) and size == len(data)
        again = audio.renumbered(data, 123_456_789)
        assert np.array_equal(audio.decode_frame(again)[0], x) and flac.parse_frame(again)[2:] == (123_456_789, True)
        assert np.array_equal(audio.decode_frame(audio.encode_frame(x[:1], bps, 5, False))[0], x[:1])


def test_damaged_frames_are_errors():
    x = np.random.default_rng(1).integers(-100, 100, (2, 500))
    data = audio.encode_frame(x, 8, 3)
    for at in (*range(0, len(data), 37), len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            audio.decode_frame(bytes(bad))
    for size in (*range(0, len(data), 41), len(data) - 1):
        with pytest.raises(ValueError):
            audio.decode_frame(data[:size])
    damaged = bytearray(data)
    damaged[200] ^= 1
    with pytest.raises(ValueError, match="checksum"):  # a new number does not hide the damage
        audio.decode_frame(audio.renumbered(bytes(damaged), 9))


def candidates(seed, files):
    """Chains with false, lost and repeated frames, fixed and variable, some that begin in the middle."""
    rng, rows = random.Random(seed), []
    for k in range(files):
        off, n, var = 0, rng.choice([0, 0, 0, 7]), rng.random() < 0.4
        at = n * 16
        for _ in range(rng.randrange(1, 60)):
            off += rng.randrange(1, 12)
            size, u = rng.choice([16, 16, 32]) if var else 16, rng.random()
            if u < 0.15:
                rows.append((k, off, size, rng.randrange(3, 8), rng.randrange(0, 40), rng.random() < 0.5))
            elif u < 0.18:
                n, at = n + 1, at + size
            elif u < 0.20:
                n = max(0, n - 2)
            else:
                rows.append((k, off, size, rng.randrange(3, 8), at if var else n, var))
                n, at = n + 1, at + size
    return rows


@pytest.mark.parametrize(("release", "size"), [(1 << 40, 37), (100, 37), (100, 1000)])
def test_chain_in_ranges_equals_the_fold(spark, release, size):
    frame = spark.createDataFrame(candidates(5, 40), "path bigint, off bigint, block_size int, hlen int, number bigint, variable boolean").withColumn("m", (F.col("path") % 3 * 4).cast("int"))
    want = {r[0]: (r[1], r[2]) for r in frame_op.chain_in_order(frame, "path", "m", release).collect()}
    assert {r[0]: (r[1], r[2]) for r in ranges.chain_in_ranges(frame, "path", "m", release, size).collect()} == want
    taken = ranges.chain_frames(frame, "path", "m", release, size).groupBy("path").agg(F.sum("block_size"), F.count("*"), F.max(F.col("first_sample") + F.col("block_size"))).collect()
    assert {r[0]: (r[1], r[2]) for r in taken} == {k: v for k, v in want.items() if v[1]} and all(r[1] == r[3] for r in taken)


def test_chain_in_ranges_of_nothing(spark):
    none = spark.createDataFrame([], "path string, off bigint, block_size int, hlen int, number bigint, variable boolean")
    assert ranges.chain_in_ranges(none).count() == 0 and ranges.chain_frames(none).count() == 0


def capture(path, n=200_000, channels=2, bps=16, block=1024, variable=False, tail=b""):
    rng = np.random.default_rng(n + channels)
    x = np.clip(np.cumsum(rng.integers(-90, 91, (channels, n)), axis=1), -(1 << bps - 1), (1 << bps - 1) - 1)
    body = b"".join(audio.encode_frame(x[:, a : a + block], bps, a if variable else a // block, variable) for a in range(0, n, block))
    path.write_bytes(audio.stream_header(40_000, channels, bps, n, block, block) + body + tail)
    return x


PLAN = "in_path string, out_path string, start_samples bigint, length_samples bigint"


def test_a_cut_reads_what_it_needs(spark, tmp_path):
    """1 % of a capture: under 2 % of its bytes; with a file of several ranges and cells."""
    x = capture(tmp_path / "a.flac", n=1_000_000)
    path = str(tmp_path / "a.flac")
    size = (tmp_path / "a.flac").stat().st_size
    index = seek.build(spark.createDataFrame([(path,), (None,), (str(tmp_path / "gone.flac"),)], "path string"), grid=1 << 18, stride=2, size=1 << 19)
    assert {r.path for r in index.collect()} == {path} and index.count() == 4
    plans = spark.createDataFrame([(path, f"o{i}", a, 10_000) for i, a in enumerate((0, 123_456, (1 << 18) - 5_000, 989_990))], PLAN)
    rows = seek.read(plans, index, 1 << 18).collect()
    assert not any(r.error for r in rows)
    for i, a in enumerate((0, 123_456, (1 << 18) - 5_000, 989_990)):
        own = sorted((r.first_sample, np.array(r.samples).reshape(-1, 2).T) for r in rows if r.out_path == f"o{i}")
        assert np.array_equal(np.concatenate([v for _, v in own], axis=1), x[:, a : a + 10_000])
        assert sum(r.bytes_read for r in rows if r.out_path == f"o{i}") < size * 0.02


@pytest.mark.parametrize("variable", [False, True])
def test_files_of_cuts(spark, tmp_path, variable):
    """A FLAC cut has the samples, rate, channels and depth; a WAV cut the same, in several files where it is long;
    a cut with a damaged frame has no file, and a capture may end in other bytes."""
    x = capture(tmp_path / "a.flac", n=20_000, variable=variable, tail=b"TAG and more")
    capture(tmp_path / "b.flac", n=20_000, channels=1, bps=8, variable=variable)
    bad = bytearray((tmp_path / "a.flac").read_bytes())
    bad[len(bad) // 2] ^= 0xFF
    (tmp_path / "c.flac").write_bytes(bytes(bad))
    paths = spark.createDataFrame([(str(tmp_path / f"{k}.flac"),) for k in "abc"], "path string")
    index = seek.build(paths, grid=4096, stride=2, size=5000)
    name = lambda n: str(tmp_path / n)
    wanted = [("a", "1", 1500, 7000), ("a", "2", 19_000, 5000), ("b", "3", 0, 3000), ("c", "4", 0, 20_000), ("a", "5", 30_000, 10)]
    plans = lambda ext: spark.createDataFrame([(name(f"{k}.flac"), name(f"{o}{ext}"), a, n) for k, o, a, n in wanted], PLAN)
    done = {r.out_path.rsplit("/", 1)[1]: r for r in writer.write_flac(materialised(seek.read_flac(plans(".flac"), index, 4096), "frames")).collect()}
    assert {k for k, r in done.items() if r.ok} >= {"1.flac", "2.flac", "3.flac"} and "5.flac" not in done
    heads = {r.path.rsplit("/", 1)[1]: r for r in flac.read_headers(spark, [name(f"{k}.flac") for k in "123"]).collect()}
    assert (heads["1.flac"].header_sample_rate, heads["1.flac"].channels, heads["1.flac"].bits_per_sample, heads["1.flac"].declared_total_samples) == (40_000, 2, 16, 7000)
    assert (heads["2.flac"].declared_total_samples, heads["3.flac"].channels, heads["3.flac"].bits_per_sample) == (1000, 1, 8)
    for k, a, n in (("1", 1500, 7000), ("2", 19_000, 1000)):
        data, at, parts = (tmp_path / f"{k}.flac").read_bytes(), 42, []
        while at < len(data):
            y, used = audio.decode_frame(data[at:], 16)
            parts.append(y)
            at += used
        assert np.array_equal(np.concatenate(parts, axis=1), x[:, a : a + n])
    blocks = materialised(seek.read(plans(".wav"), index, 4096), "blocks")
    told = {r.out_path.rsplit("/", 1)[1]: r for r in writer.write_wav(blocks, 16_000).where("not ok").collect()}
    assert set(told) == {"4.wav"} and told["4.wav"].why and not (tmp_path / "4.wav").exists()
    assert np.array_equal(np.frombuffer((tmp_path / "1.wav").read_bytes()[44:] + (tmp_path / "1.2.wav").read_bytes()[44:], "<i2").reshape(-1, 2).T, x[:, 1500:8500])
    assert companions.wav_duration(flac.Memory((tmp_path / "1.2.wav").read_bytes())) == 3000 / 40_000
    assert not list(tmp_path.glob(".*"))


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(writer.AudioFiles)
    rows = [(str(tmp_path / f"{k}.wav"), i, 1, b"head" if i == 0 else None, b"x") for k in range(6) for i in range(3) if (k, i) != (4, 1)]
    frame = spark.createDataFrame([(p, i, n, None if h is None else bytearray(h), bytearray(d)) for p, i, n, h, d in rows], "path string, first_sample bigint, n bigint, head binary, data binary")
    with pytest.raises(Exception, match="has no samples from 1 to 2"):
        writer._save(frame)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    writer._save(frame.where(~F.col("path").endswith("4.wav")))
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{k}.wav" for k in (0, 1, 2, 3, 5)]
    assert (tmp_path / "0.wav").read_bytes() == b"headxxx"


def test_two_batches_reserve_different_names(spark, tmp_path):
    (tmp_path / "t3-cut.flac").write_text("kept")
    frame = spark.createDataFrame([(str(tmp_path / f"t{i}.flac"),) for i in range(20)] * 3, "path string").repartition(6)
    found = []
    threads = [threading.Thread(target=lambda: found.extend(writer.reserve(frame).collect())) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    outputs = [r.output for r in found]
    assert len(outputs) == 120 and len(set(outputs)) == 120 and None not in outputs
    assert (tmp_path / "t3-cut.flac").read_text() == "kept"
    assert Counter(r.path for r in found) == {str(tmp_path / f"t{i}.flac"): 6 for i in range(20)}
    gone = writer.reserve(spark.createDataFrame([(str(tmp_path / "no" / "x.flac"),)], "path string")).first()
    assert gone.output is None


@pytest.mark.parametrize("exact", [1, 64])
def test_blocks_of_each_plan_alone_are_read(spark, tmp_path, monkeypatch, exact):
    """Cuts by the number of a block equal those by comparison, and a filter for each plan reaches the scan."""
    monkeypatch.setattr(trim, "EXACT", exact)
    rows = spark.range(20).selectExpr("id AS capture_id", "explode(sequence(0L, 199L)) AS pos").withColumn("value", F.col("capture_id") * 1000 + F.col("pos"))
    trim.to_blocks(rows, 16).write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    plans = spark.createDataFrame([(1, 0, 5), (19, 190, 50), (7, 15, 1), (7, 16, 33), (3, 10, 0), (4, None, 5), (30, 0, 5)], "capture_id bigint, start_samples bigint, length_samples bigint")
    want = sorted(map(str, trim.trim_blocks(blocks, plans.where("length_samples > 0")).collect()))
    found = trim.trim_blocks(blocks, plans, size=16)
    assert sorted(map(str, found.collect())) == want and len(want) > 5
    assert ("Or(" in found._jdf.queryExecution().executedPlan().toString()) == (exact > 1)
    sink.write_cut(blocks, plans, str(tmp_path / "cut"), size=16)
    assert spark.read.parquet(str(tmp_path / "cut")).count() == len(want)


def test_marks_reserve_where_creation_is_not_exclusive(tmp_path, monkeypatch):
    """A store that is not a local folder: a mark of another's keeps the name from both."""
    from pyarrow import fs

    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    (tmp_path / "d").mkdir()
    monkeypatch.setattr(writer, "_store", lambda path: (store, path))
    assert writer.claim("d/x") and not writer.claim("d/x") and (tmp_path / "d" / "x").exists()
    (tmp_path / "d" / "y.claim-other").write_text("")
    assert not writer.claim("d/y") and not (tmp_path / "d" / "y").exists()
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["x", "y.claim-other"]


def tasks_of(rows):
    """How many tasks wrote a table."""
    return rows.select(F.input_file_name()).distinct().count()


def test_captures_and_cuts_are_dealt_to_tasks(spark, tmp_path):
    """Tables that name files are small: one partition of them, or of their cuts, would be one task's work."""
    from capturelake.plans import cutting

    spark.range(1, 41).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    captures, root = cutting._captures(spark, str(tmp_path))
    assert captures.count() == 40 and tasks_of(captures) > 4
    one = materialised(captures.coalesce(1), "one")
    index = cutting._index(one.select("path"))
    assert tasks_of(materialised(seek.read(cutting._plans(one, root, ".flac"), index, cutting.GRID), "blocks")) > 4
    assert tasks_of(materialised(seek.read_flac(cutting._plans(one, root, ".flac"), index, cutting.GRID), "frames")) > 4
    assert tasks_of(writer.reserve(one.select("path"))) > 4


def test_chains_of_many_small_files(spark):
    """A file costs its candidates, not frames and groups of its own: 20,000 of two ranges, of which some are looked up again."""
    import time

    rows = spark.range(20_000).selectExpr("id AS path", "explode(array(0, 1, 2, 3)) AS i").selectExpr("path", "CAST(10 * i AS BIGINT) AS off", "100 AS block_size", "6 AS hlen", "CAST(CASE WHEN path % 7 = 0 AND i = 2 THEN 50 WHEN path % 7 = 0 AND i = 3 THEN 2 ELSE i END AS BIGINT) AS number", "false AS variable")
    start = time.time()
    found = ranges.chain_in_ranges(rows, size=20).groupBy("counted", "n_frames").count().collect()
    assert {(r[0], r[1]): r[2] for r in found} == {(400, 4): 17_142, (300, 3): 2858}
    assert time.time() - start < 90


def test_checksums_are_one_on_both_sides_of_short():
    data = np.random.default_rng(1).integers(0, 256, audio.SHORT + 1, np.uint8).tobytes()
    assert audio.crc16_of(data[:-1]) == crc16_brute(data[:-1]) and audio.crc16_of(data) == crc16_brute(data)
