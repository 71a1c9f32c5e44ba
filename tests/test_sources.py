"""Byte-level fixtures: headers, frames, audio files, companions, whole probes."""

import pytest
from pyspark.sql import functions as F

from capturelake import api
from capturelake.operators import frames as frame_op
from capturelake.sources import companions, flac, sink


def crc(b):
    c = 0
    for x in b:
        c ^= x
        for _ in range(8):
            c = (c << 1 ^ (7 if c & 0x80 else 0)) & 0xFF
    return bytes([c])


def header(rate=20000, total=0, tags=(), bps=8, blocks=(4096, 4096), frames=(0, 0)):
    word = rate << 44 | 0 << 41 | (bps - 1) << 36 | total
    info = blocks[0].to_bytes(2, "big") + blocks[1].to_bytes(2, "big") + frames[0].to_bytes(3, "big") + frames[1].to_bytes(3, "big") + word.to_bytes(8, "big") + bytes(16)
    body = bytes(4) + len(tags).to_bytes(4, "little") + b"".join(len(t).to_bytes(4, "little") + t for t in (x.encode() for x in tags))
    return b"fLaC" + bytes([0, 0, 0, 34]) + info + b"\x84" + len(body).to_bytes(3, "big") + body


def fixed(n):
    b = bytes([0xFF, 0xF8, 0x10, 0x00, n])
    return b + crc(b)


def variable(n):
    b = bytes([0xFF, 0xF9, 0x60, 0x00, 0xC0 | n >> 6, 0x80 | n & 63, 0xBF])
    return b + crc(b)


EARLY = ["RF_TOTAL_SAMPLES=88079600", "RF_SAMPLE_RATE=20000", "DURATION_SECONDS=4403.980000"]
LATER = ["rf_total_samples=88079600000", "RF_SAMPLE_RATE=20000000", "RF_TOTAL_SAMPLES=1", "DURATION_SECONDS=4403.980000"]


def wav(size, before=b"", form=b"RIFF"):
    return form + bytes(4) + b"WAVE" + before + b"fmt " + (16).to_bytes(4, "little") + b"\1\0\2\0" + (48000).to_bytes(4, "little") + (192000).to_bytes(4, "little") + b"\4\0\x10\0" + b"data" + size.to_bytes(4, "little")


def chunk(name, n):
    return name + n.to_bytes(4, "little") + bytes(n + n % 2)


def test_headers_and_tags(spark, tmp_path):
    for name, tags in (("early", EARLY), ("later", LATER), ("none", [])):
        (tmp_path / f"{name}.flac").write_bytes(header(total=12345, tags=tags))
    (tmp_path / "bad.flac").write_bytes(b"nothing")
    paths = [str(tmp_path / f"{n}.flac") for n in ("early", "later", "none", "bad", "missing")]
    rows = {r.path.rsplit("/", 1)[1]: r for r in flac.read_headers(spark, paths).collect()}
    assert rows["early.flac"].header_sample_rate == 20000 and rows["early.flac"].channels == 1 and rows["early.flac"].declared_total_samples == 12345
    assert not rows["bad.flac"].ok and "missing fLaC marker" in rows["bad.flac"].error
    assert not rows["missing.flac"].ok and "open failed" in rows["missing.flac"].error
    tags = {r.path.rsplit("/", 1)[1]: (r.total_samples, r.sample_rate) for r in flac.read_tags(spark, paths).collect()}
    assert tags["later.flac"] == (88079600000, 20000000) and tags["bad.flac"] == tags["none.flac"] == (None, None)
    table = flac.header_table(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert table.where("ok").count() == 3


@pytest.mark.parametrize(("data", "skip", "expected"), [
    (fixed(0) + bytes(37) + fixed(1) + bytes(100), 0, 384),
    (fixed(0) + bytes(20) + fixed(5) + bytes(20), 0, 192),
    (fixed(0) + bytes((8 << 20) - 3 - 6) + fixed(1), 0, 384),
    (bytes(8704 << 10) + variable(1000) + bytes(30) + variable(1192) + bytes(30), 0, 384),
    (fixed(0) + bytes((8 << 20) + 50 - 6) + fixed(1), (8 << 20) + 50, 384),
])
def test_frame_chains(spark, tmp_path, data, skip, expected):
    path = str(tmp_path / "a.flac")
    (tmp_path / "a.flac").write_bytes(header() + data)
    found = flac.read_frames(spark, [path], size=1 << 20).selectExpr("*", f"{skip} AS min_frame")
    assert frame_op.chain_in_order(found, "path", "min_frame").first().counted == expected
    assert frame_op.chain(found, ["path"], F.col("min_frame")).first().counted == expected


@pytest.mark.parametrize(("data", "seconds"), [(wav(192000), 1.0), (wav(384000, chunk(b"bext", 602) + chunk(b"JUNK", 512)), 2.0), (wav(96000, chunk(b"LIST", 33)), 0.5), (wav(0), None), (wav(0xFFFFFFFF), None), (wav(192000, form=b"FORM"), None)])
def test_wav(data, seconds):
    assert companions.wav_duration(flac.Memory(data)) == seconds


def test_probe_by_priority(spark, tmp_path):
    stamp = "1999.12.31_23.59.58"
    (tmp_path / "tagged_20msps.flac").write_bytes(header(tags=EARLY) + bytes(50))
    (tmp_path / "plain.flac").write_bytes(header(total=200000000) + bytes(50))
    (tmp_path / f"T_{stamp}_rf.flac").write_bytes(header() + bytes(50))
    (tmp_path / f"T_{stamp}_b.wav").write_bytes(wav(384000))
    (tmp_path / f"T_{stamp}_a.log").write_text("stopped: duration=734.125s")
    (tmp_path / "scan.flac").write_bytes(header() + fixed(0) + bytes(9) + fixed(1) + bytes(9))
    (tmp_path / "none.flac").write_bytes(header() + bytes(50))
    paths = [str(p) for p in tmp_path.glob("*.flac")] + [str(tmp_path / "gone.flac")]
    rows = {r.path.rsplit("/", 1)[1]: r for r in api.probe(spark, paths).collect()}
    got = {k: (r.total_samples, r.provenance) for k, r in rows.items() if r.ok}
    assert got["tagged_20msps.flac"] == (88079600000, "vorbis-tag")
    assert got["plain.flac"] == (200000000, "header")
    assert got[f"T_{stamp}_rf.flac"] == (14682500000, "companion-file")
    assert got["scan.flac"] == (384, "scanned-from-frames")
    assert got["none.flac"][0] is None and not rows["none.flac"].total_samples_known
    assert not rows["gone.flac"].ok
    assert api.report(api.probe(spark, [str(tmp_path / "plain.flac")])).first().duration == "00:00:10.000"
    cuts = spark.createDataFrame([(str(tmp_path / "plain.flac"), 1.0, 2.0)], "path string, start_sec double, len_sec double")
    made = api.plan_cuts(cuts, api.probe(spark, [str(tmp_path / "plain.flac")])).first()
    assert (made.start_samples, made.length_samples) == (20000000, 40000000)


def test_output_names(spark):
    existing = spark.createDataFrame([("/a/tape-cut.flac",), ("/a/tape-cut-2.flac",), ("/a/tape-cut-02.flac",), ("x-cut.flac",)], "path string")
    rows = api.output_paths(spark.createDataFrame([("/a/tape.flac",), ("x",), ("/a/new.wav",)], "path string"), existing)
    assert dict(map(tuple, rows.collect())) == {"/a/tape.flac": "/a/tape-cut-3.flac", "x": "./x-cut-2.flac", "/a/new.wav": "/a/new-cut.wav"}


def test_outputs_of_a_batch_differ(spark):
    """Different inputs that would have one name take different ones, around those that exist."""
    existing = spark.createDataFrame([("/a/x-cut-2.flac",), ("./y-cut.flac",)], "path string")
    inputs = [("/a/x",), ("/a/x.flac",), ("/a/x",), ("y",), ("y.flac",), ("./y.flac",), ("/a/z.wav",)]
    rows = api.output_paths(spark.createDataFrame(inputs, "path string"), existing)
    assert dict(map(tuple, rows.collect())) == {"/a/x": "/a/x-cut.flac", "/a/x.flac": "/a/x-cut-3.flac", "./y.flac": "./y-cut-2.flac", "y": "./y-cut-3.flac", "y.flac": "./y-cut-4.flac", "/a/z.wav": "/a/z-cut.wav"}


def test_unreadable_things_are_rows(spark, tmp_path, monkeypatch):
    """A null path, a folder that is not there, and frames that cannot be read: rows, not a failed job."""
    (tmp_path / "scan.flac").write_bytes(header() + fixed(0) + bytes(9) + fixed(1) + bytes(9))
    (tmp_path / "other.flac").write_bytes(header(total=200000000) + bytes(50))
    gone = str(tmp_path / "no" / "such.flac")
    paths = spark.createDataFrame([(None,), (str(tmp_path / "scan.flac"),), (str(tmp_path / "other.flac"),), (gone,)], "path string")
    rows = {r.path: r for r in api.probe_table(paths).collect()}
    assert rows[None].ok is False and rows[None].error == "null path" and rows[gone].error.startswith("open failed")
    assert rows[str(tmp_path / "scan.flac")].total_samples == 384
    folders = spark.createDataFrame([(str(tmp_path),), (str(tmp_path / "none"),), (None,)], "folder string")
    assert sorted(r.name for r in companions.list_folders(folders).collect()) == ["other.flac", "scan.flac"]
    table = flac.frame_table(spark.createDataFrame([(gone,), (str(tmp_path / "scan.flac"),)], "path string"))
    assert {(r.path == gone, r.error is None) for r in table.collect()} == {(True, False), (False, True)}
    # a file whose frames fail after its header was read
    headers = flac.header_table(paths)
    saved = [tuple(r) for r in headers.collect()]
    (tmp_path / "scan.flac").unlink()
    failed = {r.path: r for r in api.probe_headers(spark.createDataFrame(saved, headers.schema)).collect()}
    one = failed[str(tmp_path / "scan.flac")]
    assert one.ok and one.total_samples is None and any(w.startswith("frame scan failed: ") for w in one.warnings)
    assert failed[str(tmp_path / "other.flac")].total_samples == 200000000


def test_coded_numbers():
    """Up to eight bytes; the first of eight is 0xFF."""
    for n in (0, 127, 128, 2047, 2048, 65536, 1 << 25, (1 << 36) - 1):
        size = 1 if n < 128 else next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
        b = bytes([n]) if size == 1 else bytes([(0xFF << (8 - size) & 0xFF) | n >> 6 * (size - 1)]) + bytes(0x80 | n >> 6 * k & 63 for k in range(size - 2, -1, -1))
        assert flac.read_coded(b + b"\0", 0) == (n, size)
        assert flac.read_coded(b[:-1], 0) is None if size > 1 else True
    eight = b"\xff" + bytes([0x81]) + bytes([0x80] * 5) + bytes([0x82])
    assert flac.read_coded(eight, 0) == (1 << 36 | 2, 8) and flac.read_coded(b"\x80\x80", 0) is None and flac.read_coded(b"\xff\x80", 0) is None


def test_candidates_find_every_header():
    import random

    rng = random.Random(4)
    data = b"".join(rng.choice([fixed(rng.randrange(128)), b"\xff", b"\xff\xf8", bytes([rng.randrange(256)])]) for _ in range(4000))
    slow = [(i, *found) for i in range(3000) if (found := flac.parse_frame(data[i : i + flac.LOOK]))]
    assert list(flac.candidates(data, 0, 3000)) == slow and slow


def test_log_beyond_its_head(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x" * (64 << 10) + b" duration=5s")
    (tmp_path / "b.LOG").write_bytes(b"x" * ((64 << 10) - 12) + b" duration=5s" + b"y")
    files = companions.list_folders(spark.createDataFrame([(str(tmp_path),)], "folder string"))
    assert {r.name: r.duration_s for r in companions.durations(files).collect()} == {"a.log": None, "b.LOG": 5.0}


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 8, 9, 64, 1 << 20])
def test_whole_logs_are_read_in_pieces(spark, monkeypatch, piece):
    """What the whole text has, wherever it is cut."""
    from capturelake.functions.text import log_duration

    logs = [b"", b"duration", b"nothing here", b"durdurationduration=. DURATION :\t= 4", b"duration=1.2.3duration=2.5duration=9", b"x" * 200 + b" duration=5s", b"duration" + b" " * 300 + b"12.25", b"\xe2Duration:7.\xff8", b"duration = \xc3 4", b"duratio duration=.", b"d" * 99 + b"uration=00.50", b"duration=3\x0b1 duration=6"]
    texts = spark.createDataFrame([(i, x.decode("utf-8", "replace")) for i, x in enumerate(logs)], "i int, v string")
    want = [r.x for r in texts.select("i", log_duration(F.col("v")).alias("x")).orderBy("i").collect()]
    monkeypatch.setattr(companions, "PIECE", piece)
    assert [companions.whole_log_duration(flac.Memory(x), len(x)) for x in logs] == want
    assert want[4:7] == [2.5, 5.0, 12.25]


def test_probe_reads_logs_to_their_end(spark, tmp_path):
    (tmp_path / "cap_1.flac").write_bytes(header())
    (tmp_path / "cap_1_side.log").write_bytes(b"x" * (3 << 20) + b" duration=5s")
    paths = spark.createDataFrame([(str(tmp_path / "cap_1.flac"),)], "path string")
    (whole,), (head,) = (api.probe_table(paths, whole_logs=x).collect() for x in (True, False))
    assert (whole.provenance, head.provenance) == ("companion-file", "header")
    assert whole.total_samples == 5 * whole.real_rate_hz and head.total_samples is None


def test_blocks_are_pruned(spark, tmp_path):
    """The bounds of the plans reach the scan of written blocks."""
    from capturelake.operators import trim

    samples = spark.range(10_000).selectExpr("id % 2 AS capture_id", "CAST(id / 2 AS BIGINT) AS pos", "id AS value")
    trim.to_blocks(samples, 100).write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    plans = spark.createDataFrame([(0, 1000, 250), (1, 1150, 10)], "capture_id bigint, start_samples bigint, length_samples bigint")
    cut = trim.trim_blocks(blocks, plans, size=100)
    assert "GreaterThan(first_sample,900)" in cut._jdf.queryExecution().toString() and "LessThan(first_sample,1250)" in cut._jdf.queryExecution().toString()
    assert sorted(map(tuple, cut.selectExpr("capture_id", "n").groupBy("capture_id").sum("n").collect())) == [(0, 250), (1, 10)]
    assert trim.trim_blocks(blocks, plans).count() == cut.count() and trim.trim_blocks(blocks, plans.limit(0), size=100).count() == 0


def test_plain_names_join_by_prefix(spark):
    """The same pairs as comparing every name's start."""
    from capturelake.operators import companions as comp

    stems = ["a", "ab", "abc", "b", "Tape_1999.12.31_23.59.58_x", "", "a.b", "c"]
    captures = [(i, f"/d{i % 2}", s) for i, s in enumerate(stems * 2)]
    others = [(f"/d{i % 2}", s + t, "log", f"n{i}", 1.0) for i, (s, t) in enumerate((s, t) for s in stems for t in ("", "_x", "c"))]
    rows = comp.join_companions(spark.createDataFrame(captures, "path int, dir string, stem string"), spark.createDataFrame(others, "dir string, stem string, ext string, name string, duration_s double"), how="inner")
    from capturelake.functions import text
    base = dict(spark.createDataFrame([(s,) for s in stems], "s string").select("s", text.capture_base(F.col("s"))).collect())
    want = {(i, n) for i, d, s in captures for e, t, _, n, _ in others if d == e and t.startswith(base[s])}
    assert {(r.path, r.name) for r in rows.collect()} == want
    found = dict(comp.ambiguous(spark.createDataFrame([(i, d, s) for i, d, s in captures], "path int, dir string, stem string")).collect())
    assert found == {i: "1999" not in s and any(d == e and t != s and t.startswith(base[s]) for _, e, t in captures) for i, d, s in captures}


def test_missing_tool(spark):
    assert sink.tool_available("no-such-tool-here") is False
    ok, code, said = sink.run_tool("a", "b", 0, 1, "no-such-tool-here")
    assert (ok, code) == (False, -1) and "failed to spawn" in said


def test_streaming_count_equals_batch(spark, tmp_path):
    from capturelake.schema import FRAMES
    from capturelake.streaming.frames import count_frames

    rows = [("p", 10 * i, 100, 6, i, False) for i in range(20)] + [("q", 5, 7, 6, 3, False), ("q", 50, 9, 6, 0, False)]
    for part in (rows[:8], rows[8:]):
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = count_frames(stream).writeStream.outputMode("update").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    found = {r.path: r.counted for r in spark.sql("select path, max(counted) as counted from counted group by path").collect()}
    assert found == {"p": 2000, "q": 9}


def test_late_candidates_equal_batch(spark, tmp_path):
    """Candidates of three files shuffled over micro-batches: the batch chain's counts, and no state read too early."""
    import random
    from datetime import datetime, timedelta

    from capturelake.schema import FRAMES
    from capturelake.streaming.late import count_late_frames

    rng, rows = random.Random(4), []
    for path in "pqr":
        for i in range(40):
            rows.append((path, 10 * i, 100 + i % 3, 6, i if rng.random() < 0.93 else 500 + i, False))
    begin = datetime(2024, 5, 1)
    timed = [(*r, begin + timedelta(seconds=r[1])) for r in rows]
    want = {r.path: (r.counted, r.n_frames) for r in frame_op.chain_in_order(spark.createDataFrame(rows, FRAMES)).collect()}
    # out of order by up to a minute, over six batches; the last row moves the watermark past all
    timed.sort(key=lambda r: r[6] + timedelta(seconds=rng.uniform(0, 60)))
    last = [("end", 0, 1, 6, 0, False, begin + timedelta(days=1)), ("end", 10, 1, 6, 1, False, begin + timedelta(days=2))]
    schema = FRAMES + ", at timestamp"
    for i in range(0, len(timed), 20):
        spark.createDataFrame(timed[i : i + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i:04d}"))
    for i, row in enumerate(last):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / f"in/9{i}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = count_late_frames(stream, delay="2 minutes").writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set(provider, before)
    found = spark.sql("select path, max(counted) as counted, max(n_frames) as n, count(*) as times from late where path <> 'end' group by path").collect()
    assert {r.path: (r.counted, r.n) for r in found} == want
    assert any(r.times > 1 for r in found)


def test_filters_leave_out_ranges(spark, tmp_path):
    """With filters on path and offset only the ranges that can hold them are read."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    for k in "abc":
        (tmp_path / f"{k}.flac").write_bytes(header() + b"".join(fixed(i) + bytes(994) for i in range(100)))
    paths = [str(tmp_path / f"{k}.flac") for k in "abc"]

    def parts(*filters):
        reader = flac._PushedFrameReader({"paths": "\n".join(paths), "range": "10000"})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [(p.paths[0][-6], p.start) for p in reader.partitions() if p.paths]

    assert len(parts()) == 33 and len(parts(EqualTo(("path",), paths[1]))) == 11 and parts(In(("path",), ("no",))) == []
    assert parts(EqualTo(("path",), paths[0]), GreaterThanOrEqual(("off",), 45_000), LessThan(("off",), 61_000)) == [("a", 40_000), ("a", 50_000), ("a", 60_000)]
    before = spark.conf.get(flac.PUSHDOWN)
    spark.conf.set(flac.PUSHDOWN, "true")
    try:
        rows = flac.read_frames(spark, paths, 10_000).where(F.col("path") == paths[2]).where("off >= 45000 and off < 61000")
        assert sorted(r.off for r in rows.collect()) == list(range(45_000, 61_000, 1000))
        assert rows.rdd.getNumPartitions() == 3
    finally:
        spark.conf.set(flac.PUSHDOWN, before)


def test_a_late_companion_changes_its_capture_once(spark, tmp_path):
    """Files that arrive in three batches: each capture's last row is that of a batch probe, and no row repeats the one before."""
    from capturelake.streaming.probing import probe_changes, watch

    (tmp_path / "in" / "d").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "in" / "d" / name).write_bytes(data)
    writer = probe_changes(watch(spark, str(tmp_path / "in")), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    stamp = "2001.02.03_04.05.06"
    steps = [
        [("plain.flac", header(total=200000000) + bytes(50)), (f"T_{stamp}_rf.flac", header() + bytes(50)), ("scan.flac", header() + fixed(0) + bytes(9) + fixed(1) + bytes(9)), ("bad.flac", b"nothing")],
        [(f"T_{stamp}_a.log", b"stopped: duration=734.125s"), ("other.txt", b"x")],
        [(f"T_{stamp}_b.log", b"stopped: duration=1s"), ("plain.log", b"duration=5s"), ("scan_x.log", b"duration=2s"), ("new.flac", header(total=7) + bytes(50))],
    ]
    for files in steps:
        for name, data in files:
            put(name, data)
        q = writer.start()
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(str(tmp_path / "out" / "changes")).collect()
    changes = {}
    for r in sorted(rows, key=lambda r: r.batch):
        changes.setdefault(r.path.rsplit("/", 1)[1], []).append((r.provenance, r.total_samples))
    assert changes[f"T_{stamp}_rf.flac"] == [("header", None), ("companion-file", 14682500000)]
    assert changes["scan.flac"] == [("scanned-from-frames", 384), ("companion-file", 40000000)]
    assert changes["plain.flac"] == [("header", 200000000)] and changes["new.flac"] == [("header", 7)] and changes["bad.flac"] == [(None, None)]
    batch = {r.path.rsplit("/", 1)[1]: (r.provenance, r.total_samples) for r in api.probe(spark, [str(p) for p in (tmp_path / "in" / "d").glob("*.flac")]).collect()}
    assert {k: v[-1] for k, v in changes.items()} == batch


def test_many_small_files_share_tasks(spark, tmp_path):
    """Frames of 300 files, in ranges, by a list and by a table of paths: a few tasks, not one for each range."""
    for k in range(300):
        (tmp_path / f"{k}.flac").write_bytes(header() + b"".join(fixed(i) + bytes(50) for i in range(3)))
    paths = [str(tmp_path / f"{k}.flac") for k in range(300)]
    table = spark.createDataFrame([(p,) for p in [*paths, str(tmp_path / "gone.flac"), None]], "path string")
    by_list, by_table = flac.read_frames(spark, paths, 64), flac.read_frames(spark, table, 64)
    assert by_list.rdd.getNumPartitions() < 20 and by_table.rdd.getNumPartitions() < 100
    want = sorted(map(tuple, by_list.collect()))
    assert len(want) == 900 and sorted(map(tuple, by_table.where("error is null").collect())) == want
    assert [r.path for r in by_table.where("error is not null").collect()] == [str(tmp_path / "gone.flac")]


def test_ranges_that_share_a_task_are_left_out_one_by_one(tmp_path):
    """A filter on paths and offsets reaches the ranges in a bin."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    for k in range(100):
        (tmp_path / f"{k}.flac").write_bytes(header() + b"".join(fixed(i) + bytes(94) for i in range(5)))
    reader = flac._PushedFrameReader({"paths": "\n".join(str(tmp_path / f"{k}.flac") for k in range(100)), "range": "100"})
    reader.pushFilters([EqualTo(("path",), str(tmp_path / "7.flac")), GreaterThanOrEqual(("off",), 200)])
    rows = [x for p in reader.partitions() for x in reader.read(p)]
    assert {x[0] for x in rows} == {str(tmp_path / "7.flac")} and {x[1] for x in rows} >= {200, 300, 400} and 0 not in {x[1] for x in rows}


def test_heads_of_logs_are_given_on_in_parts(spark, tmp_path, monkeypatch):
    """No task holds the heads of a whole batch of logs."""
    for k in range(40):
        (tmp_path / f"{k}.log").write_text("x" * 60_000 + f" duration={k + 1}s")
    seen = {}

    def reading(self, run, schema):
        import pandas as pd

        if schema.startswith("_path string, _text"):
            batch = pd.DataFrame([(str(tmp_path / f"{k}.log"), "log") for k in range(40)])
            seen["parts"] = [p["_text"].str.len().sum() for p in run(iter([batch]))]
        return mapped(self, run, schema)

    mapped = type(spark.range(1)).mapInPandas
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", reading)
    monkeypatch.setattr(companions, "TEXT", 200_000)
    files = spark.createDataFrame([(str(tmp_path / f"{k}.log"), "log") for k in range(40)], "path string, ext string")
    assert companions.durations(files).agg(F.sum("duration_s")).first()[0] == 820
    assert len(seen["parts"]) == 10 and max(seen["parts"]) < 300_000


def test_ranges_of_a_small_file_are_read_at_one_opening(spark, tmp_path, monkeypatch):
    """Files of many ranges, one that is no stream, one that is not there: each is
    opened once, and what cannot be read is one row."""
    for k in range(200):
        (tmp_path / f"{k}.flac").write_bytes(header() + b"".join(fixed(i) + bytes(50) for i in range(20)))
    bad, gone, folder = (str(tmp_path / x) for x in ("bad.flac", "gone.flac", "folder"))
    (tmp_path / "bad.flac").write_bytes(b"no stream at all" * 50)
    (tmp_path / "folder").mkdir()
    paths = [str(tmp_path / f"{k}.flac") for k in range(200)]
    (tmp_path / "opened").mkdir()
    real, opened = flac.open_file, str(tmp_path / "opened")

    def counted(path):
        import os

        with open(f"{opened}/{os.getpid()}", "a") as f:
            f.write(f"{path}\n")
        return real(path)

    monkeypatch.setattr(flac, "open_file", counted)
    table = spark.createDataFrame([(p,) for p in [*paths, bad, gone, folder, None]], "path string")
    rows = flac.frame_table(table, size=64).collect()
    names = sorted(x for p in (tmp_path / "opened").iterdir() for x in p.read_text().split())
    assert sorted((r.path, r.off, r.number) for r in rows if r.error is None) == sorted((p, 56 * i, i) for p in paths for i in range(20))
    assert sorted(r.path for r in rows if r.error is not None) == sorted([bad, gone, folder])
    assert names == sorted([*paths, bad, folder])


def test_many_files_are_written_and_scanned_by_all_cores(spark, tmp_path):
    """The query file_frame_table deals a small table's keys and files to more tasks than there are cores."""
    from capturelake.plans import files

    spark.range(600).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert len(files._written(spark, str(tmp_path)).inputFiles()) > cores
    tasks = files.file_frame_table(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > cores and max(r[1] for r in tasks) < sum(r[1] for r in tasks) / 4


def test_large_files_are_still_dealt_in_ranges(spark, tmp_path):
    """A file of several times OPEN is scanned by several tasks, whatever the ranges, with the same frames."""
    data = b"".join(fixed(i % 128) + bytes(94) for i in range(12_000))
    (tmp_path / "a.flac").write_bytes(header() + data)
    table = spark.createDataFrame([(str(tmp_path / "a.flac"),)], "path string")
    for size in (7_000, flac.OPEN, 1 << 20, flac.RANGE):
        rows = flac.frame_table(table, size=size).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.off, r.number, r.error) for r in rows) == [(100 * i, i % 128, None) for i in range(12_000)]
        assert (len({r.task for r in rows}) > 1) == (size < len(data))
