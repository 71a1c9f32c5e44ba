"""Fingerprints, row patterns, importance resampling, unequal mixing and page
versions against brute force, on nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capturelake.llm import fingerprints, html, matching, mixing, resampling

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "no id here at all", "xx", None, 1), (5, "\x00\n\t  \x0b", "en", "b", 1), (6, "word " * 30000, "de", "b", 150000), (7, "日本語 🙂 straße", "ja", "", 9), (8, "x" * 100_000, "en", "b", 1)]


def clashing(rows):
    for name in ("fp", "key", "p", "pos", "place", "guest", "score", "rank", "bucket", "n", "digest", "cents", "_n", "size"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows


# fingerprints


def fingerprint_brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    texts = [t or "" for _, t in rows]
    fps = [fingerprints.fingerprint(t.encode()) for t in texts]
    apart = lambda a, b: bin(int.from_bytes(a) ^ int.from_bytes(b)).count("1")
    out = []
    for i, (k, _) in enumerate(rows):
        t, u = texts[i], texts[(i + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        other = fingerprints.fingerprint(edited.encode())
        near = sum(apart(f, fps[i]) <= fingerprints.RADIUS for f in fps) - 1
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), fps[i].hex(), other.hex(), 1 - apart(fps[i], other) / 256, 1 - apart(fps[i], fps[(i + 1) % len(rows)]) / 256, near))
    return out


def vote_brute(text):
    """The definition, a word at a time."""
    votes = [0] * 256
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.lower())
    for w in set(words):
        import xxhash

        weight = max(1, round(math.sqrt(words.count(w)) * len(w)))
        for i in range(4):
            h = int(fingerprints.mix(np.array([xxhash.xxh64_intdigest(w)], np.uint64), i)[0]).to_bytes(8, "little")
            for b in range(64):
                votes[64 * i + b] += weight if h[b // 8] >> (7 - b % 8) & 1 else -weight
    return bytes(sum((votes[8 * i + j] > 0) << (7 - j) for j in range(8)) for i in range(32))


def test_fingerprint_votes():
    for t in ("", "one", "the cat and the dog", "A a B", "word " * 1000, "日本語 🙂 straße"):
        assert fingerprints.fingerprint(t.encode()) == vote_brute(t.encode())


@pytest.mark.parametrize("partitions", ["2", "8"])
def test_fingerprints_on_odd_rows(spark, partitions):
    rows = [(k, t) for k, t, *_ in ODD]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = fingerprints.describe(clashing(spark.createDataFrame(ODD, DOC))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, fingerprint_brute(rows)))


def test_fingerprints_of_one_and_of_none(spark):
    one = spark.createDataFrame([(4, "alone here")], "doc_id bigint, text string")
    assert [tuple(r) for r in fingerprints.describe(one).collect()] == fingerprint_brute([(4, "alone here")])
    assert fingerprints.describe(one.limit(0)).count() == 0
    ids = spark.createDataFrame([(None, "a"), (None, None)], "doc_id bigint, text string")
    assert fingerprints.describe(ids).count() == 2


@pytest.mark.parametrize(("radius", "tile"), [(0, 100), (7, 16384), (7, 5), (20, 3), (31, 7)])
def test_neighbours_match_brute_force(spark, radius, tile):
    """Near copies of a few fingerprints, many of them with one beginning in common, in tiles."""
    rng = random.Random(radius)
    base = [rng.getrandbits(256) for _ in range(4)]
    fps = []
    for _ in range(150):
        x = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 3, 8, 16, 31])):
            x ^= 1 << rng.randrange(256)
        fps.append(x)
    rows = spark.createDataFrame([(bytearray(x.to_bytes(32, "big")),) for x in fps], "fp binary").repartition(7)
    want = {x.to_bytes(32, "big"): sum((x ^ y).bit_count() <= radius for y in fps) - 1 for x in fps}
    found = fingerprints.neighbours(rows, radius, tile).collect()
    assert {bytes(r.fp): r.n_near for r in found} == {k: v for k, v in want.items() if v}


# row patterns

CLICK = "click_id bigint, ts timestamp, arrived_at timestamp, client_id bigint, kind string, value double, props string"
START = datetime(2024, 1, 1)


def pattern_brute(rows, greedy=False):
    """Letters by Python's own regular expressions: for every start a string of what each row after it may be."""
    by = defaultdict(set)
    for r in rows:
        if r[3] is not None and r[1] is not None:
            by[r[3]].add(r)
    out = []
    for client, own in by.items():
        own = sorted(own, key=lambda r: (r[1], r[0] is not None, r[0] or 0))
        cents = [None if r[5] is None or not math.isfinite(r[5]) else math.floor(100 * r[5] + 0.5) for r in own]
        at, n = 0, 0
        while at < len(own):
            if cents[at] is None:
                at += 1
                continue
            text = ["A"]
            for i in range(at + 1, len(own)):
                near = cents[i] is not None and cents[i - 1] is not None and own[i][1] - own[i - 1][1] <= timedelta(minutes=10)
                step = near and own[i][4] not in (None, "error") and cents[i] != cents[i - 1]
                goal = near and own[i][4] == "purchase" and cents[i] >= cents[at]
                text.append({(0, 0): "x", (1, 0): "d", (0, 1): "p", (1, 1): "b"}[int(step), int(goal)])
            m = re.match("A[db]*[pb]" if greedy else "A[db]*?[pb]", "".join(text))
            if not m:
                at += 1
                continue
            last = at + m.end() - 1
            letters = "A" + "".join("D" if cents[i] < cents[i - 1] else "U" for i in range(at + 1, last)) + "P"
            n += 1
            out.append((client, n, own[at][0], own[last][0], last - at + 1, sum(cents[at : last + 1]), letters))
            at = last + 1
    return sorted(out)


def clicks(seed, n, clients):
    rng, t, rows = random.Random(seed), START, []
    for i in range(n):
        t += timedelta(seconds=rng.choice([1, 10, 30, 60, 100, 600, 601]), microseconds=rng.choice([0, 0, 1]))
        kind = rng.choice(["view", "click", "view", "purchase", "purchase", "error", None])
        value = rng.choice([None, float("nan"), *(round(rng.uniform(-3, 9), 2) for _ in range(12)), 2.5, 2.5, 1e300])
        rows.append((i, t, t, rng.choice([0, 0, *clients, None]), kind, value if value != 1e300 else float("inf"), "{}"))
    return rows + rng.sample(rows, n // 10)


@pytest.mark.parametrize("greedy", [False, True])
@pytest.mark.parametrize("partitions", ["3", "40"])
def test_patterns_match_regular_expressions(spark, greedy, partitions):
    """Also where segments cross the ranges: 40 of them for 1950 rows, half of one client."""
    rows = clicks(3, 1500, [1, 2]) + [(9000 + i, START + timedelta(seconds=i), None, 77, "view" if i % 50 else "purchase", float(i * 37 % 101), None) for i in range(300)]
    frame = clashing(spark.createDataFrame(rows, CLICK))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sorted(map(tuple, matching.matches(frame, greedy=greedy).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = pattern_brute(rows, greedy)
    assert found == want and len(want) > 30 and any(r[0] == 77 and r[4] > 20 for r in want)


def test_patterns_on_odd_tables(spark):
    empty = spark.createDataFrame([], CLICK)
    assert matching.matches(empty).count() == 0
    t = [START + timedelta(minutes=10 * i) for i in range(6)]
    rows = [(1, t[0], None, 5, "view", 1.0, "a"), (None, t[1], None, 5, None, 2.0, "a"), (3, t[1], None, 5, "purchase", 2.0, "a"), (4, t[2], None, 5, "purchase", 1.99, None), (5, t[3], None, 5, "purchase", 2.0, None), (6, None, None, 5, "view", 1.0, None), (7, t[4], None, None, "view", 1.0, None)]
    found = [tuple(r) for r in matching.matches(spark.createDataFrame(rows + rows, CLICK)).collect()]
    assert found == pattern_brute(rows) == [(5, 1, None, 3, 2, 400, "AP"), (5, 2, 4, 5, 2, 399, "AP")]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 500])
def test_tree_descents(n):
    rng = np.random.default_rng(n)
    values = rng.integers(-5, 20, n)
    low, high, least = rng.integers(0, n + 1, 300), rng.integers(-1, n, 300), rng.integers(-6, 22, 300)
    hits = [[i for i in range(a, b + 1) if values[i] >= c] for a, b, c in zip(low, high, least, strict=True)]
    assert matching.first_at_least(values, low, high, least).tolist() == [h[0] if h else -1 for h in hits]
    assert matching.last_at_least(values, low, high, least).tolist() == [h[-1] if h else -1 for h in hits]


# importance resampling


@pytest.mark.parametrize("run", [1, 2, 3])
@pytest.mark.parametrize("size", [64, 1 << 22])
def test_crcs_of_runs(monkeypatch, run, size):
    rng = random.Random(run)
    texts = [bytes(rng.choice(b"aZ9 -\xc3\xa9x") for _ in range(rng.randrange(0, 200))) for _ in range(200)] + [b"", b"a" * 1000 + b" b", b"ab", b"cd", b"", b"A" * 70, b"\x00a\x7f"]
    monkeypatch.setattr(resampling, "BYTES", size)
    want = []
    for t in texts:
        w = re.findall(rb"[0-9a-z\x80-\xff]+", t.lower())
        want.append((len(w), sorted(zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, run + 1) for i in range(len(w) - k + 1))))
    found = [(int(n), sorted(crcs[rows == i].tolist())) for _, words, crcs, rows in resampling.runs(pa.array([b"before", *texts]).slice(1), run) for i, n in enumerate(words)]
    assert found == want


def resample_brute(docs, target, percent=10, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = defaultdict(int), defaultdict(int)
    for _, x in docs:
        for w in words(x):
            s[bucket(w)] += 1
    for (x,) in target:
        for w in words(x):
            t[bucket(w)] += 1
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for k, x in docs:
        w = words(x)
        weight = sum(gain[bucket(v)] for v in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted(map(str, map(tuple, rows)))


def test_resampling_matches_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma", "delta7", "straße", "x-y"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(k, t) for k, t, *_ in ODD] + [(400, "Ünï " * 30), (None, "w " * 25)]
    target = [("alpha alpha beta",), (None,), ("",), ("STRAßE x",)]
    found = resampling.resample(clashing(spark.createDataFrame(docs, "doc_id bigint, text string")), spark.createDataFrame(target, "text string")).drop("n_words").collect()
    assert sorted(map(str, map(tuple, found))) == resample_brute(docs, target)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resample(none, none).count() == 0
    assert resampling.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), none).where("rank is not null").count() == sum(1 for _, t in docs if len(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t or "")) >= 20) // 10


def test_ranks_of_ties(spark):
    rows = [(i, i % 4 * 1000 - 5, True, 1) for i in range(97)] + [(1000 + i, 9999, False, 1) for i in range(5)] + [(None, 2995, True, 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, score bigint, drawable boolean, n_features bigint")
    able = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    found = {r.doc_id: r["rank"] for r in resampling.ranked(frame, 50).collect()}
    assert found == {r[0]: None for r in rows} | {r[0]: i + 1 for i, r in enumerate(able[: len(able) // 2])}


# mixing by unequal odds


def test_inclusion_follows_the_odds(spark):
    """3000 sources with 30 documents of the same sizes and odds each, every one a draw of its
    own: of each odds as many copies as intended, whole ones certain, none above three."""
    size, odds = (lambda i: 5 + i % 5), (1.0, 2.0, 5.0)
    rows = [(s * 300 + i, "w " * size(i), "en", f"s{s:05d}", 1) for s in range(3000) for i in range(30)]
    rows += [(10_000_000 + i, "w " * 10, "en", "z", 1) for i in range(10)]  # a small source, which stops at three times its size
    frame = spark.createDataFrame(rows, DOC)
    weight = F.element_at(F.array(*map(F.lit, odds)), (F.col("doc_id") % 3 + 1).cast("int"))
    found = mixing.mix(frame, weight=weight, weights=(1,)).where("source <> 'z'")
    target = found.first().target
    words = [sum(size(i) for i in range(30) if i % 3 == k) for k in range(3)]
    level = target / sum(w * z for w, z in zip(odds, words, strict=True))
    rows = found.groupBy((F.col("doc_id") % 3).alias("k")).agg(F.avg("copies").alias("mean"), F.min("copies").alias("least"), F.max("copies").alias("most")).collect()
    assert len(rows) == 3
    for r in rows:
        copies = level * odds[r.k]
        assert r.mean == pytest.approx(copies, abs=0.02)
        assert (r.least, r.most) == (math.floor(copies), math.ceil(copies))
    assert found.groupBy("source").agg(F.sum("taken").alias("n")).where(F.abs(F.col("n") - target) > 5).count() == 0


def test_classes_fill_the_target(spark):
    rows = [("a", 1.0, 100, 450.0), ("a", 2.0, 50, 450.0), ("b", 1.0, 10, 30.0), ("b", 3.0, 0, 30.0), (None, 2.0, 7, 3.5)]
    found = mixing.classes(spark.createDataFrame(rows, "source string, weight double, z bigint, target double")).collect()
    copies = {(r.source, r.weight): r.copies for r in found}
    assert copies == {("a", 1.0): 3.0, ("a", 2.0): 3.0, ("b", 1.0): 3.0, ("b", 3.0): 0.0, (None, 2.0): 0.5}
    low = mixing.classes(spark.createDataFrame([("a", 1.0, 100, 230.0), ("a", 2.0, 50, 230.0)], "source string, weight double, z bigint, target double")).collect()
    assert {r.weight: r.copies for r in low} == {1.0: pytest.approx(1.15), 2.0: pytest.approx(2.3)}
    capped = mixing.classes(spark.createDataFrame([("a", 1.0, 100, 350.0), ("a", 2.0, 50, 350.0)], "source string, weight double, z bigint, target double")).collect()
    assert {r.weight: r.copies for r in capped} == {1.0: pytest.approx(2.0), 2.0: 3.0}


# versions of a page


@pytest.mark.parametrize("element", ['<article id="post-%d">', '<div id="post-%d">', "<div>", '<article id="a%s">'])
@pytest.mark.parametrize(("pages", "versions"), [(10, 10), (200, 1)])
def test_versions_of_a_page_keep_their_article(spark, element, pages, versions):
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for i in range(pages):
        own = [words(3), *(words(30) for _ in range(3))]
        opened = element % (i if "%d" in element else words(1)) if "%" in element else element
        body = f"{opened}<h1>{own[0]}</h1>" + "".join(f"<p>{p}</p>" for p in own[1:]) + ("</article>" if "article" in element else "</div>")
        for v in range(3 if i < versions else 1):
            want[len(rows)] = own
            rows.append((len(rows), f"http://h.example/p{i}" + ("", "?print=1", "?m=1")[v], f"<html><body><div>Site name</div>{body}<p>served {v}</p><div>All rights kept by us</div></body></html>"))
    found = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all([x for x in found[k] if x in own] == own for k, own in want.items())
    assert all(len(found[k]) <= len(own) + 1 and "All rights kept by us" not in found[k] for k, own in want.items())
