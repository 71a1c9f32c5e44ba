"""The operators against brute force, round trips, held-out accuracy and SQL,
with nulls, empty tables, ties, repeated rows and clashing column names."""

import base64
import hashlib
import itertools
import json
import math
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelake.llm import common, components, html, kneser_ney, language, mixing, quality, queries, sentencepiece, simhash, topk, toxicity, warc

DATA = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "no id here at all", "xx", None, 1), (5, "\x00\n\t  \x0b", "en", "b", 1), (6, "word " * 30000, "de", "b", 150000), (7, "日本語 🙂 straße", "ja", "", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty, very long and repeated texts, and columns whose
    names the operators use themselves."""
    extra = [*((c, F.lit("x")) for c in ("fp", "key", "h", "size", "rank", "score", "page", "host", "_id", "root"))]
    rows = spark.createDataFrame(ODD, DOC)
    for name, value in extra:
        rows = rows.withColumn(name, value)
    return rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def groups(fps, most=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= most:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check_components(rows):
    rows = [r for r in rows if r.doc_id is not None]
    root = groups([int(r.fingerprint, 16) for r in rows])
    least = {}
    for g, r in zip(root, rows, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert [r.component_id for r in rows] == [least[g] for g in root]


def test_simhash_matches_brute_force(docs, odd, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    check_components(rows)
    found = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(odd).collect()}
    assert (1, "0" * 16) in found and (2, "0" * 16) in found and len(simhash.near_duplicates(odd).collect()) == len(ODD)
    assert simhash.near_duplicates(none).count() == 0


def brute_representatives(rows):
    """The smallest (id, null last; fingerprint; text) of each component."""
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    best = {}
    for g, fp, (i, t) in zip(groups(fps), fps, rows, strict=True):
        signed = int(np.uint64(fp).view(np.int64))
        best[g] = min(best.get(g, (True, math.inf, 0, "")), (i is None, i or 0, signed, t or ""))
    return Counter((None if none else i, t) for none, i, _, t in best.values())


def test_simhash_representatives(spark, docs, odd, none):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == brute_representatives([(r[0], r[1]) for r in ODD])
    assert simhash.representatives(none).count() == 0
    one, two = ("a tale of some length that is told of this and that and more " * 3, "quite another matter is spoken of in these few words of mine " * 3)
    # ids that repeat with different texts, copies of them, copies without ids
    rows = [(3, two), (5, one), (5, two), (7, one), (None, one), (9, None), (8, ""), (None, None), (None, "only here, twice and without an id in any of its rows"), (None, "only here, twice and without an id in any of its rows")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit("v")))
    found = simhash.representatives(frame)
    assert found.columns == frame.columns
    assert Counter((r.doc_id, r.text or "") for r in found.collect()) == brute_representatives(rows)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.text or "") for r in simhash.representatives(docs).collect()) == brute_representatives(rows)


def test_bloom(spark):
    from capturelake.llm import common

    rows = spark.range(20000).selectExpr("id * 7919 AS k")
    near = common.Bloom(rows, "k")
    assert rows.where(near(F.col("k"))).count() == 20000
    assert spark.range(20000).selectExpr("id * 7919 + 1 AS k").where(near(F.col("k"))).count() < 400
    nothing = common.Bloom(rows.limit(0), "k")
    assert rows.where(nothing(F.col("k"))).count() == 0 and spark.createDataFrame([(None,)], "k bigint").where(nothing(F.col("k"))).count() == 1


def test_simhash_fingerprint():
    import xxhash

    text = "A b  c\td E f"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(3)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint(text.encode()) == bits


@pytest.mark.parametrize("heavy", [3, 512])
def test_simhash_links_of_crowded_entries(spark, heavy):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base}
    while len(fps) < 60:
        x = base
        for b in rng.choice(64, rng.integers(1, 9), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), heavy)
    stars = {r.u: r.v for r in components.stars(found).collect()}
    mine = [stars.get(x, x) for x in signed]
    want = groups(fps)
    assert len({*zip(mine, want, strict=True)}) == len(set(want)) == len(set(mine))


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that near-duplicates and components write."""
    found = []

    def noted(df, name, written=simhash.written):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(components, "written", noted)
    return found


def test_simhash_broadcasts_nothing_that_grows(spark, docs, plans, monkeypatch):
    """Spark sizes exploded entries as the rows before them, and written tables by their files."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # any table is large
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    plans.append(simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3
    assert not [p for p in plans if "Broadcast" in p]


def test_representatives_broadcast_nothing_that_grows(spark, docs, plans, monkeypatch):
    """Nor does the pipeline's stage, whose own joins are also of one row for each document."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    plans.append(simhash.representatives(docs)._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("most", [0, 100_000])
def test_simhash_broadcasts_few_crowded_entries(spark, plans, monkeypatch, most):
    """Entries to refine and edges are broadcast only if they are few; the links are the same."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    fps = [0, *(1 << a | 1 << b for a in range(64) for b in range(a + 1))]
    found = simhash.links(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp bigint"), 64)
    stars = {r.u: r.v for r in components.stars(found).collect()}
    assert len(stars) == len(fps) - 1 and len(set(stars.values())) == 1
    assert any("Broadcast" in p for p in plans) == (most > 0)


def test_components(spark):
    edges = [(i + 1, i) for i in range(20)] + [(40, 30), (30, 50), (7, 7), (50, 40)]
    stars = {r.u: r.v for r in components.stars(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert stars == {**dict.fromkeys(range(1, 21), 0), 40: 30, 50: 30}
    assert components.stars(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_topk(rows, k):
    vectors = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = set()
    for i, q in vectors:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in vectors if j != i and len(v) == len(q))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize(("block", "queries_"), [(7, 2), (16384, 2048)])
def test_topk_matches_brute_force(spark, block, queries_):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 6) / 64).tolist()) for i in range(60)]
    rows += [(60, [0.0] * 6), (100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [math.nan] * 6), (103, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (104, []), (120, []), (140, []), (160, [2.0]), (161, [-1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("dim", F.lit(3))
    found = topk.search(frame, F.col("vec_id") % 20 == 0, 5, block=block, queries=queries_)
    assert {tuple(r) for r in found.collect()} == brute_topk(rows, 5)
    assert topk.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize(("block", "queries_"), [(7, 2), (16384, 2048)])
def test_topk_keeps_long_vectors(spark, block, queries_):
    """Components of 2**27 and more, scaled: doubles, longs and wider sums; floors above 2**53."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(rng.integers(1, 4096)), *(rng.integers(-4096, 4096, 3) * 1.0).tolist()]) for i in range(30)]
    rows += [(30 + i, [(1 << 24) + float(i % 3), 3e6, -2.5e6, 0.0]) for i in range(15)]
    rows += [(60, [0.0, 0.0, 0.0, 2.0**37]), (61, [2.0**25, -(2.0**25), 0.0, 2.0]), (62, [-(2.0**52), 0.0, 0.0, 0.0]), (63, [0.0, 0.0, 1.0, 0.0])]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = set()
    for i, q in whole:
        if i in (0, 20, 40, 61):
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:5]
            want |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(best)}
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = topk.search(frame, F.col("vec_id").isin(0, 20, 40, 61), 5, block=block, queries=queries_)
    assert {tuple(r) for r in found.collect()} == want
    # a best that does not fit a long is an error, at either end
    for other in (2.0**40, -(2.0**40)):
        pair = spark.createDataFrame([(0, [2.0**40]), (1, [other])], "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match="does not fit a long"):
            topk.search(pair, F.col("vec_id") == 0, 5).collect()


@pytest.mark.parametrize("block", [5, 16384])
def test_topk_ties_and_repeated_ids(spark, block):
    """One vector on most rows: the smaller ids win; ids that repeat are candidates each."""
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 0.0]) for i in range(5)] + [(7, [3.0, 3.0]), (20, [1.0, 2.0]), (7, [3.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = topk.search(frame, F.col("vec_id") % 20 == 0, 6, block=block, queries=3).collect()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = set()
    for i, q in set((i, tuple(v)) for i, v in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:6]
        want |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(best)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, None, None), (8, "http://a b/\r\nX: y", ""), (None, "u", "é" * 300000), (7, "u", "é" * 300000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha", F.lit(1))
    path = f"file://{tmp_path}/archive"
    index = warc.write(pages, path)
    found = warc.read(spark, path).collect()
    assert len(found) == len(rows)
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in found) == Counter(
        (i, "revisit" if i in (5, 9) or i is None else "response", {5: 2, 9: 8, None: 7}.get(i), digest(h), len((h or "").encode())) for i, _, h in rows
    )
    one = warc.lookup(index.where("page_id = 7"), path).first()
    assert bytes(one.payload).decode() == "é" * 300000
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_one_payload_on_most_pages(spark):
    """A payload on most pages meets its first page without being gathered in a task."""
    rows = [(i, f"u{i}", "same" if i % 10 else f"own {i // 20}") for i in range(5000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(8)
    found = warc.roles(pages).withColumn("part", F.spark_partition_id())
    by = Counter(r.part for r in found.select("part").collect())
    assert sum(by.values()) == 5000 and max(by.values()) < 1200
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert all(r.refers_to == (first[rows[r.page_id][2]] if first[rows[r.page_id][2]] != r.page_id else None) for r in found.collect())


def test_bundle_is_seekable():
    import zstandard

    b = warc.Bundle()
    records = {}
    for i in range(300):
        name, data = warc.record(i, f"http://x/{i}", bytes([i % 251]) * 3000, None, False)
        records[name] = data
        b.add(i, name, data)
    data = b.finish()
    table = warc.seek_table(data)
    assert len(table) > 2
    for _, name, _, frame, at, n, start, size in b.index("f"):
        assert (at, n) == table[frame][:2]
        plain = zstandard.ZstdDecompressor().decompress(data[at : at + n])
        assert plain[start : start + size] == records[name]
    # an ordinary reader skips the table and sees all records
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(records.values())


def test_language_held_out(spark, docs, odd, none):
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    made = {(r.doc_id, r.lang_pred, r.score) for r in language.predictions(odd, language.train(docs, F.lit(True))).collect() if r.doc_id in (1, 2, 5)}
    assert made == {(1, "und", 0.0), (2, "und", 0.0), (5, "und", 0.0)}
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.predictions(docs, language.train(none, F.lit(True))).collect()} == {"und"}
    assert language.identify(odd).count() == len(ODD)


def test_language_matches_brute_force(docs):
    """Features counted letter by letter, and the two steps of the decision spelled out."""
    def grams(text):
        c = [ord(x) if x.isalpha() else 0 for x in text.lower()]
        c = [0, *c, 0]
        m = 0xFFFFFFFF
        out = np.zeros(language.SHORT + language.LONG, int)
        for i, x in enumerate(c):
            if x:
                out[(x * 2654435761 & m) >> 21] += 1
            if i + 1 < len(c) and (x or c[i + 1]):
                out[((x * 2246822519 & m) ^ (c[i + 1] * 3266489917 & m)) >> 21] += 1
            if 0 < i < len(c) - 1 and x:
                two = ((c[i - 1] * 2246822519 & m) ^ (x * 3266489917 & m)) * 668265263 & m
                out[language.SHORT + (((two ^ (c[i + 1] * 374761393 & m)) * 2654435761 & m) >> 20)] += 1
        return out

    model = language.train(docs, F.lit(True))
    for r in docs.where("length(text) < 600").limit(25).collect():
        if not any(x.isalpha() for x in r.text):
            continue
        n = grams(r.text)
        assert (language.counts(r.text) == n).all()
        short, long = n[: language.SHORT], n[language.SHORT :]
        x = np.concatenate([np.sqrt(short / max(1, short.sum())), np.sqrt(long / max(1, long.sum())), [1.0]])
        margin = model.w.astype(float) @ x
        p = [1 / (1 + math.exp(-(a * z + b))) for z, (a, b) in zip(margin, model.scale, strict=True)]
        own = max(range(len(model.families)), key=lambda k: p[k]) if len(model.families) > 1 else 0
        members = model.members[model.families[own]]
        wins = Counter()
        for f, a, b, i in model.pairs:
            if f == model.families[own]:
                wins[a if p[i] >= 0.5 else b] += 1
        got, score = model.predict(r.text)
        assert got in members and wins[got] == max(wins.values(), default=0)
        assert 0 <= score <= p[own] / sum(p[: len(model.families)]) + 1e-6


def test_language_ignores_other_columns(docs):
    model = language.train(docs, F.col("doc_id") % 3 != 1)
    a = language.predictions(docs, model).collect()
    b = language.predictions(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")), model).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_toxicity_learns_words(spark, none):
    rng = np.random.default_rng(2)
    plain = ["the", "river", "stone", "and", "cloud", "of", "tree", "light", "wind", "to"]
    rows, labels = [], []
    for i in range(600):
        words = [plain[k] for k in rng.integers(0, len(plain), 60)]
        if i % 5 == 0:
            words[int(rng.integers(60))] = f"grub{['er', 'ling', 'ish'][i % 3]}"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(601, None), (602, ""), (603, "tree " * 40000 + "gruber")]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.detect(docs.withColumn("toxic", F.lit(7)), labels).collect()}
    assert len(found) == len(rows) and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())
    held = [r for r in found.values() if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95
    assert found[603].predicted == 1 and found[601].score == found[602].score
    assert toxicity.detect(docs.limit(0), labels).count() == 0
    assert toxicity.detect(docs, labels.limit(0)).count() == len(rows)


def test_toxicity_network_matches_brute_force():
    """The response to a text, whole and in runs, and the direction of training."""
    rng = np.random.default_rng(7)
    m = toxicity.Model(3)
    m.embedding = rng.normal(0, 1, m.embedding.shape).astype(np.float32)
    ids = rng.integers(0, toxicity.BUCKETS, (2, 90)).astype(np.uint32)

    def slow(ids):
        e = [m.embedding[a] + m.embedding[b + toxicity.BUCKETS] for a, b in ids.T.astype(int)]
        out = float(m.constant)
        for k, (f, b) in enumerate(zip(m.filters, m.bias, strict=True)):
            for q in range(toxicity.FILTERS):
                best = max((sum(float(f[j, :, q] @ e[i + j]) for j in range(len(f))) + float(b[q]) for i in range(len(e) - len(f) + 1)), default=0.0)
                out += max(best, 0.0) * float(m.out[k * toxicity.FILTERS + q])
        return out

    assert m.logit(ids) == pytest.approx(slow(ids), abs=1e-3)
    long = np.tile(rng.integers(0, 500, (2, 1000)), 40).astype(np.uint32)
    assert m.logit(long) == pytest.approx(float(m.forward(long) @ m.out + m.constant), abs=1e-3)
    assert m.logit(ids[:, :0]) == float(m.constant)
    texts, y = [ids, ids[:, :30][:, ::-1]], np.array([1.0, 0.0])
    before = [m.logit(t) for t in texts]
    m.fit(texts, y)
    assert m.logit(texts[0]) - m.logit(texts[1]) > before[0] - before[1]


def test_toxicity_search_matches_forward():
    """Responses to many texts at once, in runs, and the places that give them."""
    rng = np.random.default_rng(11)
    m = toxicity.Model(4)
    m.embedding = rng.normal(0, 1, m.embedding.shape).astype(np.float32)
    m.bias = [rng.normal(0, 1, b.shape).astype(np.float32) for b in m.bias]
    sizes = [0, 1, 2, 3, 50, toxicity.RUN, toxicity.RUN + 1, 2 * toxicity.RUN + 5, 7]
    texts = [rng.integers(0, 3000, (2, n)).astype(np.uint16) for n in sizes]
    pooled, at = m.search(texts, [np.ones(n, np.float32) for n in sizes])
    for i, t in enumerate(texts):
        assert np.allclose(pooled[i], m.forward(t), atol=1e-3)
        for k, (f, b) in enumerate(zip(m.filters, m.bias, strict=True)):
            for c in range(toxicity.FILTERS):
                place = at[i, k * toxicity.FILTERS + c]
                if place < 0:
                    assert pooled[i, k * toxicity.FILTERS + c] == 0
                    continue
                assert place + len(f) <= sizes[i]
                assert (m.embed(t[:, place : place + len(f)]) * f[:, :, c]).sum() + b[c] == pytest.approx(pooled[i, k * toxicity.FILTERS + c], abs=1e-3)
    blank = m.search(texts, [np.zeros(n, np.float32) for n in sizes])[0]
    assert np.allclose(blank[4:], np.maximum(np.concatenate(m.bias), 0)) and not blank[0].any()


def test_toxicity_thresholds_match_brute_force():
    """No cut has less of the share missed plus the weighted share of false alarms."""
    rng = np.random.default_rng(5)
    m = toxicity.Model(6)
    m.embedding = rng.normal(0, 1, m.embedding.shape).astype(np.float32)
    texts = [rng.integers(0, 500, (2, int(n))).astype(np.uint16) for n in rng.integers(5, 60, 400)]
    y = rng.integers(0, 2, 400).astype(float)
    m.languages = toxicity.Languages(texts[:200], [["a", "b"][i % 2] for i in range(200)])
    m.calibrate(texts, y)
    z, langs = np.array([m.logit(t) for t in texts]), np.array([m.languages.guess(t) for t in texts])
    assert set(m.thresholds) == {toxicity.ALL, "a", "b"}

    def cost(use, cut):
        return (z[use & (y == 1)] < cut).mean() + toxicity.FALSE_ALARM * (z[use & (y == 0)] >= cut).mean()

    for lang, cut in m.thresholds.items():
        use = np.ones(400, bool) if lang == toxicity.ALL else langs == lang
        assert cost(use, cut) == pytest.approx(min(cost(use, c) for c in [*z[use], z.max() + 1]), abs=1e-9)
    few = toxicity.Model(6)
    few.calibrate(texts[:4], np.array([1.0, 0, 0, 0]))
    assert few.thresholds == {}


def test_toxicity_odd_rows(spark, docs, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (5, None), (6, 0), (7, 5)], "doc_id bigint, toxic int")
    found = toxicity.detect(odd, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.clean(odd, toxicity.train(odd, labels)).columns == odd.columns
    assert toxicity.clean(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.train(docs.drop("lang"), spark.read.parquet(f"{DATA}/labels.parquet")).languages.names == []


def test_toxicity_languages(docs):
    """Languages are predicted from words alone, as the sample has taught them."""
    rows = [(toxicity.hashed(toxicity.words(r.text)), r.lang) for r in docs.where("text is not null and lang is not null").collect()]
    learnt = toxicity.Languages([t for t, _ in rows[::2]], [v for _, v in rows[::2]])
    rest = [(learnt.guess(t), v) for t, v in rows[1::2] if t.shape[1] > 20]
    assert sum(a == b for a, b in rest) / len(rest) > 0.97
    assert learnt.guess(rows[0][0][:, :0]) == toxicity.OTHER


def paths(e, s):
    known = {e.v.sp.id_to_piece(i): i for i in range(e.v.sp.vocab_size()) if not e.v.sp.is_byte(i)}

    def split(t):
        if not t:
            yield ()
        for j in range(1, len(t) + 1):
            if t[:j] in known:
                yield from ((known[t[:j]], *r) for r in split(t[j:]))

    return list(split(s))


def test_sentencepiece_distribution():
    e = sentencepiece.Encoder(open(sentencepiece.MODEL, "rb").read(), 3)
    every = paths(e, e.v.sp.normalize("there"))
    w = np.array([sum(e.v.score[i] for i in p) for p in every])
    p = np.exp(w - np.logaddexp.reduce(w))
    n = 4000
    found = list(e.sample(["there"] * n, list(range(n))))
    assert all(len({tuple(x[0].tolist()) for x in f}) == 3 for f in found)
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    assert max(abs(first[q] / n - x) for q, x in zip(every, p, strict=True)) < 0.04
    taken = Counter(tuple(x[0].tolist()) for f in found for x in f)
    want = defaultdict(float)
    for order in itertools.permutations(range(len(p)), 3):
        chance, left = 1.0, 1.0
        for j in order:
            chance *= p[j] / left
            left -= p[j]
        for j in order:
            want[every[j]] += chance
    assert max(abs(taken[q] / n - want[q]) for q in every) < 0.04
    assert all(abs(x[1] - math.log(p[every.index(tuple(x[0].tolist()))])) < 1e-9 for f in found[:50] for x in f)
    # inclusion scores weigh a sample to the whole: the expected weighted probability is one
    assert abs(np.mean([sum(math.exp(x[1] - x[3]) for x in f) for f in found]) - 1) < 0.05


@pytest.mark.parametrize("text", ["aꙮb", "ꙮꙮ", "x\U0001f9ffy é"])
def test_sentencepiece_byte_fallback(text):
    """Characters that are no pieces are written as bytes, in every segmentation with its probability."""
    e = sentencepiece.Encoder(open(sentencepiece.MODEL, "rb").read(), 4)
    s = e.v.sp.normalize(text)
    known = {e.v.sp.id_to_piece(i): i for i in range(e.v.sp.vocab_size()) if not e.v.sp.is_byte(i)}

    def split(t):
        if not t:
            yield (), 0.0
        for j in range(1, len(t) + 1):
            if t[:j] in known:
                first, w = (known[t[:j]],), e.v.score[known[t[:j]]]
            elif j == 1:
                data = t[0].encode()
                first, w = tuple(int(e.v.byte[b]) for b in data), e.v.score[e.v.byte[0]] * len(data)
            else:
                continue
            for rest, x in split(t[j:]):
                yield first + rest, w + x

    every = dict(split(s))
    total = np.logaddexp.reduce(list(every.values()))
    n, taken = 1500, Counter()
    for f in e.sample([text] * n, list(range(n))):
        taken[tuple(f[0][0].tolist())] += 1
        assert len({tuple(x[0].tolist()) for x in f}) == min(4, len(every))
        for ids, log, _, _ in f:
            assert log == pytest.approx(every[tuple(ids.tolist())] - total, abs=1e-9) and e.v.decode(ids.tolist()) == text
    assert all(abs(taken[q] / n - math.exp(w - total)) < 0.06 for q, w in every.items())


def test_sentencepiece_round_trip(spark, docs, odd, none):
    rows = sentencepiece.encode(docs.limit(50)).collect()
    assert all(r.round_trip for r in rows) and len(rows) == 200
    again = sentencepiece.encode(docs.limit(50).repartition(7)).collect()
    assert sorted((r.doc_id, r.sample, r.ids_digest) for r in rows) == sorted((r.doc_id, r.sample, r.ids_digest) for r in again)
    strange = sentencepiece.encode(odd)
    assert all(r.round_trip for r in strange.collect())
    assert sorted(r.n_tokens for r in strange.where("doc_id in (1, 2)").collect()) == [0, 0]
    texts = {r.doc_id: r.text for r in docs.limit(50).collect()}
    assert all(r.decoded == texts[r.doc_id] for r in sentencepiece.decode(sentencepiece.encode(docs.limit(50))).collect())
    assert sentencepiece.encode(none).count() == 0


def test_sentencepiece_copies(spark):
    """Rows that repeat id and text have samples of their own, however they are dealt; byte fallback and long parts round-trip."""
    text = "there is a story of thirteen stones and other things that nobody has written down"
    rows = [(1, text)] * 3 + [(2, text), (2, "other words of that id"), (None, text), (None, text), (3, "\x00\u0378\U0001f9ff𐍈 ꙮ"), (4, "a" * 3000 + "—" * 200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("copy", F.lit("x")).withColumn("_row", F.lit(1))
    for parts in (1, 5):
        found = sentencepiece.encode(frame.repartition(parts)).collect()
        assert all(r.round_trip for r in found)
        by = defaultdict(set)
        for r in found:
            by[r.doc_id, r.copy].add(r.ids_digest)
        assert {c for i, c in by if i == 1} == {0, 1, 2} and {c for i, c in by if i is None} == {0, 1} and {c for i, c in by if i == 2} == {0}
        assert len(by[1, 0] | by[1, 1] | by[1, 2]) > 10
        last, first = {(r.doc_id, r.copy, r.sample, r.ids_digest) for r in found}, last if parts > 1 else None
    assert first == last
    made = sentencepiece.decode(spark.createDataFrame([([5, 6], "x"), (None, "y")], "ids array<int>, decoded string"), into="text")
    assert made.columns == ["ids", "decoded", "text"] and [r.text is None for r in made.collect()] == [False, True]
    with pytest.raises(ValueError, match="already"):
        sentencepiece.decode(made)


def test_sentencepiece_query_draws_four(spark):
    rows = queries.QUERIES["op6_sentencepiece"](spark, DATA).collect()
    taken = defaultdict(list)
    for r in rows:
        taken[r.doc_id].append(r.ids_digest)
    assert {r.copy for r in rows} == {0} and all(r.round_trip for r in rows) and max(map(len, taken.values())) == 4
    long = {r.doc_id for r in rows if r.n_tokens > 50}
    assert long and all(len(set(taken[i])) == 4 for i in long)


def kn_brute(rows, order):
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    words = lambda t: [*(t or "").encode().lower().split(), None]
    count, grams = Counter(), Counter()
    for t in train:
        w = words(t)
        count.update(w)
        x = ["<s>"] * (order - 1) + w
        grams.update(tuple(x[i - order + 1 : i + 1]) for i in range(order - 1, len(x)))
    n, v = sum(count.values()), len(count)
    levels, cuts, contexts = {}, {}, {}
    for k in range(order, 0, -1):
        levels[k] = grams
        cuts[k] = kneser_ney._discounts(Counter(grams.values()))
        contexts[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in grams.items():
            contexts[k][g[:-1]][min(c, 3) - 1] += 1
            contexts[k][g[:-1]][3] += c
        lower = Counter()
        for g in grams:
            lower[g[1:]] += 1
        grams = lower

    def p(g, k):
        if k == 0:
            return 1 / (v + 1)
        g = g[-k:]
        below, row, d = p(g, k - 1), contexts[k].get(g[:-1]), cuts[k]
        if row is None:
            return below
        c = levels[k].get(g, 0)
        return (c - (d[min(c, 3) - 1] if c else 0)) / row[3] + sum(a * b for a, b in zip(row, d, strict=False)) / row[3] * below

    out = {}
    for i, t in rows:
        w = words(t)
        x = ["<s>"] * (order - 1) + w
        base = sum(math.log10((count[a] + 0.5) / (n + 0.5 * (v + 1))) for a in w)
        out[i] = (len(w), sum(count[a] > 0 for a in w), n, base, sum(math.log10(p(tuple(x[j - order + 1 : j + 1]), order)) for j in range(order - 1, len(x))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_matches_brute_force(docs, order):
    small = docs.where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(1000, None), (1001, "")]
    extra = small.sparkSession.createDataFrame([(1000, None), (1001, "")], "doc_id bigint, text string")
    found = kneser_ney.evaluate(small.select("doc_id", "text").union(extra).withColumn("c", F.lit(1)), order=order).collect()
    want = kn_brute(rows, order)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_in_pieces(docs, monkeypatch, order):
    """Many shards, and frequent tokens cut into pieces."""
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 160)
    monkeypatch.setattr(kneser_ney, "SHARD_WORDS", 900)
    small = docs.where("doc_id < 40")
    want = kn_brute([(r.doc_id, r.text) for r in small.collect()], order)
    model = kneser_ney.train(small.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1"), order)
    assert len(model.grams) > 5 and len(model.cut) > 3 and max(model.pieces) > 2 and len(model.tokens) > 1 and any(model.bigrams)
    for r in kneser_ney.score(small, model).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score == pytest.approx(want[r.doc_id][4])


def test_packed_arrays():
    from capturelake.llm import arrays

    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    h[1:400] = (h[0] >> np.uint64(32) << np.uint64(32)) | np.arange(1, 400, dtype=np.uint64) << np.uint64(16)  # equal upper halves
    h = np.unique(h)
    c = [rng.integers(0, 300, len(h)), rng.integers(0, 3, len(h))]
    raw = np.frombuffer(b"".join(arrays.pack(h, c) + arrays.pack(h[:0], [c[0][:0]])), np.uint8)
    found = arrays.Packed(raw, 0, 2)
    other = h + (np.uint64(1) << np.uint64(50))
    for got, want in zip(found.find(np.concatenate([h[::-1], other])), c, strict=True):
        assert (got[: len(h)] == want[::-1]).all()
        assert got[len(h) :].sum() == sum(int(dict(zip(h.tolist(), want.tolist(), strict=True)).get(x, 0)) for x in other.tolist())
    assert arrays.Packed(raw, found.end, 1).end == len(raw) and not arrays.Packed(raw, found.end, 1).find(h)[0].any()


def test_kneser_ney_odd_rows(spark, odd, none):
    rows = [(r[0], r[1]) for r in ODD if r[0] not in (None, 3)] + [(3, "one"), (8, "one\x0bTwo\x1cthree"), (11, "word word")]
    want = kn_brute(rows, 3)
    for r in kneser_ney.evaluate(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit("x"))).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.score == pytest.approx(want[r.doc_id][4])
    assert kneser_ney.evaluate(odd).count() == len(ODD)
    assert kneser_ney.evaluate(none).count() == 0


def test_kneser_ney_large_counts(spark):
    docs = spark.createDataFrame([(2, "a b " * 400), (3, "a b c")], "doc_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = kn_brute(rows, 2)
    assert all(r.score == pytest.approx(want[r.doc_id][4]) for r in kneser_ney.evaluate(docs, order=2).collect())


def test_kneser_ney_query_sees_two_tokens_back(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d", "x b e f", "a b c g", "x b e d", "a b e c"] * 3)], "doc_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = kn_brute(rows, 3)
    assert all(r.score == pytest.approx(want[r.doc_id][4]) for r in kneser_ney.evaluate(docs).collect())


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><div class=\"ad\">Buy now</div>%s<aside>More</aside><form><input> Search</form><div id='comments'><p>First!</p></div><footer>&copy; me</footer></body></html>"


def test_html_main_text(spark):
    body = "<article><h1>Title %d</h1><p><b>Some  text &amp;amp; more&nbsp;here %d<br>next<p>Second <a href='x'>link</a>\n line</p><div class=\"ad-box\">no</div></article>"
    rows = [(i, f"http://h.example/{i}", PAGE % (body % (i, i))) for i in range(6)]
    rows += [(10, "http://h.example/x", None), (11, None, "<p>alone</p>"), (12, "http://other", ""), (13, "http://h.example/y", "plain < text"), (13, "http://h.example/y", "plain < text")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("template", F.lit(2))
    found = html.extract(pages).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert texts[3] == "Title 3\nSome text &amp; more here 3 next\nSecond link line"
    assert (texts[10], texts[11], texts[12], texts[13]) == ("", "alone", "", "plain < text")
    assert html.extract(pages.limit(0)).count() == 0


def test_html_template_without_article(spark):
    """Fixed text and links go by what a host's pages share, without any hint in the markup."""
    page = "<html><body><div><p>Welcome to our fine site</p><p><a href='/a'>one</a> <a href='/b'>two</a></p></div><section><p>Story %d is about %s.</p></section><p>All rights kept by us</p></body></html>"
    rows = [(i, f"http://s.example/{i}", page % (i, "abcdefgh"[i])) for i in range(8)]
    found = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in found} == {f"Story {i} is about {'abcdefgh'[i]}." for i in range(8)}
    t = html.templates(spark.createDataFrame(rows, "page_id bigint, url string, html string")).first().template
    assert '"fixed": []' not in t


def test_html_template_within_article(spark):
    """Fixed blocks go from articles too, by what the pages share: an element's own text, a line
    among paragraphs, a list of links; an article without texts of its own is not the main text."""
    page = "<html><body><article><h1>Title %d</h1><p>Story %d.</p><p>Write to us for more</p><div class='box'>Buy our book</div><ul><li><a href='/%d'>See %d</a></li></ul></article></body></html>"
    husk = "<html><body><main><p>Loved by all</p></main><div><p>Story %d.</p></div></body></html>"
    rows = [(i, f"http://a.example/{i}", page % (i, i, i, i)) for i in range(12)] + [(20 + i, f"http://b.example/{i}", husk % i) for i in range(5)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {**{i: f"Title {i}\nStory {i}." for i in range(12)}, **{20 + i: f"Story {i}." for i in range(5)}}


def test_html_main_element_by_template(spark, monkeypatch):
    """Without an article or a telling name, the element with the most varying text is the
    main one, with the heading beside it; a smaller box of varying text is not."""
    page = "<html><body><div class='x1'><p>Poll %d of the day</p><div>%d votes so far</div></div><div class='x2'><h1>Title %d</h1><div class='x3'>%s</div></div><p>%d readers were here</p></body></html>"
    rows = [(i, f"http://x.example/{i}", page % (i, i * 7, i, "".join(f"<p>Part {k} of the long story of number {i}.</p>" for k in range(3 + i % 4)), i * 13)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {i: "\n".join([f"Title {i}", *(f"Part {k} of the long story of number {i}." for k in range(3 + i % 4))]) for i in range(12)}
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want
    whole = html.templates
    monkeypatch.setattr(html, "templates", lambda *a: whole(*a).where("false"))
    assert all("Poll" in r.text for r in html.extract(pages).collect())


def test_html_template_of_layouts(spark, monkeypatch):
    """Layouts on a third of a host's pages each have classes of their own, also in parts."""
    page = "<html><body><div class='%s'><p>Fine %s offers</p><section><p>Story %d.</p></section><p>Made with care, %s</p></div></body></html>"
    rows = [(i, f"http://l.example/{i}", page % (k, k, i, k)) for i in range(24) for k in ["abc"[i % 3]]]
    # one page in four has the line of its section among paragraphs
    flat = "<html><body><p>Story %d.</p><p>From the desk of %s</p><p>Sent by %s</p></body></html>"
    rows += [(100 + i, f"http://m.example/{i}", flat % (i, k, k)) for i in range(48) for k in ["wxyz"[i % 4]]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {i: f"Story {i % 100}." for i, _, _ in rows}
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want
    monkeypatch.setattr(html, "PART_ROWS", 3)
    assert html.templates(pages).count() > 2
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


def test_html_survives_bad_markup():
    for bad in ("<p", "<a href=\"x", "<!-- open", "<script>no end", "<" * 5000, "<div " + "a='" * 3000, "</p></p>", "<li><li><p><li>"):
        html.blocks(bad)


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<p class=", "<!-- ", "<script>", "<div>", "</", "<div class='x", "<a '>\"", "<li><p>", "<script ", "&lt", "<p>a<ul>", "class  "])
@pytest.mark.parametrize("end", ["", ">", "-->", "</script>"])
def test_html_reads_hostile_pages_once(unit, end):
    began = time.process_time()
    html.blocks(unit * (1_000_000 // len(unit)) + end)
    assert time.process_time() - began < 8


def test_html_unclosed_ends():
    texts = lambda s: [t for _, t, _ in html.blocks(s)[0]]
    assert texts("<p>a</p>b < c") == ["a", "b < c"]
    assert texts("<p>a</p>b <!-- c") == ["a", "b"] and texts("<!-- c") == [] and texts("a <!-- b > c") == ["a"]
    assert texts("<p>a<script>b > c") == ["a"] and texts("a<script>b</script>c") == ["ac"] and texts("<p>x<b") == ["x<b"]
    deep = html.blocks("<div>" * 5000 + "in" + "</div>" * 5000 + "<p>out</p>")[0]
    assert [t for _, t, _ in deep] == ["in", "out"]


def html_classes(pages, host):
    """Equivalence classes by whole occurrence vectors."""
    seen = {}
    for k, page in enumerate(pages):
        found, paths = html.blocks(page)
        for token, n in [*Counter(("text", p, t) for p, t, _ in found).items(), *((("path", p), n) for p, n in paths.items())]:
            seen.setdefault(token, {})[k] = n
    by = defaultdict(set)
    for token, vector in seen.items():
        if len(vector) >= html.LEAST_PAGES:
            by[tuple(sorted(vector.items()))].add(token)
    return [c for c in by.values() if len(c) >= html.LEAST_TOKENS]


def test_html_classes_match_brute_force(spark):
    """The texts that a template holds are those of the classes of whole vectors,
    where these alone decide: each path has one text, and it is on half of the pages."""
    page = "<html><body><header>Top %s</header><div class='a'>%s</div><div class='b'>%s</div><p>%s</p><div class='c'>End</div></body></html>"
    rng = np.random.default_rng(5)
    pages = sorted({page % (i % 2, "xy"[int(rng.integers(2))], "one" if rng.integers(3) else "two", f"Text {i}") for i in range(40)})
    rows = [(i, f"http://c.example/{i}", p) for i, p in enumerate(pages)]
    t = [r.template for r in html.templates(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    fixed = {x for r in t for x in json.loads(r)["fixed"]}
    classes = html_classes(pages, "c.example")
    member = {html.text_token(token[1], token[2]) for c in classes for token in c if token[0] == "text"}
    assert html.text_token("/html/body/div.c", "End") in fixed and fixed <= member
    count = Counter((p, x) for q in pages for p, x, _ in html.blocks(q)[0])
    half = {html.text_token(p, x) for (p, x), n in count.items() if 2 * n >= len(pages)}
    assert {x for x in member if x in half} <= fixed


def run_sql(tables, sql):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    rows = con.execute(sql)
    return [d[0] for d in rows.description], rows.fetchall()


def same(a, b):
    key = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    return Counter(map(key, a)) == Counter(map(key, b))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    names, want = run_sql({t: f"{DATA}/{t}.parquet" for t in ("documents", "pages", "embeddings", "benchmark", "clicks")}, queries.ORACLE_SQL[name])
    rows = queries.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(rows.columns)
    assert same(rows.select(*names).collect(), want)


@pytest.mark.parametrize("name", ["op9_source_mix", "op10_quality_rules"])
def test_odd_rows_equal_sql(spark, odd, tmp_path, name):
    plain = odd.where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars")
    plain.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    names, want = run_sql({"documents": f"{tmp_path}/documents.parquet/*.parquet"}, queries.ORACLE_SQL[name])
    assert same(queries.QUERIES[name](spark, str(tmp_path)).select(*names).collect(), want)


@pytest.mark.parametrize("kind", ["one", "capped", "tight"])
def test_mixing_of_few_sources(spark, tmp_path, monkeypatch, kind):
    """One source; a source at its cap; one with nearly a whole copy more.  No group of the last step is large."""
    sources = {"one": lambda i: "a", "capped": lambda i: "a" if i < 100 else "b", "tight": lambda i: "ab"[i % 2]}[kind]
    rows = [(i, "w " * (1 + i % 7), "en", sources(i), 1) for i in range(4000)]
    frame = spark.createDataFrame(rows, DOC)
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(mixing, "FEW", 50)
    sizes = []
    boundary = mixing._boundary
    monkeypatch.setattr(mixing, "_boundary", lambda *a: (sizes.append(boundary(*a)), sizes[-1])[1])
    names, want = run_sql({"documents": f"{tmp_path}/documents.parquet/*.parquet"}, queries.ORACLE_SQL["op9_source_mix"])
    assert same(queries.QUERIES["op9_source_mix"](spark, str(tmp_path)).select(*names).collect(), want)
    assert all(r.n <= 50 for r in sizes[-1].collect())


def test_mixing_targets(spark, odd, none):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 0)], "source string, source_size bigint")
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert found["a"] == 30 and found["c"] == 0 and sum(found.values()) == pytest.approx(1510)
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).count() == len(ODD)
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() == mixing.mix(odd).agg(F.sum("copies")).first()[0]
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (odd, odd.repartition(5)))
    assert a == b


def test_quality_verdicts(odd, none, docs):
    assert quality.verdicts(none).count() == 0
    assert quality.verdicts(odd).count() == len(ODD)
    plan = quality.verdicts(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert not any(isinstance(v, dict) for v in vars(quality).values() if not isinstance(v, type(vars(quality)["__builtins__"])))
    # a language of few documents is judged by all documents' reference
    rare = docs.where("doc_id < 5").withColumn("lang", F.lit("zz")).withColumn("text", F.repeat(F.lit("QXZ #7 %% "), 60).cast("string")).withColumn("text", F.concat("text", F.col("doc_id").cast("string"), F.repeat(F.lit(" Y5$"), 30)))
    found = quality.verdicts(docs.union(rare)).where("lang = 'zz'").collect()
    assert len(found) == 5 and all(r.class_distance is not None and r.word_distance is not None and not r.kept for r in found)
    caps = docs.where("lang = 'en'").withColumn("text", F.upper("text")).withColumn("doc_id", F.col("doc_id") + 100000).limit(5)
    found = quality.verdicts(docs.union(caps)).where("doc_id >= 100000 and n_words > 60").collect()
    assert found and not any(r.kept for r in found)


def test_pipeline(spark):
    import corpus_pipeline as p

    before = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = before
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, DATA), name)
        assert docs.columns == before.columns
    rows = p.run(spark, DATA).collect()
    assert rows and all(r.round_trip for r in rows)
    assert Counter(r.doc_id for r in rows if r.sample == 0) == Counter(r.doc_id for r in docs.collect())
    # a document that is taken several times has samples of its own each time
    again = Counter(r.doc_id for r in rows if r.sample == 0).most_common(1)[0]
    own = [r for r in rows if r.doc_id == again[0]]
    assert again[1] > 1 and {r.copy for r in own} == set(range(again[1]))


@pytest.mark.parametrize("name", ["odd", "none"])
def test_pipeline_stages_on_odd_rows(spark, odd, none, name, tmp_path):
    """Nulls, repeated and very long rows, clashing names, an empty table: a result of the same columns."""
    import corpus_pipeline as p

    docs = {"odd": odd, "none": none}[name]
    spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for step, stage in p.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        rows = found.collect()
        assert len(rows) <= docs.count() * 3
        found = p.written(found, step)
        if rows:
            docs = found
    assert all(r.round_trip for r in p.STAGES[-1][1](spark, docs, str(tmp_path)).collect())
