"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed ones, of the word and of its first
five bytes.  Filters one, two and three words wide run over the whole text;
each filter's greatest response, after a rectifier, goes to a logistic layer.
The score is shifted by a threshold for the text's language, so that 0.5 is
where a calibration part of the labelled texts is divided best.  The language
is predicted from the text's words, by what the sample's languages taught.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import bucket, map_batches, spread
from capturelake.llm.linear import sigmoid

#: Labelled texts learnt from, at most half of each class if there are so many.
SAMPLE = 6000
#: Of the labelled texts one in this many calibrates the thresholds.
CALIBRATION = 5
BUCKETS, DIM, WIDTHS, FILTERS, PREFIX = 1 << 16, 8, (1, 2, 3), 16, 5
#: Readings of the sample in training, or as many as make STEPS steps of BATCH texts.
EPOCHS, STEPS, BATCH = 20, 600, 32
#: The share of words that a step does not see, and what pulls embeddings to zero.
DROP, SHRINK = 0.5, 1e-3
#: Words that training and scoring read at once.
RUN = 1 << 15
#: What a false alarm weighs beside a toxic text that is missed.
FALSE_ALARM = 3.0

OTHER, ALL = "other", "all"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The runs of letters of the whole text, in lower case."""
    return (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()


def hashed(found: list[bytes]) -> np.ndarray:
    """Two rows: the buckets of the words, and of their first bytes."""
    n = len(found)
    whole = np.fromiter(map(zlib.crc32, found), np.uint32, n)
    start = np.fromiter((zlib.crc32(w[:PREFIX], 7) for w in found), np.uint32, n)
    return np.stack([whole, start]) % np.uint32(BUCKETS)


class Languages:
    """Predicts a text's language by naive Bayes over its words' buckets, learnt
    from texts whose language is known; ``other`` without words, or if no
    language is."""

    def __init__(self, texts: list[np.ndarray], langs: list[str | None]) -> None:
        self.names = sorted({v for v in langs if v is not None})
        counts = np.zeros((len(self.names), BUCKETS))
        for ids, v in zip(texts, langs, strict=True):
            if v is not None:
                counts[self.names.index(v)] += np.bincount(ids[0], minlength=BUCKETS)
        self.log = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).T.astype(np.float32)

    def guess(self, ids: np.ndarray) -> str:
        if not self.names or not ids.shape[1]:
            return OTHER
        return self.names[int(self.log[ids[0]].sum(axis=0, dtype=np.float64).argmax())]


def _runs(n: int) -> list[tuple[int, int]]:
    """Where ``n`` words are cut: runs that overlap by the filters' width."""
    overlap = max(WIDTHS) - 1
    return [(a, min(n, a + RUN)) for a in range(0, max(min(n, 1), n - overlap), RUN - overlap)]


class Model:
    """Embeddings begin close to zero and filters do not, a fourth of them with
    a negative weight in the logistic layer; training does the rest."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.01, (2 * BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.where(np.arange(len(WIDTHS) * FILTERS) % 4 == 3, -0.1, 0.1).astype(np.float32)
        self.constant = np.float32(0)
        self.languages = Languages([], [])
        self.thresholds: dict[str, float] = {}

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.embedding[ids[0]] + self.embedding[ids[1].astype(np.int64) + BUCKETS]

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """The pooled responses to a text."""
        e = self.embed(ids)
        pooled = np.zeros(len(self.out), np.float32)
        for k, (f, b) in enumerate(zip(self.filters, self.bias, strict=True)):
            n = len(e) - len(f) + 1
            if n <= 0:
                continue
            r = e[:n] @ f[0]
            for j in range(1, len(f)):
                r += e[j : j + n] @ f[j]
            pooled[k * FILTERS : (k + 1) * FILTERS] = np.maximum(r.max(axis=0) + b, 0)
        return pooled

    def logit(self, ids: np.ndarray) -> float:
        """A long text is read in runs that overlap by the filters' width; the
        greatest response of any run counts."""
        pooled = np.zeros(len(self.out), np.float32)
        for a, b in _runs(ids.shape[1]):
            pooled = np.maximum(pooled, self.forward(ids[:, a:b]))
        return float(pooled @ self.out + self.constant)

    def search(self, texts: list[np.ndarray], keep: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, of whose words those with a zero in ``keep`` are blank,
        the pooled responses and where they are, -1 for those that are zero."""
        best, at = np.full((len(texts), len(self.out)), -np.inf, np.float32), np.zeros((len(texts), len(self.out)), np.int64)
        group: list[tuple[int, int, int]] = []
        for i, t in enumerate(texts):
            for a, b in _runs(t.shape[1]):
                if group and sum(y - x for _, x, y in group) + b - a > RUN:
                    self._search(texts, keep, group, best, at)
                    group = []
                group.append((i, a, b))
        if group:
            self._search(texts, keep, group, best, at)
        top = best + np.concatenate(self.bias)
        return np.maximum(top, 0), np.where(top > 0, at, -1)

    def _search(self, texts: list[np.ndarray], keep: list[np.ndarray], group: list[tuple[int, int, int]], best: np.ndarray, at: np.ndarray) -> None:
        e = self.embed(np.concatenate([texts[i][:, a:b] for i, a, b in group], axis=1)) * np.concatenate([keep[i][a:b] for i, a, b in group])[:, None]
        length = np.array([b - a for _, a, b in group])
        first, part = np.cumsum(length) - length, np.repeat(np.arange(len(group)), length)
        place = np.arange(len(part)) - first[part]
        for k, f in enumerate(self.filters):
            r, n = np.full((len(e), FILTERS), -np.inf, np.float32), len(e) - len(f) + 1
            if n > 0:
                r[:n] = sum(e[j : j + n] @ f[j] for j in range(len(f)))
            r[place + len(f) > length[part]] = -np.inf
            top = np.maximum.reduceat(r, first, axis=0)
            row, c = np.nonzero(r == top[part])
            where = np.zeros(top.shape, np.int64)
            where[part[row[::-1]], c[::-1]] = place[row[::-1]]  # the first of equal ones
            q = slice(k * FILTERS, (k + 1) * FILTERS)
            for g, (i, a, _) in enumerate(group):
                more = top[g] > best[i, q]
                best[i, q], at[i, q] = np.where(more, top[g], best[i, q]), np.where(more, a + where[g], at[i, q])

    def fit(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 2) -> None:
        """Adagrad on the logistic loss, classes weighted to the same total.  Each
        step leaves out other words, so that no single one has to be there."""
        rng, rate, decay = np.random.default_rng(seed), 0.1, 1e-5
        weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y == 0).sum())))
        dense = [*self.filters, *self.bias, self.out]
        seen = [np.full_like(p, 0.1) for p in dense]
        seen_e, seen_c = np.full(len(self.embedding), 0.1, np.float32), 0.1
        for _ in range(max(EPOCHS, -(-STEPS // max(1, -(-len(y) // BATCH))))):
            order = rng.permutation(len(y))
            for start in range(0, len(y), BATCH):
                use = order[start : start + BATCH]
                batch = [texts[i] for i in use]
                keep = [(rng.random(t.shape[1], np.float32) >= DROP).astype(np.float32) for t in batch]
                pooled, at = self.search(batch, keep)
                words_, kept = np.concatenate(batch, axis=1), np.concatenate(keep)
                first = np.cumsum([0, *(len(v) for v in keep[:-1])])
                g = (weight[use] * (sigmoid((pooled @ self.out + self.constant).astype(float)) - y[use]) / BATCH).astype(np.float32)
                grads, rows, steps, grad_c = [np.zeros_like(p) for p in dense], [], [], float(g.sum())
                grads[-1] += g @ pooled
                for k, f in enumerate(self.filters):
                    i, c = np.nonzero(at[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
                    if not len(i):
                        continue
                    places, up = first[i] + at[i, k * FILTERS + c], g[i] * self.out[k * FILTERS + c]
                    np.add.at(grads[len(WIDTHS) + k], c, up)
                    for j in range(len(f)):
                        ids, own = words_[:, places + j], up * kept[places + j]
                        np.add.at(grads[k][j].T, c, own[:, None] * self.embed(ids))
                        rows += [ids[0].astype(np.int64), ids[1].astype(np.int64) + BUCKETS]
                        steps += [own[:, None] * f[j][:, c].T] * 2
                for p, s, d in zip(dense, seen, grads, strict=True):
                    d = d + decay * p
                    s += d * d
                    p -= rate * d / np.sqrt(s)
                seen_c += grad_c * grad_c
                self.constant = np.float32(self.constant - rate * grad_c / np.sqrt(seen_c))
                if rows:
                    unique, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                    total = SHRINK * self.embedding[unique]
                    np.add.at(total, inverse, np.concatenate(steps))
                    seen_e[unique] += (total * total).mean(axis=1)
                    self.embedding[unique] -= np.float32(rate) * total / np.sqrt(seen_e[unique])[:, None]

    def calibrate(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """For each predicted language the logit that divides its texts with the
        least of the share missed plus FALSE_ALARM times the share of false
        alarms, in the middle between two texts.  Languages with fewer than ten texts of a class have
        the logit of all texts together; that is 0 where these are too few."""
        logits, langs = np.array([self.logit(t) for t in texts]), [self.languages.guess(t) for t in texts]
        for lang in [ALL, *sorted(set(langs))]:
            use = np.array([lang in (v, ALL) for v in langs], bool)
            z, t = logits[use], y[use]
            if min(t.sum(), (1 - t).sum()) < (3 if lang == ALL else 10):
                continue
            order = np.argsort(z, kind="stable")
            z, t = z[order], t[order]
            missed = np.concatenate([[0], np.cumsum(t) / t.sum()])
            alarms = np.concatenate([np.cumsum((1 - t)[::-1])[::-1] / (1 - t).sum(), [0]])
            wrong = missed + FALSE_ALARM * alarms
            cuts = np.flatnonzero(wrong <= wrong.min() + 1e-12)
            k = int(cuts[len(cuts) // 2])
            low, high = z[max(0, k - 1)], z[min(len(z) - 1, k)]
            self.thresholds[lang] = float((low + high) / 2)

    def score(self, text: str | None) -> float:
        ids = hashed(words(text))
        return float(sigmoid(self.logit(ids) - self.thresholds.get(self.languages.guess(ids), self.thresholds.get(ALL, 0.0))))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", lang: str = "lang", allowed: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` labelled rows, chosen by a hash of the id.
    Their column ``lang``, if there is one, teaches which language a text is in.

    ``labels`` has an id and a label, 0 or 1; rows with a null in either are
    not labels, and of several labels of an id the greatest counts.  Only
    hashed words of the sample reach the driver.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max(toxic).cast("int").alias("_toxic"))
    if allowed is not None:
        known = known.where(allowed)
    sizes = {r[0]: r[1] for r in known.groupBy("_toxic").count().collect()}
    limit = F.lit(0)
    for label, n in sizes.items():
        limit = F.when(F.col("_toxic") == label, F.lit(int(min(1.0, sample / 2 / n) * ((1 << 62) - 1)))).otherwise(limit)
    known = known.where(spread("_id", "toxic") <= limit)
    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"), (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("_lang"))
    rows = own.join(F.broadcast(known), "_id").select("_id", "_toxic", "_text", "_lang")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [hashed(words(t)).astype(np.uint16).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.binary())], ["id", "y", "lang", "ids"])

    got = sorted(map(tuple, map_batches(rows, run, "id long, y int, lang string, ids binary").collect()), key=lambda r: (r[0], r[1], bytes(r[3])))
    model = Model()
    texts = [np.frombuffer(r[3], np.uint16).reshape(2, -1) for r in got]
    y = np.array([r[1] for r in got], float)
    part = np.array([zlib.crc32(f"part {r[0]}".encode()) % CALIBRATION == 0 for r in got], bool)
    if 0 < y.sum() < len(y):
        use = np.flatnonzero(~part)
        model.languages = Languages([texts[i] for i in use], [got[i][2] for i in use])
        model.fit([texts[i] for i in use], y[use])
        rest = np.flatnonzero(part)
        model.calibrate([texts[i] for i in rest], y[rest])
    return model


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, from its whole text alone.

    Null and empty texts score what a text without words does.  Repeated rows
    each give a row; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.array([model.score(t) for t in batch.column(1).to_pylist()], float)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")), run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that score under 0.5."""
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array([model.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def detect(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from the
    labels of documents that are not held out."""
    model = train(docs, labels, allowed=bucket("_id", folds) != held_out)
    found = scores(docs, model)
    return found.select("doc_id", (bucket("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")
