"""Language identification by hierarchical discrimination.

First the language family is predicted, one linear support vector machine
against the rest for each; then one-versus-one machines separate the languages
within that family.  The features are hashed character n-grams (one to three
letters, word ends marked) of the whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import bucket, map_batches, spread
from capturelake.llm.linear import sigmoid, slope, svm

# Families of related languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "mr", "ne", "gu", "pa", "ur"],
    "semitic": ["ar", "he", "am"],
}
#: Labelled texts learnt from, over all languages; at most an equal share of each.
SAMPLE = 4000
#: Hashed features: of one and two letters, and of three.
SHORT, LONG = 2048, 4096
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000 >> 4)])


_TABLE: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, zero for anything else."""
    if not _TABLE:
        _TABLE.append(_letters())
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)])
    known = codes < len(_TABLE[0])
    letter = np.zeros(len(codes), bool)
    letter[known] = _TABLE[0][codes[known]]
    for c in np.unique(codes[~known]):
        letter |= (codes == c) & (chr(c).isalpha())
    return np.where(letter, codes, 0).astype(np.uint32)


def counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams; None if the text has no letter."""
    c = _codes(text)
    if not c.any():
        return None
    with np.errstate(over="ignore"):
        one = (c * np.uint32(2654435761)) >> np.uint32(21)
        a, b, d = c[:-2], c[1:-1], c[2:]
        two = ((c[:-1] * np.uint32(2246822519)) ^ (c[1:] * np.uint32(3266489917))) >> np.uint32(21)
        three = (((a * np.uint32(2246822519)) ^ (b * np.uint32(3266489917))) * np.uint32(668265263) ^ (d * np.uint32(374761393))) * np.uint32(2654435761) >> np.uint32(20)
    short = np.bincount(one[c > 0], minlength=SHORT) + np.bincount(two[(c[:-1] > 0) | (c[1:] > 0)], minlength=SHORT)
    long = np.bincount(three[b > 0], minlength=LONG)
    return np.concatenate([short, long])


def features(count: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each length, so that both parts weigh the
    same for any length of text; a constant is the bias."""
    short, long = count[:SHORT], count[SHORT:]
    return np.concatenate([np.sqrt(short / max(1, short.sum())), np.sqrt(long / max(1, long.sum())), [1.0]]).astype(np.float32)


def family(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang.lower().split("-")[0].split("_")[0] in v), lang)


class Model:
    """The learned families, and the machines of each."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        of = np.array([family(v) for v in langs])
        langs = np.array(langs, dtype=object)
        self.members = {f: sorted({v for v, k in zip(langs, of, strict=True) if k == f}) for f in sorted(set(of))}
        self.families = list(self.members)
        rows, self.scale, self.pairs = [], [], []
        if len(self.families) > 1:
            for f in self.families:
                self._fit(rows, x, np.where(of == f, 1.0, -1.0))
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                use = (langs == a) | (langs == b)
                self.pairs.append((f, a, b, len(rows)))
                self._fit(rows, x[use], np.where(langs[use] == a, 1.0, -1.0))
        self.w = np.stack(rows) if rows else np.zeros((0, x.shape[1]), np.float32)

    def _fit(self, rows: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> None:
        w = svm(x, y)
        rows.append(w)
        self.scale.append(slope(x @ w, (y > 0).astype(float)))

    def predict(self, text: str | None) -> tuple[str, float]:
        count = counts(text) if text else None
        if count is None or not self.families:
            return UNDETERMINED, 0.0
        p = [float(sigmoid(a * m + b)) for m, (a, b) in zip(self.w @ features(count), self.scale, strict=True)]
        best, share = self.families[0], 1.0
        if len(self.families) > 1:
            k = int(np.argmax(p[: len(self.families)]))
            best, share = self.families[k], p[k] / max(1e-12, sum(p[: len(self.families)]))
        votes = dict.fromkeys(self.members[best], 0.0)
        for f, a, b, i in self.pairs:
            if f == best:
                votes[a if p[i] >= 0.5 else b] += 1 + abs(p[i] - 0.5) / len(votes)
        winner = max(votes, key=votes.get)
        against = [p[i] if a == winner else 1 - p[i] for f, a, b, i in self.pairs if f == best and winner in (a, b)]
        return winner, min(1.0, share * min(against, default=1.0))


def train(docs: DataFrame, labelled: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` of the rows where ``labelled`` holds and
    neither text nor language is null: the same number of each language, if it
    has so many, chosen by a hash of the id.  Only counts and the features of
    the sample reach the driver."""
    rows = docs.where(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang).cast("string")).count().collect()}
    if not sizes:
        return Model(np.zeros((0, SHORT + LONG + 1), np.float32), [])
    each = max(1, sample // len(sizes))
    limits = [(k, int(min(1.0, each / n) * ((1 << 62) - 1))) for k, n in sorted(sizes.items())]
    limit = F.element_at(F.create_map(*(F.lit(v) for pair in limits for v in pair)), F.col(lang).cast("string"))
    rows = rows.where(spread(doc_id, "lang") <= limit).select(F.col(doc_id).cast("long"), F.col(lang).cast("string"), F.col(text).cast("string"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, langs, found = [], [], []
        for i, v, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (c := counts(t)) is not None:
                at = np.flatnonzero(c)
                ids.append(i)
                langs.append(v)
                found.append(np.stack([at, c[at]]).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["doc_id", "lang", "found"])

    got = sorted(map(tuple, map_batches(rows, run, "doc_id long, lang string, found binary").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], bytes(r[2])))
    x = np.zeros((len(got), SHORT + LONG + 1), np.float32)
    for k, (_, _, found) in enumerate(got):
        at, c = np.frombuffer(found, np.uint32).reshape(2, -1)
        full = np.zeros(SHORT + LONG, np.int64)
        full[at] = c
        x[k] = features(full)
    return Model(x, [r[1] for r in got])


def predictions(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    A text that is null, empty or without a letter is ``und`` with score 0,
    and so is every text if nothing could be learnt.  Repeated rows each give
    a row; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [model.predict(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")), run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = 0.0, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is determined
    with a score of at least ``least``."""
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [model.predict(t) for t in batch.column(at).to_pylist()]
        yield batch.filter(pa.array([f[0] != UNDETERMINED and f[1] >= least for f in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learnt from the
    documents that are not held out."""
    model = train(docs, bucket("doc_id", folds) != held_out)
    found = predictions(docs, model)
    return found.select("doc_id", (bucket("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")
