"""Importance resampling towards a target: documents whose hashed words are
likelier in a target corpus than in the raw one are drawn more often.

A batch's UTF-8 buffer is read as bytes: a table of 256 classes tells which
belong to words, differences of that where words begin and end, and the CRC-32
of all runs of words advances byte by byte for all of them at once, by a
table of 256 states.  A bucket's gain is the log ratio of its smoothed
frequencies; a document's score is its mean gain plus a Gumbel number of its
id, so that the greatest scores are a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import bounded, map_batches, release, text_column, written

#: Buckets of the hash, longest run of words, share that is drawn, words that a
#: document needs to be drawn, and what ids are hashed with.
BUCKETS, RUN, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, "2024"
#: Bytes of texts that are worked on at once, and bytes of a word after which
#: the few longer ones are finished one by one.
BYTES, LONG = 4 << 20, 64
#: Scores of which the histogram has a part of its own.
SPAN = 256

_byte = np.arange(256)
#: What A-Z become, and which bytes are in words: digits, letters, all beyond ASCII.
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 0x20, _byte).astype(np.uint8)
IS_WORD = ((LOWER >= 0x30) & (LOWER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (LOWER >= 0x80)


def _crc_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, state >> 1 ^ np.uint32(0xEDB88320), state >> 1)
    return state.astype(np.uint32)


_STEP = _crc_table()


def _advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after ``size`` bytes of ``data`` from ``start``, all at once."""
    order = np.argsort(-np.minimum(size, LONG), kind="stable")
    out, at = state[order], start[order]
    left = size[order]
    on = np.searchsorted(-left, -np.arange(min(int(left.max(initial=0)), LONG)), side="left")  # how many are longer than i bytes
    for i, n in enumerate(on.tolist()):
        now = out[:n]
        out[:n] = _STEP[(now ^ data[at[:n] + i]) & 0xFF] ^ (now >> np.uint32(8))
    for j in np.flatnonzero(left > LONG).tolist():
        rest = data[at[j] + LONG : at[j] + left[j]].tobytes()
        out[j] = zlib.crc32(rest, int(out[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    done = np.empty_like(out)
    done[order] = out
    return done


def runs(column: pa.Array, run: int = RUN) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of pieces of a binary column: the first row, the words of each row, the
    CRC-32 of every run of 1 to ``run`` words, and the row of each."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BYTES, side="right")) - 1)
        edge = offsets[first : last + 1] - offsets[first]
        data = LOWER[whole[offsets[first] : offsets[last]]]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = IS_WORD[data]
        turn = np.diff(inside)
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        # a word ends where its text does, and the next text's begins there
        cut = np.unique(edge[1:-1])
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        of = np.searchsorted(edge, start, side="right") - 1
        words = np.bincount(of, minlength=last - first)
        state = _advance(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, end - start)
        crcs, rows, at = [state ^ np.uint32(0xFFFFFFFF)], [of], np.arange(len(start))
        for k in range(1, run):
            more = at + k < len(start)
            more[more] = of[at[more] + k] == of[at[more]]
            at, state = at[more], state[more]
            state = _STEP[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> np.uint32(8))
            state = _advance(state, data, start[at + k], (end - start)[at + k])
            crcs.append(state ^ np.uint32(0xFFFFFFFF))
            rows.append(of[at])
        yield first, words, np.concatenate(crcs), np.concatenate(rows)
        first = last


def histogram(texts: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: a task sums its own
    before anything is moved, and ``buckets`` sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crcs, _ in runs(batch.column(0), run):
                sums += np.bincount(crcs % buckets, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])
        release()

    rows = bounded(texts).select(text_column(text).alias("text")).mapInArrow(count, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floor(1000 * ln) of the ratio of its two smoothed frequencies."""
    n, all_source, all_target = len(source), float(int(source.sum()) + len(source)), float(int(target.sum()) + len(target))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * all_source / ((float(source[b]) + 1) * all_target))) for b in range(n)], np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """A Gumbel number of the id, times 1000 and floored; a null id has that of ''."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of every
    row's features, 0 if it has none."""

    def weigh(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, words, crcs, rows in runs(batch.column(1), run):
            n = np.bincount(rows, minlength=len(words))
            order = np.argsort(rows, kind="stable") if run > 1 else slice(None)
            total = np.concatenate([[0], np.cumsum(gain[crcs[order] % len(gain)])])
            end = np.cumsum(n)
            weight = (total[end] - total[end - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(words)), *(pa.array(x.astype(np.int64)) for x in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text"))
    return map_batches(chosen, weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``rows`` (doc_id, score, drawable and more) with ``rank``: 1, 2, 3 ... for
    the floor(percent * n / 100) greatest scores of the n drawable rows, ties to
    smaller ids (a null id last), else null.

    Scores are whole numbers between -88,000 and 115,000 (gains are logs of
    ratios of longs, the noise has 32 bits), so that their histogram is a table
    of a proven size.  Its sums tell before which rank each score begins; within
    a score the ids are numbered.  A score has a two-thousandth of the rows at
    most, but for rows that repeat an id.
    """
    drawable = rows.where("drawable")
    most = drawable.count() * percent // 100
    counts = drawable.groupBy("score").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("score") / SPAN))
    parts = counts.groupBy("part").agg(F.sum("n").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy(F.desc("part"))) - F.col("all")).alias("above"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("score"))) - F.col("n")
    base = counts.withColumn("within", within).join(F.broadcast(parts), "part").select(F.col("score").alias("_score"), (F.col("above") + F.col("within")).alias("base"))
    base = F.broadcast(base.where(F.col("base") < most))
    found = written(rows.join(base, F.col("drawable") & (F.col("score") == F.col("_score")), "left").drop("_score"), "based")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    rank = F.col("base") + F.row_number().over(order)
    drawn = found.where("base is not null").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(found.where("base is null").withColumn("rank", F.lit(None).cast("long"))).drop("base")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    A null or empty text has no features and weight 0; texts under
    ``least_words`` words have a score but are never drawn.  Rows that repeat an
    id each give a row and have one noise; equal rows are ranked one after the
    other.  A null id takes part.  Without documents the result is empty; with
    an empty target all its frequencies are equal.  Other columns are not read.
    """
    gain = gains(histogram(docs, text, run, buckets), histogram(target, target_text, run, buckets))
    rows = weights(docs, gain, doc_id, text, run).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = written(rows.withColumn("drawable", F.col("n_words") >= least_words), "scores")
    return ranked(rows, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


ORACLE = r"""WITH tab AS (SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY c) AS t FROM range(256) r(c)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w),
u AS (SELECT w, count(*) AS n FROM b GROUP BY w),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM v UNION SELECT w FROM u)),
k AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT), lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM v JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM u JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, sum(CASE WHEN n_features >= 20 THEN 1 ELSE 0 END) OVER () AS able FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END::BIGINT AS rank FROM o"""
