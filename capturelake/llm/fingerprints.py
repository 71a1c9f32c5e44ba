"""Document fingerprints by SimHash, and all that are within a Hamming radius.

Every distinct word of a text votes on 256 bits by its hash, with the weight
of its length times the root of its count; a bit is 1 where the votes for it
prevail.  Likeness is the share of equal bits.

Of two fingerprints within ``radius`` bits, cut into one block more than that,
one block at least is equal.  So the fingerprints are put into a table for
each block, permuted to begin with it, and those that begin alike are compared.
Only distinct fingerprints are; a beginning that very many share is compared in
tiles, in many tasks.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import Bloom, bounded, map_batches, mix, pieces, release, text_column, written

#: Bits of a fingerprint; most differing bits of near ones; words that vote at once.
BITS, RADIUS, CHUNK = 256, 7, 4096
#: Ranges of documents for each partition of a shuffle; fingerprints of a tile.
RANGES, TILE = 8, 16_384

_WORDS = np.arange(BITS // 64, dtype=np.uint64)


def fingerprint(text: bytes) -> bytes:
    """The fingerprint of one text: zeros if it has no words."""
    counts = Counter(text.lower().split())
    if not counts:
        return bytes(BITS // 8)
    words = list(counts)
    n = np.fromiter(counts.values(), np.float64, len(words))
    size = np.fromiter(map(len, words), np.float64, len(words))
    weight = np.maximum(1, np.rint(np.sqrt(n) * size)).astype(np.float32)  # whole numbers: the sums do not depend on their order
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    votes = np.zeros(BITS)
    for i in range(0, len(words), CHUNK):
        wide = np.ascontiguousarray(mix(hashes[i : i + CHUNK, None], _WORDS[None, :]))
        votes += weight[i : i + CHUNK] @ np.unpackbits(wide.view(np.uint8), axis=1).astype(np.float32)
    return np.packbits(2 * votes > weight.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as bytes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, part in pieces(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(map(fingerprint, part), pa.binary())], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text")), run, "doc_id long, fp binary")


def _ranges(docs: DataFrame, doc_id: str) -> np.ndarray:
    """Ids that are in the table, at which ranges of about as many rows begin:
    RANGES for each partition of a shuffle."""
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(doc_id).cast("long")
    least, some = docs.agg(F.min(at), F.percentile_approx(at, [i / n for i in range(1, n)])).first()
    return np.unique([least, *some]) if some else np.zeros(1, np.int64)


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) of
    every row: of its text, and of the text whose last half is replaced by as
    much of the next document's beginning.

    Texts go through one shuffle, by ranges of ids.  The first row of a range
    goes to the range before as well, so that each row finds the next one in
    its own task, which holds two texts at a time.
    """
    begins = _ranges(docs, doc_id)
    last = len(begins) - 1
    no_ids = last == 0 and docs.where(F.col(doc_id).isNotNull()).isEmpty()

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        """Twice the range, and one more for its first id; null ids are the last."""
        x = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        p = np.maximum(np.searchsorted(begins, x, side="right") - 1, 0)
        first = (begins[p] == x) & ids.is_valid().to_numpy(zero_copy_only=False)
        if no_ids:
            first |= p == 0
        return pa.array((2 * p + first).astype(np.int32))

    bounded(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text")).withColumn("place", place("doc_id"))
    p = F.shiftright("place", 1)
    before = F.when(p == 0, last).otherwise(p - 1)
    own = F.struct(p.alias("p"), F.lit(False).alias("guest"))
    copies = F.when(F.col("place").bitwiseAND(F.lit(1)) == 1, F.array(own, F.struct(before.alias("p"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    rows = rows.select(F.explode(copies).alias("at"), "doc_id", "text").select("at.*", "doc_id", "text")
    rows = rows.repartition("p").sortWithinPartitions("p", "guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            places, guests, ids = (batch.column(i).to_pylist() for i in range(3))
            for i, (p, guest, k) in enumerate(zip(places, guests, ids, strict=True)):
                if guest and before is None:  # a further row of the id that was taken
                    continue
                data = batch.column(3)[i].as_py()
                here = (p, k, data.decode("utf-8", "surrogateescape"), fingerprint(data))
                if before is not None:
                    out.append(_pair(before, here))
                before = None if guest else here
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)
        release()

    return rows.mapInArrow(run, _EDITED)


_NAMES = [x.split()[0] for x in _EDITED.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _pair(here: tuple, after: tuple) -> tuple:
    _, k, text, own = here
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[2][:half]).encode("utf-8", "surrogateescape")
    other = fingerprint(edited) if half else own
    return k, len(text), hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, after[3])


def _keys(fp: Column, radius: int) -> Column:
    """What a fingerprint begins with in each of radius + 1 permuted tables: a
    block of whole bytes, hashed with the table's number."""
    edges = [BITS // 8 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.xxhash64(F.lit(t), F.substring(fp, a + 1, b - a)) for t, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))


def _compared(fps: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, radius: int) -> np.ndarray:
    """For each fingerprint how many documents are near that no table before
    this one finds: pairs of ``left`` with ``right``, both ways; within one tile, all."""
    edges = [BITS // 8 * i // (radius + 1) for i in range(radius + 2)]
    words = fps.view(np.uint64)
    out = np.zeros(len(fps), np.int64)
    step = max(1, (1 << 20) // max(1, len(right)))
    for i in range(0, len(left), step):
        a = left[i : i + step]
        apart = np.zeros((len(a), len(right)), np.uint16)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[a, w][:, None] ^ words[right, w][None, :])
        x, y = np.nonzero(apart <= radius)
        x, y = a[x], right[y]
        ok = x != y if left is right else np.ones(len(x), bool)
        ok &= (fps[x, edges[table] : edges[table + 1]] == fps[y, edges[table] : edges[table + 1]]).all(axis=1)
        for t in range(table):
            ok &= (fps[x, edges[t] : edges[t + 1]] != fps[y, edges[t] : edges[t + 1]]).any(axis=1)
        np.add.at(out, x[ok], n[y[ok]])
        if left is not right:
            np.add.at(out, y[ok], n[x[ok]])
    return out


def neighbours(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, n_near) of the distinct fingerprints in column ``fp`` that other rows
    have or come within ``radius`` bits of, with the number of such rows: all of
    them, found once each.  At most BITS / 8 - 1 bits of radius.

    Beginnings that one fingerprint alone has are counted away, by their hashes
    alone, before fingerprints are dealt to the tables.
    """
    if not 0 <= radius < BITS // 8:
        raise ValueError(f"the radius must be from 0 to {BITS // 8 - 1}")
    distinct = written(rows.groupBy("fp").agg(F.count("*").alias("n")), "distinct")
    entries = distinct.select("fp", "n", F.posexplode(_keys(F.col("fp"), radius)).alias("table", "key"))
    busy = written(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "busy")
    near = Bloom(busy, "key")
    shared = entries.where(near(F.col("key"))).join(busy, "key")
    m = F.ceil(F.col("size") / tile)
    own = F.pmod(F.xxhash64("fp"), m)
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b")))
    dealt = shared.select("fp", "n", "table", "key", own.alias("own"), F.explode(tiles).alias("tile")).select("key", "tile.*", "table", "own", "fp", "n")
    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "table")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            part = pa.Table.from_batches(held)
            a, b, table = name[1:]
            fps = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            n, side = part.column("n").to_numpy(), part.column("own").to_numpy()
            every = np.arange(len(fps))
            left, right = (every, every) if a == b else (every[side == a], every[side == b])
            found = _compared(fps, n, left, left if a == b else right, table, radius)
            at = np.flatnonzero(found)
            if len(at):
                yield pa.RecordBatch.from_arrays([part.column("fp").combine_chunks().take(pa.array(at)), pa.array(found[at])], ["fp", "n_near"])

        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            first = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[first]:
                    if names[first] != name:
                        yield from flush()
                        held, name = [], names[first]
                    held.append(batch.slice(first, i - first))
                    first = i
        yield from flush()
        release()

    others = dealt.mapInArrow(compare, "fp binary, n_near long")
    copies = distinct.where("n > 1").select("fp", (F.col("n") - 1).alias("n_near"))
    return copies.union(others).groupBy("fp").agg(F.sum("n_near").alias("n_near"))


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_near) of every row: see :func:`edits`; n_near is
    how many other rows have a fingerprint within ``radius`` bits.

    A null text is empty, an empty one has a fingerprint of zeros.  The next
    document is that with the next greater id, after the last the first; null
    ids come last, rows that repeat an id are in the order of a hash of their
    texts, and a single row is its own next.  Other columns are not read.  An
    empty table gives an empty result.
    """
    rows = written(edits(docs, doc_id, text), "edits")
    found = written(neighbours(rows.select("fp"), radius), "near")
    hit = Bloom(found.select(F.xxhash64("fp").alias("key")), "key")
    rows = rows.withColumn("some", hit(F.xxhash64("fp")))
    counted = rows.where("some").join(found, "fp", "left").select(*rows.columns, F.coalesce("n_near", F.lit(0)).alias("n_near"))
    out = rows.where("not some").withColumn("n_near", F.lit(0).cast("long")).unionByName(counted)
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
