"""Near-duplicates by SimHash and deletion-variant signatures.

A 64-bit fingerprint within ``D = 4`` bits of another has, when both are cut
into three segments, a segment in which they differ by at most one bit (four
differences cannot give two to each of three).  For every segment and every
bit of it the index has the segment with that bit as a wildcard: fingerprints
that differ in at most that bit share the entry.  An equality join on the
entries finds all candidates, and the join's condition verifies them.

Only distinct fingerprints are indexed, so copies cost nothing; entries shared
by more than ``HEAVY`` fingerprints are refined (see :func:`links`).

What grows with the input is joined by sorting; only tables that are counted
and few are broadcast (see :func:`~capturelake.llm.common.joined_to`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import Bloom, joined_to, map_batches, pieces, text_column, written
from capturelake.llm.components import stars

#: Words in a shingle, most differing bits of a link.
SHINGLE, DISTANCE = 4, 4
#: Segments of the fingerprint: first bit and width.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: An index entry with more distinct fingerprints than this is refined.
HEAVY = 512
#: Fingerprints whose entries a task makes.
EXPLODED = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, unsigned; 0 if it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def run(batch: pa.RecordBatch):
        for first, run in pieces(batch.column(1)):
            fp = np.array([fingerprint(t, shingle) for t in run], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(run)), pa.array(fp)], ["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text"))
    return map_batches(chosen, run, "doc_id long, fp long")


def _wildcards(fp: Column, segments: tuple[tuple[int, int], ...]) -> Column:
    """One entry for each bit: the bit's number, and its segment without it."""
    entries = []
    for low, width in segments:
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        entries += [segment.bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit((low + i) << 24)) for i in range(width)]
    return F.array(*entries)


def _first(key: Column) -> Column:
    """Whether ``key`` is the first entry that u and v share: no segment before
    its own has under two differences, and it is the wildcard of the only one,
    or the segment's first if there is none."""
    bit, out = F.shiftright(key, 24), F.lit(False)
    apart = F.lit(True)
    for low, width in SEGMENTS:
        here = F.bit_count(F.col("u").bitwiseXOR(F.col("v")).bitwiseAND(F.lit(((1 << width) - 1) << low).cast("long") if low + width < 64 else F.lit(-(1 << low))))
        out = out | (apart & (bit >= low) & (bit < low + width) & ((here == 1) | (bit == low)))
        apart = apart & (here > 1)
    return out


def _near(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def _pairs(index: DataFrame, keys: list[str], more: Column | None = None) -> DataFrame:
    left = index.select(*keys, F.col("fp").alias("u"), *([F.col("tight").alias("ut")] if more is not None else []))
    right = index.select(*keys, F.col("fp").alias("v"), *([F.col("tight").alias("vt")] if more is not None else []))
    on = (F.col("u") < F.col("v")) & _near("u", "v", DISTANCE)
    for k in keys:
        on = on & (left[k] == right[k])
    return left.join(right.hint("shuffle_merge"), on & (_first(left["key"]) if more is None else more)).select("u", "v")


def links(distinct: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect exactly
    those that a chain of links of at most four bits connects.

    An entry with up to ``heavy`` fingerprints is joined with itself, and a
    pair is emitted by the first entry that it shares.  In a
    larger one, the fingerprints within two bits of its smallest are pairwise
    within four: they get an edge to it and are not compared with each other.
    The others are compared within finer entries: the 43 bits outside the
    segment, themselves cut in three with one wildcard.
    """
    # every fingerprint has 64 entries: a task makes those of some, however few bytes they are before
    parts = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // EXPLODED))
    index = distinct.select("fp").repartition(parts).select("fp", F.explode(_wildcards(F.col("fp"), SEGMENTS)).alias("key"))
    large = written(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("hub")).where(F.col("n") > heavy).drop("n"), "entries")
    n = large.count()
    if not n:
        return _pairs(index, ["key"]).distinct()
    large = joined_to(large, n)
    light = index.join(large, "key", "left_anti")
    rows = index.join(large, "key").withColumn("tight", _near("fp", "hub", DISTANCE // 2))
    rows = written(rows, "heavy")
    hubs = rows.where(_near("fp", "hub", DISTANCE) & (F.col("fp") != F.col("hub"))).select(F.col("hub").alias("u"), F.col("fp").alias("v"))
    bit = F.shiftright(F.col("key"), 24)
    rest = F.lit(None).cast("array<bigint>")
    for low, width in SEGMENTS:
        # the other bits, moved together; cut in three
        above = F.shiftrightunsigned(F.col("fp"), low + width) if low + width < 64 else F.lit(0).cast("long")
        other = F.shiftleft(above, low).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << low) - 1)))
        n = 64 - width
        cuts = ((0, n // 3), (n // 3, n // 3), (2 * (n // 3), n - 2 * (n // 3)))
        rest = F.when((bit >= low) & (bit < low + width), _wildcards(other, cuts)).otherwise(rest)
    finer = rows.select("key", "fp", "tight", F.explode(rest).alias("sub"))
    loose = ~(F.col("ut") & F.col("vt"))
    return _pairs(light, ["key"]).union(hubs).union(_pairs(finer, ["key", "sub"], loose)).distinct()


def _roots(distinct: DataFrame) -> DataFrame:
    """``distinct`` with ``root``, one fingerprint of its component for all."""
    roots = stars(links(distinct)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return distinct.join(roots.hint("shuffle_merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    A null or empty text, or one without words, has the fingerprint zero and is
    linked like any other.  A null id takes part and is never the smallest of
    its component unless no row of it has an id (then component_id is null).
    Rows that repeat an id each give a row.  Other columns of ``docs`` are not
    read.  An empty table gives an empty result.
    """
    rows = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = _roots(distinct)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(least.hint("shuffle_merge"), "root").select("fp", "component_id")
    return rows.join(of.hint("shuffle_merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component: that with the smallest id (null is
    the greatest) and, of rows that repeat it, with the smallest fingerprint,
    text and other columns.

    Ids of which every row stays pass by a Bloom filter, without a shuffle;
    only the others' rows, and the few that the filter takes for them, are
    matched by id and fingerprint.  An empty table gives an empty result;
    columns may have any names.
    """
    rows = written(fingerprints(docs, doc_id, text), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    distinct = written(rows.groupBy("fp").agg(F.min(order).alias("least")), "distinct")
    first = _roots(distinct).groupBy("root").agg(F.min(F.struct("least.none", "least.doc_id", "fp")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.fp").alias("_fp"), F.lit(True).alias("_kept"))
    found = rows.groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    found = found.join(first.hint("shuffle_merge"), found["doc_id"].eqNullSafe(first["_id"]) & (found["fp"] == first["_fp"]), "left")
    kept = F.coalesce("_kept", F.lit(False))
    doubtful = written(found.where(~kept | (F.col("n") > 1)).select("doc_id", "fp", kept.alias("kept")), "doubtful")
    near = Bloom(doubtful.where("doc_id is not null").select("doc_id"), "doc_id")
    own = docs.columns
    at = F.col(doc_id).cast("long")
    hit = near(at)
    sure, some = docs.where(~hit), docs.where(hit)

    def run(batch: pa.RecordBatch):
        for start, run in pieces(batch.column(2)):
            fp = np.array([fingerprint(t) for t in run], np.uint64).view(np.int64)
            part = batch.slice(start, len(run))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], ["_row", "_id", "_fp"])

    some = some.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), at.alias("_id"), text_column(text).alias("_text"))
    schema = some.select("_row", "_id").schema.add("_fp", "long")
    some = map_batches(some, run, schema)
    some = some.join(doubtful.hint("shuffle_merge"), some["_id"].eqNullSafe(doubtful["doc_id"]) & (some["_fp"] == doubtful["fp"]), "left")
    some = written(some.where("coalesce(kept, true)").select("_row", "_id", "_fp", "kept"), "matched")
    ties = some.where("kept").groupBy("_id", "_fp").agg(F.min_by("_row", F.struct(F.col(f"_row.`{text}`"), F.to_json("_row"))).alias("_row"))
    return sure.union(some.where("kept is null").select("_row.*")).union(ties.select("_row.*"))
