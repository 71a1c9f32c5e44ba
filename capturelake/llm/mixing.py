"""Mixing sources to target weights by Pareto order sampling.

Documents have weights: longer ones are worth more.  A document's expected
number of copies is its weight times a level that its source's documents
share, MOST at most, such that all copies together have the target's words.
The whole part is certain.  What is left is its inclusion probability in a
Pareto sample: documents are ranked by their random odds U / (1 - U) divided
by their inclusion odds, and the first ones that fill the rest of the target
are taken once more.

The rank at which a source is full is found from sums over bins of the rank,
refined until few rows are left in a bin, so that a source with most of all
rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import WORD, written

#: Weights of the sources in code point order, repeating; the most copies.
WEIGHTS, MOST = (5, 2, 1), 3
#: Characters from which on a document has the next weight: 1, 2, 3.
LENGTHS = (500, 2000)
#: Bins of the rank at each refinement; refined at most so often (the ranks'
#: numbers have no more digits), and until a bin has at most so many rows.
BINS, REFINEMENTS, FEW = 1024, 4, 20_000
#: Up to so many sources their plan is broadcast (under 100 bytes each).
BROADCAST_SOURCES = 200_000


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    """``rows``, written, with ``rank``: 1, 2, 3 ... in the order of a column, null last.
    They are sorted by ranges; what comes before a range is a sum over one row each."""
    order = F.col(by).asc_nulls_last()
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ranked").withColumn("_p", F.shiftright("_at", 33))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    counts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(counts, "_p").withColumn("rank", place).drop("_p", "_at", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The weights share the sum of all sizes; a target stops at ``most`` times
    its source's size, and the excess goes to the others by weight until none
    is above: the targets are least(most * size, level * weight) for the one
    level at which they add up.  It is found from below: the sources that a
    level fills are set aside and the others share the rest, until no more
    are filled; each step is two sums over all sources.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = written(_ranked(sizes, "source").withColumn("w", w).withColumn("cap", F.col("source_size") * most).drop("rank"), "caps")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    full, spare, share = None, total, rows.agg(F.sum("w")).first()[0] or 0
    while share:
        filled = F.col("cap").cast("double") * F.lit(float(share)) <= F.col("w") * F.lit(float(spare))
        n, caps, rest = rows.agg(F.count_if(filled), F.sum(F.when(filled, F.col("cap"))), F.sum(F.when(~filled, F.col("w")))).first()
        if n == full:
            break
        full, spare, share = n, total - (caps or 0), rest or 0
    level = F.lit(float(spare)) / F.lit(float(share)) if share else F.lit(None).cast("double")
    filled = F.lit(True) if not share else F.col("cap").cast("double") * F.lit(float(share)) <= F.col("w") * F.lit(float(spare))
    return rows.select("source", "source_size", F.when(filled, F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def by_length(text: str = "text") -> Column:
    """The weight of a text: 1, and one more from each of LENGTHS characters on."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return sum((F.when(n >= x, 1.0).otherwise(0.0) for x in LENGTHS), F.lit(1.0))


def _rank(u: Column, part: Column) -> Column:
    """The rank in (0, 1): Q / (1 + Q) for Q = u / (1 - u) divided by the
    inclusion odds part / (1 - part)."""
    return u / (u + (1 - u) * (part / (1 - part)))


def classes(sums: DataFrame, most: int = MOST) -> DataFrame:
    """(source, weight, target, z, copies): the expected copies of a document
    of each weight, from the words ``z`` of each source's weights.

    The heaviest are at ``most`` copies as long as the level of the others,
    which fills the rest of the target, would give them more.
    """
    by = Window.partitionBy("source").orderBy(F.desc("weight"))
    heavier = F.coalesce(F.sum("z").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("weight") * F.col("z")).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = sums.withColumn("level", F.when(rest > 0, (F.col("target") - heavier * most) / rest))
    first = F.first(F.when(F.col("level") * F.col("weight") <= most, F.col("level")), ignorenulls=True)
    level = first.over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    copies = F.when(level.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), level * F.col("weight")))
    return rows.withColumn("copies", F.when(F.col("z") > 0, copies).otherwise(F.lit(0.0))).drop("level")


def _boundary(rows: DataFrame, bin_: Column) -> DataFrame:
    """For each source the bin of ``rows`` in which it gets full, what is left
    before it, and how many rows are in it."""
    sums = rows.withColumn("bin", bin_).groupBy("source", "room", "bin").agg(F.sum("size").alias("z"), F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("bin")
    sums = sums.withColumn("after", F.sum("z").over(order)).withColumn("before", F.col("after") - F.col("z"))
    cut = sums.where((F.col("before") <= F.col("room")) & (F.col("after") > F.col("room")))
    return cut.select("source", "bin", (F.col("room") - F.col("before")).alias("room"), "n")


def plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source and weight: source_size, target, whole copies, the
    inclusion probability of one more (part), what whole copies leave of the
    source's target (room), and the source's last (rank, doc) that is taken
    once more: null if none is (room for less than half a word).

    It has a row for each weight of each source, so weights should be classes."""
    sums = written(slim.groupBy("source", "weight").agg(F.sum("size").alias("z")), "sums")
    sizes = targets(sums.groupBy("source").agg(F.sum("z").alias("source_size")), weights, most)
    own = sizes.withColumnRenamed("source", "_source")
    rows = classes(sums.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), most)
    rows = rows.withColumn("whole", F.floor("copies")).withColumn("part", F.col("copies") - F.floor("copies"))
    room = F.col("target") - F.sum(F.col("whole") * F.col("z")).over(Window.partitionBy("source"))
    sources = written(rows.withColumn("room", room), "sources")
    x = _rank(F.col("u"), F.col("part"))
    # a document is taken if at most half of it exceeds the room
    rows = _join(slim, sources.where("room >= 0.5 and part > 0").select("source", "weight", "part", "room")).withColumn("x", x)
    for level in range(1, REFINEMENTS + 1):
        cut = written(_boundary(rows, F.floor(F.col("x") * BINS**level)), "bins")
        parts = sources.where("part > 0").select(F.col("source").alias("s"), "weight", "part")
        parts = parts.join(cut, F.col("s").eqNullSafe(F.col("source"))).drop("s")
        rows = _join(slim, parts).withColumn("x", x).where(F.floor(F.col("x") * BINS**level) == F.col("bin"))
        if (cut.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
    # rows with the same id have the same rank and are taken together
    rows = rows.groupBy("source", "room", "x", "key").agg(F.sum("size").alias("z"))
    order = Window.partitionBy("source").orderBy("x", "key")
    rows = rows.withColumn("after", F.sum("z").over(order)).where(F.col("after") * 2 - F.col("z") <= F.col("room") * 2)
    last = rows.groupBy("source").agg(F.max(F.struct("x", "key")).alias("last"))
    # what the boundary bin has before its first taken row: the bin's lower edge
    edge = cut.select("source", F.struct((F.col("bin").cast("double") / BINS**level).alias("x"), F.lit(-(1 << 63)).cast("long").alias("key")).alias("edge"))
    out = sources
    for more in (edge, last):
        more = more.withColumnRenamed("source", "s")
        out = out.join(more, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return written(out.withColumn("cut", F.coalesce("last", "edge")).drop("edge", "last"), "plan")


def _join(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with what their source and weight have; null is a source like any other."""
    few = sources.select(F.col("source").alias("_source"), F.col("weight").alias("_weight"), *(F.col(c) for c in sources.columns if c not in ("source", "weight")))
    if few.count() <= BROADCAST_SOURCES:
        few = F.broadcast(few)
    return rows.join(few, rows["source"].eqNullSafe(few["_source"]) & (rows["weight"] == few["_weight"])).drop("_source", "_weight")


def _slim(docs: DataFrame, doc_id: str, text: str, source: str, weight: Column | None, seed: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), uniform(F.col(doc_id), seed).alias("u"), (by_length(text) if weight is None else weight.cast("double")).alias("weight"), F.coalesce(F.col(doc_id).cast("long"), F.lit(1 - (1 << 63))).alias("key"))


def _copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    rows = _join(rows, sources)
    here = F.struct(_rank(F.col("u"), F.col("part")).alias("x"), F.col("key").alias("key"))
    more = (F.col("part") > 0) & F.col("cut").isNotNull() & (here <= F.col("cut"))
    return rows.withColumn("copies", F.when(F.col("source_size") > 0, F.col("whole") + more.cast("long")).otherwise(F.lit(0)).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row.

    ``weight`` (positive; a few classes) is what a document's expected copies are in proportion to,
    without one it goes by length (:func:`by_length`).  A null or empty text
    has size 0 and takes nothing; a null source is a source, the last; rows
    that repeat an id have one random number and are taken together; rows
    without an id share one.  Other columns are not read.  The choice depends
    on ids and seed alone, so that reruns agree.
    """
    slim = written(_slim(docs, doc_id, text, source, weight, seed), "sizes")
    rows = _copies(slim, plan(slim, weights, most))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns."""
    slim = written(_slim(docs, doc_id, text, source, None, seed), "sizes")
    own = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), F.col(doc_id).cast("long").alias("_id"), F.col(source).cast("string").alias("source"), by_length(text).alias("weight"))
    whole = whole.select("_row", "source", uniform(F.col("_id"), seed).alias("u"), "weight", F.coalesce(F.col("_id"), F.lit(1 - (1 << 63))).alias("key"))
    rows = _copies(whole, plan(slim))
    return rows.where("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    1.0::DOUBLE + CASE WHEN length(coalesce(text, '')) >= {LENGTHS[0]} THEN 1 ELSE 0 END + CASE WHEN length(coalesce(text, '')) >= {LENGTHS[1]} THEN 1 ELSE 0 END AS weight,
    (CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w,
    CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
-- a source is full at a level if its cap is at most level * weight: try each source's cap as the last full one
f AS (
  SELECT a.source, a.source_size, a.cap, a.w, a.total,
    a.cap * CAST((SELECT sum(b.w) FROM w b WHERE b.cap * a.w > a.cap * b.w OR b.source IS NOT DISTINCT FROM a.source) AS DOUBLE)
      <= a.w * CAST(a.total - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap * a.w <= a.cap * b.w AND b.source IS DISTINCT FROM a.source), 0) AS DOUBLE) AS isfull
  FROM w a),
t AS (
  SELECT source, source_size, CASE WHEN isfull THEN CAST(cap AS DOUBLE)
    ELSE CAST(total - coalesce(CAST(sum(cap) FILTER (WHERE isfull) OVER () AS BIGINT), 0) AS DOUBLE) / CAST(sum(w) FILTER (WHERE NOT isfull) OVER () AS DOUBLE) * w END AS target
  FROM f),
k AS (SELECT source, weight, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source, weight),
-- the level if the classes that are heavier than this one are at three copies
l AS (SELECT a.source, a.weight, a.z, t.target, t.source_size,
    (t.target - 3 * coalesce((SELECT CAST(sum(b.z) AS BIGINT) FROM k b WHERE b.source IS NOT DISTINCT FROM a.source AND b.weight > a.weight), 0))
      / nullif((SELECT sum(b.weight * b.z) FROM k b WHERE b.source IS NOT DISTINCT FROM a.source AND b.weight <= a.weight), 0) AS level
  FROM k a JOIN t ON a.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN z = 0 THEN 0 ELSE coalesce(least(3, weight * arg_max(level, CASE WHEN level * weight <= 3 THEN weight END) OVER (PARTITION BY source)), 3) END AS copies FROM l),
g AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS part, target - sum(floor(copies) * z) OVER (PARTITION BY source) AS room FROM e),
x AS (SELECT d.doc_id, d.size, d.source, g.source_size, g.target, g.whole, g.part, g.room, d.u / (d.u + (1 - d.u) * (g.part / (1 - g.part))) AS x
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.weight = g.weight),
c AS (SELECT *, sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY x, doc_id RANGE UNBOUNDED PRECEDING) AS after,
    sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY source, x, doc_id) AS z FROM x)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN part > 0 AND room >= 0.5 AND after * 2 - z <= room * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
