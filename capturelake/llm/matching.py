"""Row patterns: `A (D|U)*? P` over the consecutive rows of a key.

A is any row with an amount; D and U are rows whose amount is below or above
the row before; P is a row of the goal's kind with an amount of at least A's.
D, U and P follow the row before them by ``within`` at most.

Rows are dealt by ranges of (key, time, id), so that one key fills as many tasks
as its rows need.  Within such a block no match crosses a row that can be
neither D, U nor P: such rows cut it into segments.  In a segment the goal rows' amounts stand
in a max segment tree; from every start a descent finds the first (reluctant)
or last (greedy) goal of at least the start's amount, up to the first row that
is neither D nor U: what backtracking finds.  The search then walks along the
matches.  The two segments that a block's ends cut off are joined with the
neighbours' and searched in a second, small pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import bounded, release, written

#: Rows that are goals, that stop a match, and the longest time between rows.
GOAL, BARRED, WITHIN = "purchase", "error", 600_000_000

_NONE = -(1 << 63)
_ROW = ("key", "ts", "id", "lacks", "cents", "has", "code", "digest", "p", "pos")
_FOUND = "p int, pos long, key long, first_id long, last_id long, n_rows long, sum_cents long, labels string"
_EDGE = "tail boolean, ts long, id long, cents long, code byte, digest long"


def first_at_least(values: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each (low, high, least) the first index in [low, high] whose value is
    ``least`` or more, or -1, by descents of one max segment tree."""
    n = len(values)
    m = 1 << max(0, n - 1).bit_length()
    tree = np.full(2 * m, _NONE, np.int64)
    tree[m : m + n] = values
    at = m
    while at > 1:
        np.maximum(tree[at : 2 * at : 2], tree[at + 1 : 2 * at : 2], out=tree[at // 2 : at])
        at //= 2
    out = np.full(len(low), -1, np.int64)
    who = np.flatnonzero(low <= high)
    node, width = low[who] + m, np.ones(len(who), np.int64)
    found, inside = [], []
    while len(who):
        up = node & -node  # a left child stands for all that its ancestors begin with
        node, width = node // up, width * up
        hit = tree[node] >= least[who]
        found.append(who[hit])
        inside.append(node[hit])
        node = node + 1
        # beyond the last node of a level is nothing; beyond ``high`` nothing is looked for
        on = ~hit & (node & (node - 1) != 0)
        on[on] = node[on] * width[on] - m <= high[who[on]]
        who, node, width = who[on], node[on], width[on]
    who, node = np.concatenate([*found, np.zeros(0, np.int64)]), np.concatenate([*inside, np.zeros(0, np.int64)])
    while len(node) and (down := node < m).any():
        node = np.where(down, 2 * node, node)
        node = node + (down & (tree[node] < least[who]))
    node = node - m
    ok = node <= high[who]
    out[who[ok]] = node[ok]
    return out


def last_at_least(values: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The same for the last such index."""
    n = len(values)
    back = first_at_least(values[::-1], n - 1 - high, n - 1 - low, least)
    return np.where(back >= 0, n - 1 - back, -1)


def ends(cents: np.ndarray, has: np.ndarray, step: np.ndarray, goal: np.ndarray, greedy: bool = False) -> np.ndarray:
    """Where the match that begins at each row ends, or -1."""
    n = len(cents)
    stop = np.where(step, n - 1, np.arange(n))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    high = np.append(stop[1:], -1)  # the first row after a start that no D or U fits, which P still may
    high[~has] = -1
    values = np.where(goal, cents, _NONE)
    return (last_at_least if greedy else first_at_least)(values, np.arange(1, n + 1), high, cents)


class _Rows:
    """Sorted rows by column, and what is told by the row before each."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.at = columns

    def __len__(self) -> int:
        return len(self.at["key"])

    def cut(self, first: int, last: int | None = None) -> _Rows:
        return _Rows({c: v[first:last] for c, v in self.at.items()})

    def kept(self, which: np.ndarray) -> _Rows:
        return _Rows({c: v[which] for c, v in self.at.items()})

    @staticmethod
    def join(parts: list[_Rows]) -> _Rows:
        return parts[0] if len(parts) == 1 else _Rows({c: np.concatenate([p.at[c] for p in parts]) for c in parts[0].at})


def _flags(rows: _Rows, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows D or U fits, and which P fits if the amount does; the first fits none."""
    at, n = rows.at, len(rows)
    step, goal = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        near = (at["key"][1:] == at["key"][:-1]) & (at["ts"][1:] - at["ts"][:-1] <= within) & at["has"][1:] & at["has"][:-1]
        step[1:] = near & (at["code"][1:] >= 1) & (at["cents"][1:] != at["cents"][:-1])
        goal[1:] = near & (at["code"][1:] == 2)
    return step, goal


def _cut(stream: Iterator[_Rows], within: int) -> Iterator[tuple[_Rows, bool]]:
    """Runs of whole segments, as they get complete, without repeated rows; the
    last run is one segment, whose end is the stream's (True)."""
    held: list[_Rows] = []
    for rows in stream:
        if held:
            rows = _Rows.join([held[-1].cut(-1), rows])
        at = rows.at
        same = np.zeros(len(rows), bool)
        same[1:] = (at["key"][1:] == at["key"][:-1]) & (at["ts"][1:] == at["ts"][:-1]) & (at["id"][1:] == at["id"][:-1]) & (at["lacks"][1:] == at["lacks"][:-1]) & (at["digest"][1:] == at["digest"][:-1])
        rows = rows.kept(~same)
        step, goal = _flags(rows, within)
        breaks = np.flatnonzero(~step & ~goal)
        first = 1 if held else 0
        last = int(breaks[-1]) if len(breaks) else 0
        if last:
            yield _Rows.join([*held, rows.cut(first, last)]), False
            held = [rows.cut(last)]
        else:
            held = [*held, rows.cut(first)] if len(rows) > first else held
    if held:
        yield _Rows.join(held), True


def _found(rows: _Rows, within: int, greedy: bool) -> pa.RecordBatch | None:
    """The matches of whole segments."""
    if not len(rows):
        return None
    at = rows.at
    step, goal = _flags(rows, within)
    end = ends(at["cents"], at["has"], step, goal, greedy)
    first, last, free = [], [], 0
    starts = np.flatnonzero(end >= 0)
    for i, j in zip(starts.tolist(), end[starts].tolist(), strict=True):
        if i >= free:
            first.append(i)
            last.append(j)
            free = j + 1
    if not first:
        return None
    a, b = np.array(first), np.array(last)
    letters = np.full(len(rows), ord("U"), np.uint8)
    letters[1:][at["cents"][1:] < at["cents"][:-1]] = ord("D")
    letters[a], letters[b] = ord("A"), ord("P")
    text = letters.tobytes().decode()
    with np.errstate(over="ignore"):
        total = np.cumsum(np.where(at["has"], at["cents"], 0))
        sums = total[b] - total[a] + at["cents"][a]
    ids = pa.array(at["id"], mask=at["lacks"])
    columns = [at["p"][a].astype(np.int32), at["pos"][a], at["key"][a], ids.take(pa.array(a)), ids.take(pa.array(b)), b - a + 1, sums, pa.array([text[i : j + 1] for i, j in zip(first, last, strict=True)])]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["p", "pos", "key", "first_id", "last_id", "n_rows", "sum_cents", "labels"])


def _columns(batch: pa.RecordBatch, p: int | None = None, before: int = 0) -> _Rows:
    """A batch with key, ts, id, cents, code and digest as arrays."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    ints = lambda c: pc.fill_null(get(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    at = {c: ints(c) for c in ("key", "ts", "id", "cents", "code", "digest")}
    at["lacks"], at["has"] = pc.is_null(get("id")).to_numpy(zero_copy_only=False), pc.is_valid(get("cents")).to_numpy(zero_copy_only=False)
    if p is None:
        at["p"], at["pos"] = ints("p"), ints("pos")
    else:
        at["p"], at["pos"] = np.full(batch.num_rows, p), np.arange(before, before + batch.num_rows)
    return _Rows(at)


def _edge(rows: _Rows, tail: bool) -> pa.RecordBatch:
    at = rows.at
    none = lambda kind: pa.nulls(len(rows), kind)
    own = [pa.array(at["p"].astype(np.int32)), pa.array(at["pos"]), pa.array(at["key"]), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.string())]
    more = [pa.array(np.full(len(rows), tail)), pa.array(at["ts"]), pa.array(at["id"], mask=at["lacks"]), pa.array(at["cents"], mask=~at["has"]), pa.array(at["code"].astype(np.int8)), pa.array(at["digest"])]
    return pa.RecordBatch.from_arrays(own + more, _FIELDS)


_FIELDS = [f.split()[0] for f in f"{_FOUND}, {_EDGE}".split(", ")]


def _padded(found: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    if found is not None:
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(found.num_rows, k) for k in kinds)], _FIELDS)


def cents_of(value: Column) -> Column:
    """floor(100 * value + 0.5); null where that is no long (not a number, infinite, too large)."""
    x = F.floor(F.lit(100.0) * value.cast("double") + F.lit(0.5))
    return F.when(F.abs(value.cast("double")) < F.lit(2.0**55), x)


def matches(rows: DataFrame, key: str = "client_id", ts: str = "ts", row_id: str = "click_id", value: str = "value", kind: str = "kind", goal: str = GOAL, barred: str = BARRED, within: int = WITHIN, greedy: bool = False) -> DataFrame:
    """(key, match_no, first_id, last_id, n_rows, sum_cents, labels) of every match.

    Rows that are equal in all columns (those not named here by a 64-bit hash)
    count once; rows without a key or time are left out; those that share key,
    time and id are in the order of a hash of their other columns.  An amount
    that is null, not a number, infinite or over 2**55 fits no letter; a null
    kind fits A only.  An id may be null, and then comes before others.  An
    empty table has no matches.  Columns of other names do not matter beyond
    being part of what makes rows equal.

    ``within`` is in microseconds.  No task gets more than its range of rows and
    one segment that crosses ranges; such a segment, and each match's labels,
    are in one task's memory (about 60 bytes a row).
    """
    others = [F.col(f"`{c}`") for c in rows.columns]
    code = F.when(F.col(kind) == goal, 2).when(F.col(kind) != barred, 1).otherwise(0).cast("byte")
    slim = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(ts).alias("ts"), F.col(row_id).cast("long").alias("id"), cents_of(F.col(value)).alias("cents"), code.alias("code"), F.xxhash64(*(c.isNull() for c in others), *others).alias("digest"))
    dealt = slim.repartitionByRange("key", "ts", "id").sortWithinPartitions("key", "ts", "id", "digest")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n = TaskContext.get().partitionId(), 0

        def stream() -> Iterator[_Rows]:
            nonlocal n
            for batch in batches:
                if batch.num_rows:
                    yield _columns(batch, p, n)
                    n += batch.num_rows

        begun = False
        for part, last in _cut(stream(), within):
            if last:
                yield _edge(part, begun)
                continue
            first = 0
            if not begun:  # what comes before the first break may go on from the block before
                step, goals = _flags(part, within)
                inner = np.flatnonzero(~step[1:] & ~goals[1:])
                first = int(inner[0]) + 1 if len(inner) else len(part)
                yield _edge(part.cut(0, first), False)
            begun = True
            yield from _padded(_found(part.cut(first), within, greedy))
        release()

    bounded(rows)
    done = written(dealt.mapInArrow(blocks, f"{_FOUND}, {_EDGE}"), "blocks")
    edges = done.where("tail is not null")
    # one row a block: the last block before it that has a break is where its first rows' segment begins
    open_ = edges.groupBy("p").agg(F.max("tail").alias("tail"))
    before = F.last(F.when(F.col("tail"), F.col("p")), ignorenulls=True).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    open_ = open_.select(F.col("p").alias("q"), F.coalesce(before, F.lit(-1)).alias("begin"))
    crossing = edges.join(open_.hint("shuffle_merge"), F.col("p") == F.col("q")).select(F.when(F.col("tail"), F.col("p")).otherwise(F.col("begin")).alias("chain"), "p", "pos", "key", "ts", "id", "cents", "code", "digest")
    crossing = crossing.repartition("chain").sortWithinPartitions("chain", "p", "pos")

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chain begins with a row that nothing crosses, or with the first row of all
        chain: list[_Rows] = []
        name = None

        def flush() -> Iterator[pa.RecordBatch]:
            for part, _ in _cut(iter(chain), within):
                found = _found(part, within, greedy)
                if found is not None:
                    yield found

        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            rows = _columns(batch)
            bounds = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a < b:
                    if names[a] != name:
                        yield from flush()
                        chain, name = [], names[a]
                    chain.append(rows.cut(a, b))
        yield from flush()
        release()

    inner = done.where("tail is null").select(*(f.split()[0] for f in _FOUND.split(", ")))
    found = written(inner.union(crossing.mapInArrow(chains, _FOUND)), "matches")
    # how many matches of its key come before each block: a row for each key and block
    counts = found.groupBy("key", "p").agg(F.count("*").alias("n"))
    counts = counts.select("key", "p", (F.sum("n").over(Window.partitionBy("key").orderBy("p")) - F.col("n")).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("key", "p").orderBy("pos"))
    numbered = found.join(counts.hint("shuffle_merge"), ["key", "p"]).withColumn("match_no", F.col("earlier") + rank)
    return numbered.select(F.col("key").alias(key), "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels")


ORACLE = """WITH RECURSIVE c AS (
  SELECT *, CAST(floor(100 * value + 0.5) AS BIGINT) AS cents, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS k
  FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT *, lag(cents) OVER w AS before, lag(ts) OVER w AS earlier FROM c WINDOW w AS (PARTITION BY client_id ORDER BY k)),
f AS (SELECT client_id, k, click_id, cents, cents < before AS down,
  coalesce(ts <= earlier + INTERVAL 10 MINUTE AND cents <> before AND kind <> 'error', false) AS step,
  coalesce(ts <= earlier + INTERVAL 10 MINUTE AND before IS NOT NULL AND cents IS NOT NULL AND kind = 'purchase', false) AS goal FROM l),
s AS (SELECT *, sum(CASE WHEN step OR goal THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY k) AS part,
  min(CASE WHEN NOT step THEN k END) OVER (PARTITION BY client_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS high,
  max(k) OVER (PARTITION BY client_id) AS most FROM f),
e AS (SELECT a.client_id, a.part, a.k, min(p.k) AS last FROM s a JOIN s p ON p.client_id = a.client_id AND p.part = a.part AND p.k > a.k AND p.k <= coalesce(a.high, a.most) AND p.goal AND p.cents >= a.cents GROUP BY ALL),
g AS (SELECT client_id, part, min(k) AS k, max(k) AS most FROM s GROUP BY ALL
  UNION ALL SELECT g.client_id, g.part, coalesce(e.last, g.k) + 1, g.most FROM g LEFT JOIN e ON e.client_id = g.client_id AND e.part = g.part AND e.k = g.k WHERE g.k < g.most),
m AS (SELECT e.client_id, e.k, e.last FROM g JOIN e ON e.client_id = g.client_id AND e.part = g.part AND e.k = g.k),
r AS (SELECT m.client_id, m.k, count(*) AS n_rows, CAST(sum(s.cents) AS BIGINT) AS sum_cents, arg_min(s.click_id, s.k) AS first_id, arg_max(s.click_id, s.k) AS last_id,
  sha256(string_agg(CASE WHEN s.k = m.k THEN 'A' WHEN s.k = m.last THEN 'P' WHEN s.down THEN 'D' ELSE 'U' END, '' ORDER BY s.k)) AS labels_sha256
  FROM m JOIN s ON s.client_id = m.client_id AND s.k BETWEEN m.k AND m.last GROUP BY ALL)
SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY k) AS match_no, first_id, last_id, n_rows, sum_cents, labels_sha256 FROM r"""
