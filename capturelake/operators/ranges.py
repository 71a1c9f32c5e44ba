"""The chain of frame headers in parallel within a file.

A file's candidates are dealt to ranges of its bytes.  A range is folded twice
without knowing what comes before it: from a chain that has not begun, and from
one that expects what the range's longest chain begins with.  Each fold is a
map: from which states it holds, and how many frames and samples it adds.  The
maps, a row a range, are composed along the file.  Where a state comes that no
map holds for, the next range with a candidate that this state can take is
looked up and folded from it; that repeats until all files are through.  So the
result is that of the fold in order, and no task gets more than a range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.operators.frames import RELEASE, Chain
from capturelake.shared import materialised

#: Bytes of a file in a range; files that are broadcast at most; rows that a task gives on at once.
RANGE, FEW, ROWS = 64 << 20, 10_000, 10_000

_STATE = "running bigint, number bigint, next bigint, counted bigint, frames bigint"
_MAP = f"range bigint, begun0 boolean, {', '.join(x.replace(' ', '0 ', 1) for x in _STATE.split(', '))}, variable boolean, value bigint, first_off bigint, others array<bigint>, counted bigint, frames bigint, next bigint"
_ENTRY = f"range bigint, begun boolean, {_STATE}, pending boolean, open boolean"
_CANDIDATE = ["off", "block_size", "hlen", "number", "variable", "skip"]
_ENTERED = ["s_begun", *(f"s_{f.split()[0]}" for f in _STATE.split(", "))]


def _guess(x: list[tuple]) -> tuple[bool, int]:
    """The kind and number that the longest chain of a range's candidates (off,
    size, hlen, number, variable, skip) begins with."""
    seen: dict[tuple[bool, int], tuple[int, int]] = {}
    best = (0, False, 0)
    for off, size, hlen, number, variable, skip in reversed(x):
        at, n = seen.get((variable, number + (size if variable else 1)), (0, 0))
        here = 1 + (n if at >= off + max(hlen, skip) else 0)
        seen[variable, number] = (off, here)
        if here >= best[0]:
            best = (here, variable, number)
    return best[1], best[2]


def _suppose(x: list[tuple], variable: bool, value: int) -> tuple:
    """(first offset, others, counted, frames, next) from a begun chain that
    expects ``value``: what the other kind of candidate would have had to expect
    to be taken is in ``others``, so that it holds for all other states."""
    counted = frames = follow = 0
    first, others = None, set()
    for off, size, hlen, number, kind, skip in x:
        if off < follow:
            continue
        if kind != variable:
            others.add(number - (counted if kind else frames))
        elif number == value + (counted if kind else frames):
            first = off if first is None else first
            counted, frames, follow = counted + size, frames + 1, off + max(hlen, skip)
    return first, sorted(others) or None, counted, frames, follow


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal keys in a sorted stream.  Most have few rows: they
    are tuples, as a frame for each would cost more than its fold."""
    held, name = [], None
    for batch in batches:
        rows = zip(zip(*(batch[k].tolist() for k in keys), strict=True), zip(*(batch[c].tolist() for c in columns), strict=True), strict=True)
        for here, run in groupby(rows, itemgetter(0)):
            if here != name:
                if held:
                    yield name, held
                held, name = [], here
            held.extend(x for _, x in run)
    if held:
        yield name, held


def _framed(rows: Iterator[tuple], key: str, schema: str) -> Iterator[pd.DataFrame]:
    names, out = [key, *(f.split()[0] for f in schema.split(", "))], []
    for row in rows:
        out.append(row)
        if len(out) >= ROWS:
            yield pd.DataFrame(out, columns=names, dtype=object)
            out = []
    if out:
        yield pd.DataFrame(out, columns=names, dtype=object)


def _dealt(frames: DataFrame, key: str, min_frame: str | None, size: int) -> DataFrame:
    skip = (F.coalesce(F.col(min_frame), F.lit(0)) if min_frame else F.lit(0)).cast("bigint")
    long = [F.col(c).cast("bigint").alias(c) for c in ("off", "block_size", "hlen", "number")]
    return frames.where(F.col("off").isNotNull() & F.col(key).isNotNull()).select(key, F.floor(F.col("off") / size).alias("range"), *long, "variable", skip.alias("skip"))


def _in_order(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "range").sortWithinPartitions(key, "range", "off", "block_size", "hlen", "number", "variable")


def _maps(dealt: DataFrame, key: str, kind: str, release: int) -> DataFrame:
    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for (k, r), x in _grouped(batches, [key, "range"], _CANDIDATE):
            c = Chain(x[0][5], release)
            for off, size, hlen, number, variable, _ in x:
                c.take(off, size, hlen, number, variable)
            guess = _guess(x)
            yield k, r, c.begun, c.running, c.number, c.next, c.counted, c.frames, *guess, *_suppose(x, *guess)

    return _in_order(dealt, key).mapInPandas(lambda batches: _framed(maps(batches), key, _MAP), f"{key} {kind}, {_MAP}")


def _compose(name: object, maps: list[tuple]) -> list[tuple]:
    """The entries of one file: its maps in order, each with what was looked up
    for it (to, -1 if nothing more is taken, and the state behind it) or None."""
    out = []
    begun, s = False, (0, 0, 0, 0, 0)
    until, fix = None, None
    for at, begun0, running0, number0, next0, counted0, frames0, variable, value, first_off, others, n, k, behind, fixed in maps:
        running, number, follow, counted, frames = s
        entry = (name, at, begun, *s)
        if until is not None and at < until:
            out.append((*entry, False, False))
            continue
        if until is not None:  # this range was folded from this very state
            s, until = tuple(fix[1:]), None
        elif not begun:
            begun, s = begun0, (running0, number0, next0, counted0, frames0)
        elif (running if variable else number) == value and follow <= first_off and (others is None or (number if variable else running) not in others):
            s = (running + n, number + k, behind, counted + n, frames + k)
        elif fixed is not None:
            fix = [int(x) for x in fixed]
            if fix[0] < 0:
                until = float("inf")  # nothing more is taken
            elif fix[0] == at:
                s = tuple(fix[1:])
            else:
                until = fix[0]
        else:
            return [*((*row[:-1], True) for row in out), (*entry, True, True)]
        out.append((*entry, False, False))
    return [*out, (name, None, begun, *s, False, False)]


def _composed(maps: DataFrame, key: str, kind: str) -> DataFrame:
    names = [*(f.split()[0] for f in _MAP.split(", ")), "fixed"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = _grouped(batches, [key], names)
        yield from _framed((row for (k,), x in files for row in _compose(k, x)), key, _ENTRY)

    return maps.repartition(key).sortWithinPartitions(key, "range").mapInPandas(run, f"{key} {kind}, {_ENTRY}")


def _folded(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """The state after each range of candidates that come with the one before it."""
    schema = f"to bigint, {_STATE}"

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for (k, r), x in _grouped(batches, [key, "range"], _CANDIDATE + _ENTERED):
            c = _entered(x[0], RELEASE)
            for off, size, hlen, number, variable, *_ in x:
                c.take(off, size, hlen, number, variable)
            yield k, r, c.running, c.number, c.next, c.counted, c.frames

    return _in_order(rows, key).mapInPandas(lambda batches: _framed(folded(batches), key, schema), f"{key} {kind}, {schema}")


def _entered(first: tuple, release: int) -> Chain:
    """A chain in the state that stands beside its candidates."""
    c = Chain(first[5], release)
    c.begun, c.running, c.number, c.next, c.counted, c.frames = first[6:]
    return c


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def entries(dealt: DataFrame, key: str, kind: str, release: int = RELEASE) -> DataFrame:
    """(key, range, begun, running, number, next, counted, frames): the chain's
    state before each range that has candidates, and, without a range, at the end."""
    names = ["running", "number", "next", "counted", "frames"]
    maps = materialised(_maps(dealt, key, kind, release), "maps")
    done, fixes = [], None
    rows = maps.withColumn("fixed", F.lit(None).cast("array<bigint>"))
    while True:
        found = materialised(_composed(rows, key, kind), "entries")
        done.append(found.where("not open").drop("pending", "open"))
        pending = found.where("pending")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)
        stuck = _few(pending.select(F.col(key).alias("_k"), F.col("range").alias("_from"), F.lit(True).alias("s_begun"), *(F.col(n).alias(f"s_{n}") for n in names)))
        here = (F.col(key) == F.col("_k")) & (F.col("range") >= F.col("_from")) & (F.col("off") >= F.col("s_next"))
        takes = F.when(F.col("variable"), F.col("number") == F.col("s_running")).otherwise(F.col("number") == F.col("s_number"))
        target = dealt.join(stuck, here & takes).groupBy("_k").agg(F.min("range").alias("_to"))
        target = materialised(target, "targets")
        rows = dealt.join(_few(target), (F.col(key) == F.col("_k")) & (F.col("range") == F.col("_to"))).drop("_k", "_to").join(stuck, F.col(key) == F.col("_k")).drop("_k", "_from")
        exits = _folded(rows, key, kind)
        fixed = F.array(*(F.coalesce(n, F.lit(-1).cast("bigint")) for n in ("to", *names)))
        more = pending.select(key, "range").join(exits, key, "left").select(F.col(key).alias("_k"), F.col("range").alias("_r"), fixed.alias("fixed"))
        fixes = materialised(more if fixes is None else fixes.unionByName(more), "fixes")
        # only the files that are not through are composed again
        rows = maps.join(pending.select(key), key, "left_semi").join(fixes, (F.col(key) == F.col("_k")) & (F.col("range") == F.col("_r")), "left").drop("_k", "_r")


def chain_in_ranges(frames: DataFrame, key: str = "path", min_frame: str | None = None, release: int = RELEASE, size: int = RANGE) -> DataFrame:
    """(key, counted, n_frames), equal to those of ``frames.chain``, for files of
    any size: a task folds ``size`` bytes of a file's candidates."""
    kind = frames.schema[key].dataType.simpleString()
    dealt = materialised(_dealt(frames, key, min_frame, size), "dealt")  # it is read again for each look-up
    done = entries(dealt, key, kind, release)
    return done.where("range is null").select(key, "counted", F.col("frames").alias("n_frames"))


def chain_frames(frames: DataFrame, key: str = "path", min_frame: str | None = None, release: int = RELEASE, size: int = RANGE) -> DataFrame:
    """(key, off, hlen, block_size, number, variable, first_sample, nth) of the
    frames that the chain takes: what they are in the chain, and how many
    samples come before each."""
    kind = frames.schema[key].dataType.simpleString()
    dealt = _dealt(frames, key, min_frame, size)
    states = entries(dealt, key, kind, release).where("range is not null")
    states = states.select(F.col(key).alias("_k"), F.col("range").alias("_r"), F.col("begun").alias("s_begun"), *(F.col(n).alias(f"s_{n}") for n in ("running", "number", "next", "counted", "frames")))
    rows = dealt.join(states, (F.col(key) == F.col("_k")) & (F.col("range") == F.col("_r"))).drop("_k", "_r")
    schema = "off bigint, hlen int, block_size int, number bigint, variable boolean, first_sample bigint, nth bigint"

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for (k, _), x in _grouped(batches, [key, "range"], _CANDIDATE + _ENTERED):
            c = _entered(x[0], release)
            for off, bs, hlen, number, variable, *_ in x:
                before = c.counted, c.frames
                if c.take(off, bs, hlen, number, variable):
                    yield k, off, hlen, bs, number, variable, *before

    return _in_order(rows, key).mapInPandas(lambda batches: _framed(taken(batches), key, schema), f"{key} {kind}, {schema}")
