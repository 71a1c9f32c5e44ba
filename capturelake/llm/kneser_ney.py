"""Language model scoring: interpolated modified Kneser-Ney.

Tokens are counted first and numbered by their places in files sorted by hash.
The n-grams of the highest order are counted in runs of texts and dealt, packed,
to shards by the token before their last one.  All shorter n-grams that end in
the same two tokens meet there too, so one shuffle serves every order down to
two.  A frequent token is cut into pieces by the token before it; only its
bigrams meet once more.  Each shard's counts and contexts become arrays sorted
by hash in a file of the shared folder; workers map the files into memory and
look up whole batches at once.

A token is known by the 64-bit hash of its bytes, an n-gram by its shard and 48
bits of the chained hash of its tokens' numbers: of the n-grams that were never
seen about one in 1e8 is taken for one that was.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.arrays import Counts, Files, Packed, Words, pack, pack_counts, pack_words, scattered, scattered_column, shard_of, write_file
from capturelake.llm.common import bucket, forget, map_batches, mix, pieces, release, shared_path, text_column, written

ORDER = 3
#: Bytes of text whose n-grams are counted before they are shuffled.
RUN_BYTES = 16 << 20
#: About so many training tokens make a shard, and a quarter of it a piece of a frequent token.
SHARD_TOKENS = 1 << 21
#: Distinct tokens in a shard of tokens; the most tokens that are cut into pieces.
SHARD_WORDS, MOST_CUT = 1 << 20, 1 << 20
END = xxhash.xxh3_64_intdigest(b"", 1)
_SEED = 42


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text's words and one end, and
    where each text ends."""
    found, ends, n = [], np.empty(len(texts), np.int64), 0
    for i, t in enumerate(texts):
        words = t.lower().split()
        row = np.empty(len(words) + 1, np.uint64)
        row[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        row[-1] = END
        found.append(row)
        n += len(row)
        ends[i] = n
    return np.concatenate(found), ends


def contexts(hashes: np.ndarray, ends: np.ndarray, n: int, start: int) -> list[np.ndarray]:
    """The n - 1 tokens before each token, nearest last; ``start`` before a text."""
    out = []
    starts = np.concatenate([[0], ends[:-1]])
    first = np.arange(len(hashes)) - np.repeat(starts, ends - starts)
    for back in range(n - 1, 0, -1):
        before = np.empty_like(hashes)
        before[back:] = hashes[:-back] if back < len(hashes) else hashes[:0]
        before[first < back] = start
        out.append(before)
    return out


def gram(parts: list[np.ndarray]) -> np.ndarray:
    """The chained hash of tokens in order."""
    h = np.uint64(_SEED)
    for p in parts:
        h = mix(p, h)
    return h


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c): the count of every distinct token."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batch.column(0), RUN_BYTES):
            h, c = np.unique(tokens(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return map_batches(docs.select(text_column(text).alias("text")), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Where the files are, and the numbers that hold for all: tokens ``n``,
    distinct tokens ``v``, discounts of each order, the counts of the empty
    context and of the start of a text, the frequent tokens and in how many
    pieces each is, the files of tokens and of what is known of them, of
    n-grams, and of frequent tokens' bigrams, by shard.

    A token's number is its shard, shifted by ``shift``, and its place in the
    shard's file; the next two numbers are a text's start and any other token.
    """

    path: str
    order: int
    n: int
    v: int
    shift: int = 0
    tokens: list[str] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    pieces: list[int] = field(default_factory=list)
    shards: int = 1
    grams: list[str] = field(default_factory=list)
    bigrams: list[str] = field(default_factory=list)
    follows: list[str] = field(default_factory=list)
    discounts: list[list[float]] = field(default_factory=list)
    empty: list[int] = field(default_factory=lambda: [0] * 4)
    begin: list[int] = field(default_factory=lambda: [0] * 4)

    @property
    def start(self) -> int:
        return len(self.tokens) << self.shift

    @property
    def bits(self) -> int:
        return _bits(self.start + 2)

    def in_pieces(self, token: np.ndarray) -> np.ndarray:
        """In how many pieces the n-grams of each token are."""
        if not self.cut:
            return np.ones(len(token), np.int64)
        cut, n = np.array(self.cut), np.array(self.pieces)
        at = np.minimum(np.searchsorted(cut, token), len(cut) - 1)
        return np.where(cut[at] == token, n[at], 1)

    def shard(self, token: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The shard of n-grams with ``token`` before the last one: one of its
        pieces, by the token before it."""
        piece = mix(before, 7) % self.in_pieces(token).astype(np.uint64)
        return shard_of(mix(piece, mix(token, 13)), self.shards).astype(np.int64)


class Dictionary:
    """A worker's view of the tokens: numbers and counts by hash."""

    def __init__(self, model: Model) -> None:
        self.m, self.files = model, Files(model.path, model.tokens)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and counts of distinct hashes in order."""
        ids, c = np.full(len(h), self.m.start + 1, np.int64), np.zeros(len(h), np.int64)
        shard = scattered(h, max(1, len(self.m.tokens)))
        for i, name in enumerate(self.m.tokens):
            own = np.flatnonzero(shard == i) if name else ()
            if len(own):
                place, c[own] = Words(self.files.raw(i)).find(h[own])
                ids[own] = np.where(place >= 0, (i << self.m.shift) + place, self.m.start + 1)
        return ids, c


#: What a task gives besides its file.  file: its number, the name, and how
#: many tokens are in it.  stats: an order, and how many of its n-grams have
#: the counts one to four.  token: a token, how many different tokens come
#: before it, and of what follows it the numbers with counts one, two and more
#: and their total.  cut: a frequent token's bigram and its count so far, or
#: such a token and its count.
_SIDE = "kind string, x long, y long, a long, b long, c long, d long, e long, name string"


def _side(kind: str, x: np.ndarray, y: np.ndarray | None = None, sums: tuple = (), name: str | None = None) -> pa.RecordBatch:
    n = len(x)
    columns = [np.asarray(s, np.int64) for s in (x, y if y is not None else np.zeros(n), *sums)]
    columns += [np.zeros(n, np.int64)] * (7 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), *map(pa.array, columns), pa.array([name] * n, pa.string())], ["kind", "x", "y", "a", "b", "c", "d", "e", "name"])


def _stats(order: int, counts: np.ndarray) -> pa.RecordBatch:
    found = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)
    return _side("stats", np.array([order]), sums=tuple([k] for k in found[1:5]))


def _whole(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray] | None:
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    table = pa.Table.from_batches(got)
    return [table.column(i).to_numpy() for i in range(columns)]


def _number(counts: DataFrame, model: Model) -> None:
    """Write the tokens' files, and say which tokens are cut."""
    shards, most = max(1, -(-model.v // SHARD_WORDS)), max(SHARD_TOKENS // 4, model.n // MOST_CUT)
    path = model.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _whole(batches, 2)) is not None:
            h, c = got[0].view(np.uint64), got[1]
            shard, order = int(scattered(h[:1], shards)[0]), np.argsort(h)
            h, c = h[order], c[order]
            yield _side("file", np.array([shard]), sums=([len(h)],), name=write_file(path, f"tokens-{shard}", pack_words(h, c)))
            large = np.flatnonzero(c > most)
            yield _side("cut", np.full(len(large), shard), large, (c[large],))

    dealt = counts.select("h", "c", scattered_column(F.col("h"), shards).alias("_to")).repartitionById(shards, F.col("_to"))
    found = dealt.select("h", "c").mapInArrow(run, _SIDE).collect()
    model.tokens = [""] * shards
    for r in found:
        if r.kind == "file":
            model.tokens[r.x] = r.name
            model.shift = max(model.shift, _bits(r.a))
    cut = sorted(((r.x << model.shift) + r.y, -(-r.a // most)) for r in found if r.kind == "cut")
    model.cut, model.pieces = [x for x, _ in cut], [k for _, k in cut]
    model.shards = max(1, -(-model.n // SHARD_TOKENS))


def _bits(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def _distinct(columns: list[np.ndarray], n: np.ndarray | None, bits: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` in order, with the sums of ``n`` (their
    numbers, without)."""
    rows = len(columns[0])
    if sum(bits) <= 64:
        key = np.zeros(rows, np.uint64)
        for c, b in zip(columns, bits, strict=True):
            key = (key << np.uint64(b)) | c.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(rows - 1, bool)
        for c in columns:
            new |= c[order][1:] != c[order][:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    sums = np.diff(np.append(first, rows)) if n is None else np.add.reduceat(n[order], first)
    return [c[order[first]] for c in columns], sums


def _encode(columns: list[np.ndarray], n: np.ndarray, size: int) -> bytes:
    """Rows of tokens, in order, with their counts, byte by byte."""
    whole = [np.diff(columns[0], prepend=0), *columns[1:]]
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes() for c in whole]
    large = n[n >= 255].astype(np.int64)
    body = zstandard.ZstdCompressor(level=1).compress(b"".join([*planes, np.minimum(n, 255).astype(np.uint8).tobytes()]))
    return b"".join([struct.pack("<II", len(n), len(large)), large.tobytes(), body])


def _decode(data: bytes, width: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    n, large = struct.unpack_from("<II", data)
    whole = np.frombuffer(data, np.int64, large, 8)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 + 8 * large :], n * (width * size + 1)), np.uint8)
    columns = []
    for i in range(width):
        full = np.zeros((n, 8), np.uint8)
        full[:, :size] = body[i * size * n : (i + 1) * size * n].reshape(size, n).T
        columns.append(full.view("<i8").ravel())
    columns[0] = np.cumsum(columns[0])
    counts = body[width * size * n :].astype(np.int64)
    counts[counts == 255] = whole
    return columns, counts


def count_grams(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(shard, grams): the n-grams of the highest order, counted within runs of
    texts and packed by shard.  The columns of a row are the token before the
    last one, those before it, nearest first, and the last one."""
    open_: list[Dictionary] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not open_:
            open_.append(Dictionary(model))
        for _, texts in pieces(batch.column(0), RUN_BYTES):
            hashes, ends = tokens(texts)
            h, ids = np.unique(hashes, return_inverse=True)
            del hashes
            # numbered anew in the order of the tokens' numbers, the start last
            number = open_[0].find(h)[0]
            order = np.argsort(number)
            rank = np.empty(len(h), np.int32)
            rank[order] = np.arange(len(h), dtype=np.int32)
            ids, number = rank[ids], np.concatenate([number[order], [model.start]])
            columns = [*contexts(ids, ends, model.order, len(h))[::-1], ids]
            columns, n = _distinct(columns, None, [_bits(len(number))] * model.order)
            del ids
            columns = [number[c] for c in columns]
            shard = model.shard(columns[0], columns[1])
            by = np.argsort(shard.astype(np.uint16) if model.shards < 1 << 16 else shard, kind="stable")
            edges = np.searchsorted(shard[by], np.arange(model.shards + 1))
            full = np.flatnonzero(np.diff(edges))
            made = [_encode([c[by[edges[i] : edges[i + 1]]] for c in columns], n[by[edges[i] : edges[i + 1]]], -(-model.bits // 8)) for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(made, pa.binary())], ["shard", "grams"])

    return map_batches(docs.select(text_column(text).alias("text")), run, "shard int, grams binary")


def _discounts(stats: dict[int, int]) -> list[float]:
    """The discounts of counts one, two and more, from how many n-grams have
    the counts one to four; 0.5, 1, 1.5 (bounded so) where these are too few."""
    n1, n2, n3, n4 = (stats.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]


def _following(counts: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of the counts of each context, which begin at ``first``: how many are one,
    two and more, and their total."""
    return [np.add.reduceat(x.astype(np.int64), first) for x in (counts == 1, counts == 2, counts > 2, counts)]


def _first(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new row begins in ``columns``, which are in order."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _of_tokens(p: np.ndarray, w: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What bigrams in order of their first tokens tell of single tokens."""
    if len(n):
        first = _first([p])
        yield _side("token", p[first], sums=(np.zeros(len(first)), *_following(n, first)))
        last, before = np.unique(w, return_counts=True)
        yield _side("token", last, sums=(before,))


def _shards(grams: DataFrame, model: Model) -> DataFrame:
    """Add up each shard's n-grams of all orders but one, write its file, and
    return the rest (see _SIDE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        shard = 0
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = i
                got.append(_decode(data.as_py(), model.order, -(-model.bits // 8)))
        if not got:
            return
        columns, n = [np.concatenate([c[i] for c, _ in got]) for i in range(model.order)], np.concatenate([k for _, k in got])
        del got
        own, columns[0] = np.unique(columns[0], return_inverse=True)
        bits = [_bits(len(own)), *[model.bits] * (model.order - 1)]
        hashes, counts, keys, follow = [], [], [], []
        for k in range(model.order, 1, -1):
            columns, n = _distinct(columns, n, [*bits[: k - 1], model.bits])
            before = [*columns[-2:0:-1], own[columns[0]]]
            h = gram([*before, columns[-1]])
            if k == 2:
                cut = model.in_pieces(own)[columns[0]] > 1
                whole = np.flatnonzero(~cut)
                yield _side("cut", before[0][cut], columns[1][cut], (n[cut],))
                yield from _of_tokens(before[0][whole], columns[1][whole], n[whole])
                h, n = h[whole], n[whole]
            else:
                first = _first(columns[:-1])
                keys.append(gram([b[first] for b in before]))
                follow.append(_following(n, first))
            hashes.append(h)
            counts.append(n)
            yield _stats(k, n)
            columns, n = [*columns[: k - 2], columns[-1]], None
        parts = pack(np.concatenate(hashes), [np.concatenate(counts)])
        parts += pack(np.concatenate([np.zeros(0, np.uint64), *keys]), [np.concatenate([np.zeros(0, np.int64), *(f[i] for f in follow)]) for i in range(4)])
        yield _side("file", np.array([shard]), name=write_file(model.path, f"grams-{shard}", parts))
        del hashes, counts, keys, follow, parts, columns, n
        release()

    return written(grams.repartitionById(model.shards, F.col("shard")).mapInArrow(run, _SIDE), "shards")


def _bigrams(summed: DataFrame, model: Model) -> DataFrame:
    """The frequent tokens' bigrams (x, y) and their counts: a file a shard of
    the bigram, and the rest (see _SIDE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _whole(batches, 3)) is not None:
            p, w, n = got
            h = gram([p, w])
            shard = int(scattered(h[:1], model.shards)[0])
            yield _stats(2, n)
            yield _side("file", np.array([shard]), name=write_file(model.path, f"bigrams-{shard}", pack(h, [n])))

    # xxhash64 of two longs is their gram()
    dealt = summed.withColumn("_to", scattered_column(F.xxhash64("x", "y"), model.shards)).repartitionById(model.shards, F.col("_to"))
    return written(dealt.select("x", "y", "a").mapInArrow(run, _SIDE), "bigrams")


def _follows(side: DataFrame, summed: DataFrame | None, model: Model) -> list:
    """Write what is known of each token, by its place, a file a shard of
    tokens; the rest (see _SIDE), with the counts of the empty context as
    ``empty`` and those of a text's start as ``begin``."""
    shards, shift = len(model.tokens), model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _whole(batches, 6)) is None:
            return
        shard = int(got[0][0]) >> shift
        if shard == shards:
            yield _side("begin", np.zeros(1), sums=tuple(x[:1] for x in got[2:]))
            return
        place = got[0] & ((1 << shift) - 1)
        columns = [np.zeros(int(place.max()) + 1, np.int64) for _ in range(5)]
        for c, x in zip(columns, got[1:], strict=True):
            c[place] = x
        n = columns[0][columns[0] > 0]
        yield _stats(1, n)
        if len(n):
            yield _side("empty", np.zeros(1), sums=tuple(_following(n, np.zeros(1, np.int64))))
        yield _side("file", np.array([shard]), name=write_file(model.path, f"follows-{shard}", pack_counts(columns)))

    rows = side.where("kind = 'token'").select("x", *"abcde")
    if summed is not None:
        none = F.lit(0).cast("long")
        rows = rows.union(summed.select("y", F.lit(1).cast("long"), none, none, none, none))
        rows = rows.union(summed.select("x", none, *(x.cast("long") for x in (F.col("a") == 1, F.col("a") == 2, F.col("a") > 2, F.col("a")))))
    rows = rows.groupBy("x").agg(*(F.sum(c).alias(c) for c in "abcde"))
    dealt = rows.repartitionById(shards + 1, F.shiftright("x", shift).cast("int"))
    return dealt.mapInArrow(run, _SIDE).collect()


def train(docs: DataFrame, order: int = ORDER, text: str = "text", path: str | None = None) -> Model:
    """Count and write the model of ``docs``; see the module's description.

    With counts c (raw at the highest order and, below, numbers of distinct
    tokens before) the probability of a token in a context is
    max(c - D(c), 0) / total, plus the context's remaining weight times the
    next lower order's probability; order one is interpolated with 1 / (V + 1),
    the share of any unseen token.  The number of shards follows the number of
    tokens; the driver gets a file name and some numbers of each, and the
    tokens that are more frequent than a quarter of a shard (MOST_CUT at most).
    """
    counts = written(count_words(docs, text), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = Model(path or shared_path(docs.sparkSession, "model"), order, int(n), int(v))
    _number(counts, model)
    if order == 1:
        small = [F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]
        *stats, more, total = counts.agg(*small, F.count_if(F.col("c") > 2), F.coalesce(F.sum("c"), F.lit(0))).first()
        model.discounts, model.empty = [_discounts(dict(enumerate(stats, 1)))], [stats[0], stats[1], more, total]
        forget(counts)
        return model
    forget(counts)
    sides, summed = [_shards(count_grams(docs, model, text), model)], None
    if model.cut:
        summed = written(sides[0].where("kind = 'cut'").groupBy("x", "y").agg(F.sum("a").alias("a")), "summed")
        sides.append(_bigrams(summed, model))
    last = _follows(sides[0], summed, model)
    found = [[r for r in s.where("kind in ('file', 'stats')").collect()] for s in sides]
    for table in [*sides, *([summed] if summed is not None else [])]:
        forget(table)

    def files(rows: list, shards: int) -> list[str]:
        names = {r.x: r.name for r in rows if r.kind == "file"}
        return [names.get(i, "") for i in range(shards)] if names else []

    def sums(rows: list, kind: str, x: int = 0) -> list[int]:
        own = [r for r in rows if r.kind == kind and r.x == x]
        return [sum(r[i] for r in own) for i in range(3, 7)]

    model.follows, model.grams = files(last, len(model.tokens)), files(found[0], model.shards)
    model.bigrams = files(found[1], model.shards) if len(found) > 1 else []
    every = [last, *([sum(found, [])] * (order - 1))]
    model.discounts = [_discounts(dict(enumerate(sums(rows, "stats", k), 1))) for k, rows in enumerate(every, 1)]
    model.empty, model.begin = sums(last, "empty"), sums(last, "begin")
    return model


class _Lookup:
    """Finds the counts of hashes in files of one kind."""

    def __init__(self, path: str, names: list[str], sections: list[int]) -> None:
        self.files, self.sections = Files(path, names), sections

    def find(self, section: int, h: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
        """The counts of each hash in its shard, zero where there are none."""
        out = [np.zeros(len(h), np.int64) for _ in range(self.sections[section])]
        n = len(self.files.names)
        # in order of the files and, within a file, of the hashes
        if n < 1 << 16:
            by = np.argsort((shard.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
        else:
            by = np.lexsort((h, shard))
        edges = np.searchsorted(shard[by], np.arange(n + 1))
        for i in np.flatnonzero(np.diff(edges)):
            raw, at, own = self.files.raw(int(i)), 0, by[edges[i] : edges[i + 1]]
            if len(raw):
                for width in self.sections[: section + 1]:
                    part = Packed(raw, at, width)
                    at = part.end
                for o, c in zip(out, part.find(h[own]), strict=True):
                    o[own] = c
        return out


class Scorer:
    """Looks up batches of texts; a worker opens one."""

    def __init__(self, model: Model) -> None:
        self.m, self.tokens = model, Dictionary(model)
        self.follows = Files(model.path, model.follows)
        self.grams = _Lookup(model.path, model.grams, [1, 4])
        self.bigrams = _Lookup(model.path, model.bigrams, [1])

    def _less(self, k: int, c: np.ndarray) -> np.ndarray:
        """Counts of an order less their discounts."""
        d = self.m.discounts[k - 1]
        return c - np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2])

    def _rest(self, k: int, follow: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The totals of contexts (one if there are none), and the weight that is
        left for the next lower order."""
        a, b, c, total = follow
        d = self.m.discounts[k - 1]
        seen = total > 0
        total = np.where(seen, total, 1)
        return total, np.where(seen, (a * d[0] + b * d[1] + c * d[2]) / total, 1.0)

    def _known(self, ids: np.ndarray) -> list[np.ndarray]:
        """What is known of each token, and of a text's start."""
        out = [np.zeros(len(ids), np.int64) for _ in range(5)]
        shard = ids >> self.m.shift
        for i, name in enumerate(self.m.follows):
            own = np.flatnonzero((shard == i) & (ids <= self.m.start)) if name else ()
            if len(own):
                counts = Counts(self.follows.raw(i), 0, 5)
                place = ids[own] & ((1 << self.m.shift) - 1)
                inside = place < len(counts.small[0])
                for o, c in zip(out, counts.at(place[inside]), strict=True):
                    o[own[inside]] = c
        for o, c in zip(out[1:], self.m.begin, strict=True):
            o[ids == self.m.start] = c
        return out

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, score."""
        m = self.m
        hashes, ends = tokens(texts)
        alone, w = np.unique(hashes, return_inverse=True)
        ids, c = self.tokens.find(alone)
        base = np.log10((c + 0.5) / (m.n + 0.5 * (m.v + 1)))
        total, rest = self._rest(1, [np.array([x]) for x in m.empty])
        if m.order == 1:
            log = np.log10(self._less(1, c) / total + rest / (m.v + 1))[w]
        else:
            ids = np.append(ids, m.start)
            n, *follow = self._known(ids)
            one = self._less(1, n) / total + rest / (m.v + 1)
            # each distinct n-gram once, in order of the token before its last
            columns = [*contexts(w, ends, m.order, len(alone))[::-1], w]
            columns, of = _numbered(columns, [_bits(len(ids))] * m.order)
            p = self._grams(ids, one, follow, columns)
            log = np.log10(p)[of]
        starts = np.concatenate([[0], ends[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        return ends - starts, add((c > 0).astype(np.int64)[w]), add(base[w]), add(log)

    def _grams(self, ids: np.ndarray, one: np.ndarray, follow: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
        """The probabilities of n-grams: columns as in count_grams, by places in ``ids``."""
        m, p, w = self.m, one[columns[-1]], ids[columns[-1]]
        spread = [_Runs(columns[:k]) for k in range(1, m.order)]
        runs = spread[min(1, len(spread) - 1)]
        if m.order > 2:
            shard = runs.repeat(m.shard(*(ids[c[runs.first]] for c in columns[:2])))
        else:
            shard = m.shard(ids[columns[0]], w)
        cut = m.in_pieces(ids)[columns[0]] > 1
        for k, runs in enumerate(spread, 2):
            context = gram([ids[c[runs.first]] for c in columns[k - 2 :: -1]])
            h = mix(w, runs.repeat(context))
            if k == 2:
                found, own = np.zeros(len(h), np.int64), np.flatnonzero(~cut)
                found[own] = self.grams.find(0, h[own], shard[own])[0]
                own = np.flatnonzero(cut)
                found[own] = self.bigrams.find(0, h[own], scattered(h[own], m.shards).astype(np.int64))[0]
                total, rest = (x[columns[0]] for x in self._rest(2, follow))
            else:
                found = self.grams.find(0, h, shard)[0]
                total, rest = (runs.repeat(x) for x in self._rest(k, self.grams.find(1, context, shard[runs.first])))
            p = self._less(k, found) / total + rest * p
        return p


class _Runs:
    """Where equal rows of columns, which are in order, begin."""

    def __init__(self, columns: list[np.ndarray]) -> None:
        self.first = _first(columns)
        self.times = np.diff(np.append(self.first, len(columns[0])))

    def repeat(self, x: np.ndarray) -> np.ndarray:
        """What each first row has, for each row."""
        return np.repeat(x, self.times)


def _numbered(columns: list[np.ndarray], bits: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` in order, and which of them each row is."""
    if sum(bits) <= 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for c, b in zip(columns, bits, strict=True):
            key = (key << np.uint64(b)) | c.astype(np.uint64)
        order = np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    first = _first([c[order] for c in columns])
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return [c[order[first]] for c in columns], of


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity)
    of every row.

    A null or empty text is one end.  Without any training token every token
    is unseen with probability 1 (V is 0).  Repeated rows each give a row;
    other columns are not read.
    """
    open_: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not open_:
            open_.append(Scorer(model))
        for first, texts in pieces(batch.column(1)):
            n, known, base, own = open_[0].batch(texts)
            columns = [batch.column(0).slice(first, len(texts)), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.n)), pa.array(base), pa.array(own), pa.array(10 ** (-own / n))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text"))
    return map_batches(chosen, run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def save(spark: SparkSession, model: Model) -> None:
    """Write the model's description beside its files."""
    spark.createDataFrame([(json.dumps(model.__dict__),)], "value string").coalesce(1).write.text(f"{model.path}/model")


def load(spark: SparkSession, path: str) -> Model:
    return Model(**json.loads(spark.read.text(f"{path}/model").first()[0]))


def evaluate(docs: DataFrame, folds: int = 5, held_out: int = 1, order: int = ORDER) -> DataFrame:
    """Every document scored by the model of those that are not held out."""
    model = train(docs.where(bucket("doc_id", folds) != held_out), order)
    return score(docs, model).withColumn("held_out", bucket("doc_id", folds) == held_out)
