"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are dealt into blocks by descending length.  Their coordinates are
rotated by the right singular vectors of all of them, so that the first few
hold most of each length.  A block of queries goes through the blocks, longest
first.  Against a block a query first has the partial products of those few
coordinates; what the remaining ones can add is at most the product of the
remaining lengths (Cauchy-Schwarz).  Vectors whose bound is below the query's
k-th best so far are left out; the others get their exact integer product.  The
search ends at the block whose lengths no query's k-th best can be reached with.

The blocks are files in the shared folder; a task holds one of them and one
block of queries, and gives each query's k best, no more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.arrays import write_file
from capturelake.llm.common import forget, release, shared_path, written

K, SCALE = 20, 64
#: The most vectors in a block, fewer where they would take more bytes as
#: doubles; the most queries in a block.
BLOCK, BLOCK_BYTES, QUERIES = 16384, 16 << 20, 256
#: Queries of a block multiplied at once (bounds the memory of a pair of blocks).
STRIP = 64
#: The range of a long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: The share of the squared lengths that the partial sums have.
ENERGY = 0.5
#: Partitions whose sums are added up at once.
FAN_IN = 256


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v, norm): floor(scale * x) of each component as int64
    bytes, for the vectors that take part: not null, every component finite
    and the id not null.  A scaled component that does not fit a long is an
    error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed, norms = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(scale * x)
                    if len(x) and (x.min() < LEAST or x.max() > MOST):
                        raise OverflowError(f"a component of vector {i}, scaled, does not fit a long")
                    ids.append(i)
                    dims.append(len(x))
                    packed.append(x.astype(np.int64).tobytes())
                    norms.append(float(np.sqrt((x * x).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "dim", "v", "norm"])
        release()

    chosen = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return chosen.mapInArrow(run, "vec_id long, dim int, v binary, norm double")


def rotations(found: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """For each dimension the right singular vectors of all its vectors, by
    descending singular value, and how many of them have the share ENERGY.

    They are the eigenvectors of the sum of outer products, which is added up
    in Spark row by row; the driver gets one matrix for each dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            packed = batch.column(1).to_pylist()
            for d in np.unique(dims[dims > 0]):
                x = np.frombuffer(b"".join(p for p, k in zip(packed, dims, strict=True) if k == d), np.int64).reshape(-1, d).astype(float)
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], ["dim", "i", "m"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in table.column("m").to_pylist()], axis=0)
        return table.select(["dim", "i"]).slice(0, 1).append_column("m", pa.array([total.tobytes()], pa.binary()))

    rows = found.select("dim", "v").mapInArrow(run, "dim int, i int, m binary").withColumn("part", F.floor(F.spark_partition_id() / FAN_IN))
    for keys in (["dim", "i", "part"], ["dim", "i"]):
        rows = rows.groupBy(*keys).applyInArrow(add, "dim int, i int, m binary")
        if "part" in keys:
            rows = rows.withColumn("part", F.lit(0))
    matrices: dict[int, np.ndarray] = {}
    for d, i, m in rows.select("dim", "i", "m").collect():
        matrices.setdefault(d, np.zeros((d, d)))[i] = np.frombuffer(bytes(m))
    out = {0: (np.zeros((0, 0)), 0)}
    for d, m in matrices.items():
        values, basis = np.linalg.eigh(m)
        values, basis = np.maximum(values[::-1], 0), basis[:, ::-1].copy()
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        out[d] = basis, int(min(d, np.searchsorted(share, ENERGY) + 1))
    return out


class _Side:
    """Vectors of a block: integers, rotated first coordinates, remaining lengths."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, head: np.ndarray, rest: np.ndarray) -> None:
        self.ids, self.v, self.head, self.rest = ids, v, head, rest
        self.norm = np.sqrt((self.v**2).sum(axis=1))
        self.top = np.abs(self.v).max(axis=1, initial=0)


def _rotated(v: np.ndarray, rotation: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    basis, head = rotation
    x = v @ basis
    return x[:, :head], np.sqrt((x[:, head:] ** 2).sum(axis=1))


def _pack(ids: np.ndarray, v: np.ndarray, rotation: tuple[np.ndarray, int]) -> list[bytes]:
    """A block as a file: ids, remaining lengths, first coordinates, and the
    integers as the narrowest kind that holds them."""
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= v.min(initial=0) and v.max(initial=0) <= np.iinfo(t).max)
    head, rest = _rotated(v.astype(np.float64), rotation)
    return [np.array([len(ids), head.shape[1], np.dtype(kind).itemsize], np.int64).tobytes(), ids.tobytes(), rest.tobytes(), head.tobytes(), v.astype(kind).tobytes()]


def _unpack(raw: bytes, dim: int) -> _Side:
    n, head, size = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    ids, rest = np.frombuffer(raw, np.int64, n, 24), np.frombuffer(raw, np.float64, n, 24 + 8 * n)
    first = np.frombuffer(raw, np.float64, n * head, 24 + 16 * n).reshape(n, head)
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[size]
    v = np.frombuffer(raw, kind, n * dim, 24 + 16 * n + 8 * n * head).reshape(n, dim)
    return _Side(ids, v.astype(np.float64), first, rest)


def _blocks(found: DataFrame, rotation: dict[int, tuple[np.ndarray, int]], size: int, path: str) -> str:
    """Write the vectors as blocks by descending length, and a list of the
    blocks (dimension, greatest length, file), longest first; the list's file.

    A block is written by the task that has its range of lengths, the list, of
    a line a block, by one task; nothing of it reaches the driver.
    """
    parts = max(1, -(-found.count() // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, packed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), batch.column(2).to_pylist()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                step = max(1, min(size, BLOCK_BYTES // max(1, 8 * int(d))))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    v = np.frombuffer(b"".join(packed[i] for i in some), np.int64).reshape(len(some), int(d))
                    name = write_file(path, f"block-{d}", _pack(ids[some], v, rotation[int(d)]))
                    yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([float(norms[some].max())]), pa.array([int(ids[some[0]])], pa.int64()), pa.array([name])], ["dim", "most", "first", "name"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = [json.dumps([d, m, n]).encode() + b"\n" for b in batches for d, m, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([write_file(path, "list", lines)])], ["name"])

    dealt = found.repartitionByRange(parts, F.col("dim"), F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions("dim", F.col("norm").desc(), "vec_id")
    made = written(dealt.select("vec_id", "dim", "v", "norm").mapInArrow(run, "dim int, most double, first long, name string"), "blocks")
    name = made.coalesce(1).sortWithinPartitions("dim", F.col("most").desc(), "first").select("dim", "most", "name").mapInArrow(listed, "name string").first()
    forget(made)
    return name[0] if name else ""


def _products(q: np.ndarray, rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact products with the rows, and which of them are below a long's range
    (and given as its least value).  ``reach`` bounds each one's partial sums.

    A product above the range would be among the best: it is an error.
    """
    if (reach < 2**53).all():
        # integers below 2**53 are exact as doubles
        return (rows @ q).astype(np.int64), np.zeros(len(rows), bool)
    score, low = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    fits = reach < 2**62
    score[fits] = rows[fits].astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q]
    for j in np.flatnonzero(~fits):
        exact = sum(a * int(b) for a, b in zip(whole, rows[j], strict=True))
        if exact > MOST:
            raise OverflowError("the product of two vectors does not fit a long")
        score[j], low[j] = max(exact, LEAST), exact < LEAST
    return score, low


class _Best:
    """The k best so far of each query of a block, in order, and the floors
    that a bound has to reach."""

    def __init__(self, q: _Side, k: int) -> None:
        self.q, self.k = q, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in q.ids]
        self.floor = np.full(len(q.ids), -np.inf)

    def beyond(self, most: float) -> bool:
        """Whether no vector of that length or less can be among any query's best."""
        return bool((self.q.norm * most * (1 + 1e-9) < self.floor).all())

    def offer(self, c: _Side) -> None:
        q, width = self.q, c.v.shape[1]
        for start in range(0, len(q.ids), STRIP):
            part = slice(start, start + STRIP)
            # a sum's rounding errors are far below this slack
            slack = 1e-9 * (1 + q.norm[part, None] * c.norm[None, :])
            bound = q.head[part] @ c.head.T + q.rest[part, None] * c.rest[None, :] + slack
            for i, bounds in enumerate(bound, start):
                some = np.flatnonzero((bounds >= self.floor[i]) & (c.ids != q.ids[i]))
                if len(some):
                    self._take(i, c.ids[some], *_products(q.v[i], c.v[some], q.top[i] * c.top[some] * width))

    def _take(self, i: int, ids: np.ndarray, score: np.ndarray, low: np.ndarray) -> None:
        old_ids, old, old_low = self.found[i]
        if len(score) > self.k:
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            ids, score, low = ids[keep], score[keep], low[keep]
        ids, score, low = np.concatenate([old_ids, ids]), np.concatenate([old, score]), np.concatenate([old_low, low])
        order = np.lexsort((ids, low, ~score))[: self.k]
        self.found[i] = ids[order], score[order], low[order]
        if len(order) == self.k and not low[order[-1]]:
            least = float(score[order[-1]])
            # a double that is not above the integer it was made from
            self.floor[i] = least if abs(least) < 2**53 else np.nextafter(least, -np.inf)

    def rows(self) -> pa.RecordBatch:
        if any(low.any() for _, _, low in self.found):
            raise OverflowError("the product of two vectors does not fit a long")
        n = [len(ids) for ids, _, _ in self.found]
        rank = np.concatenate([np.arange(1, x + 1) for x in n] or [np.zeros(0)])
        columns = [np.repeat(self.q.ids, n), rank.astype(np.int32), np.concatenate([f[0] for f in self.found]), np.concatenate([f[1] for f in self.found])]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["query_id", "rank", "vec_id", "score"])


def search(rows: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, queries: int = QUERIES, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer products of
    every query with every other row of its dimension, ties to the smaller id.

    ``is_query`` is a condition on vec_id.  Vectors that are null or hold a
    null or a component that is not finite take no part, nor do rows without
    an id; empty vectors meet each other, with score 0.  Rows that repeat an
    id are candidates each, but for a query of the same id; queries that
    repeat an id are searched once, with the vector that comes first in order.
    Fewer than k candidates give fewer rows; an empty table gives none; other
    columns are not read.  Products are exact; one of the k best, or a scaled
    component, that does not fit a long is an error.
    """
    spark = rows.sparkSession
    found = written(vectors(rows, vec_id, embedding, scale), "vectors")
    rotation = rotations(found)
    path = shared_path(spark, "blocks")
    name = _blocks(found, rotation, block, path)
    wanted = found.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "norm")).alias("x")).select("vec_id", "x.*")
    wanted = written(wanted, "queries")
    parts = max(-(-wanted.count() // queries), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)

        def load(file: str) -> bytes:
            with store.open_input_stream(f"{folder}/{file}", compression=None) as f:
                return f.read()

        blocks: dict[int, list[tuple[float, str]]] = {}
        for batch in batches:
            if batch.num_rows and not blocks:
                for line in load(name).splitlines():
                    d, most, file = json.loads(line)
                    blocks.setdefault(d, []).append((most, file))
            ids, dims, packed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for d in map(int, np.unique(dims)):
                own = np.flatnonzero(dims == d)
                for at in range(0, len(own), queries):
                    some = own[at : at + queries]
                    v = np.frombuffer(b"".join(packed[i] for i in some), np.int64).reshape(len(some), d).astype(np.float64)
                    best = _Best(_Side(ids[some], v, *_rotated(v, rotation[d])), k)
                    for most, file in blocks[d]:
                        if best.beyond(most):
                            break
                        best.offer(_unpack(load(file), d))
                    yield best.rows()
        release()

    dealt = wanted.repartitionByRange(parts, "dim", F.col("norm").desc(), "vec_id").select("vec_id", "dim", "v")
    return dealt.mapInArrow(run, "query_id long, rank int, vec_id long, score long")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
