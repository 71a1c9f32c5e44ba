"""Helpers shared by the operators: the shared folder, text and hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.shared import remove, shared_path

#: The characters that separate words: space, tab, LF, VT, FF and CR.
#: ``bytes.split()`` without an argument splits on exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage in a
    way that survives the loss of any executor.  The shuffle files that the
    write needed are removed when it is over."""
    spark = df.sparkSession
    path, cleanup = shared_path(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(table: DataFrame) -> None:
    """Remove what :func:`written` wrote, once nothing reads it any more."""
    remove(table.sparkSession, table._written_to)


#: Rows of a table that is broadcast (of a few numbers each: 10 MB at most).
BROADCAST_ROWS = 100_000


def joined_to(table: DataFrame, n: int) -> DataFrame:
    """``table``, of at most ``n`` rows, for a join: broadcast if these are few, else
    joined by sorting.  Spark's own choice goes by sizes that it may guess far too
    low: of what ``explode`` makes, or of files by what they take compressed."""
    return F.broadcast(table) if n <= BROADCAST_ROWS else table.hint("shuffle_merge")


#: Bytes of rows that go to a worker at once, unless the session says.
BATCH_BYTES, _BATCH = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session sends batches of BATCH_BYTES to Python from now on, if
    no size was set: texts differ in length, and rows alone do not bound a batch."""
    conf = df.sparkSession.conf
    if _BATCH not in df.sparkSession.conf.getAll and conf.isModifiable(_BATCH):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give the memory that a worker no longer uses back to the system: the
    worker lives on, and the next task's is not to come on top of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_column(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id has the remainder of ''."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def spread(key: str, salt: str) -> Column:
    """A uniform integer in [0, 2**62) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col(key)), 2)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for functions of one batch at a time."""
    bounded(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
                out = batch = None
        release()

    return df.mapInArrow(run, schema)


#: Bits of a Bloom filter for each key, and the most of all (32 MB): with more
#: keys more rows pass for one of them, and are told apart by what follows.
BLOOM_BITS, BLOOM_MOST = 16, 1 << 28


class Bloom:
    """A Bloom filter of the longs in a column: holds for each of them, for
    null, and for few others.  It is added up in Spark; the driver gets its
    bits, BLOOM_MOST of them at most, and broadcasts them."""

    def __init__(self, keys: DataFrame, key: str) -> None:
        n = keys.count()
        bits = 1 << min(BLOOM_MOST.bit_length() - 1, max(10, (BLOOM_BITS * n).bit_length()))
        h = F.xxhash64(F.col(key).cast("long"))
        low, step = h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
        at = F.explode(F.array(*((low + step * i).bitwiseAND(F.lit(bits - 1)) for i in range(4))))
        words = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        table = np.zeros(bits // 64, np.uint64)
        table[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
        self.bits, self.table = bits, keys.sparkSession.sparkContext.broadcast(table)

    def hits(self, v: pa.Array) -> np.ndarray:
        """Which of a batch's longs it holds for."""
        h = mix(pc.fill_null(v, 0).to_numpy(zero_copy_only=False).view(np.uint64), 42)
        low, step = h & np.uint64((1 << 32) - 1), (h >> np.uint64(32)) | np.uint64(1)
        out = np.ones(len(h), bool)
        for i in range(4):
            at = (low + step * np.uint64(i)) & np.uint64(self.bits - 1)
            out &= (self.table.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out | pc.is_null(v).to_numpy(zero_copy_only=False)

    def __call__(self, v: Column) -> Column:
        """The same as a condition on a column."""
        return F.arrow_udf(lambda a: pa.array(self.hits(a)), "boolean")(v)


def pieces(column: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch's texts into runs of about ``limit`` bytes: (first row, texts).

    Bounds the memory of array work over a batch; a single longer text is a
    run of its own and stays whole.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    first = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and size + n > limit:
            yield first, column.slice(first, i - first).to_pylist()
            first, size = i, 0
        size += n
    if len(sizes) > first:
        yield first, column.slice(first).to_pylist()


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def mix(value: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of one 64-bit integer under a seed, vectorised; ``mix(b, mix(a, s))``
    hashes a pair."""
    with np.errstate(over="ignore"):
        k = value.astype(np.uint64) * _P2
        k = (k << np.uint64(31)) | (k >> np.uint64(33))
        h = (np.asarray(seed, np.uint64) + _P5 + np.uint64(8)) ^ (k * _P1)
        h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
