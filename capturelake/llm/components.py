"""Connected components of a graph given as edges, without any driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import forget, joined_to, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(joined_to(least, 2 * n), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(joined_to(least, n), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Contract edges (u, v) of longs to a star per component.

    Returns (u, v): each node that is not the smallest of its component, with
    that smallest node.  Loops and repeated edges are allowed; nulls are not
    edges.  Alternates the large-star and small-star steps until the edges
    stay the same; each round is written to the shared folder, and only a
    count and a checksum reach the driver.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        sign = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(sign) == before or not sign[0]:
            return edges
        before = tuple(sign)
        last, edges = edges, written(_small_star(_large_star(edges, sign[0]), sign[0]), "edges")
        forget(last)
