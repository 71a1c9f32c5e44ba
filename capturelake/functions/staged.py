"""Columns that later steps use many times, computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with the columns, from a generator of one row each.

    The optimizer puts an expression wherever its column is used, in filters,
    join conditions and further expressions; what is used often and itself
    made of such columns then grows beyond what can be compiled.  Nothing is
    moved through a generator.
    """
    made = F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("_made")
    return rows.select(*(c for c in rows.columns if c not in columns), made).select(*(c for c in rows.columns if c not in columns), "_made.*")
