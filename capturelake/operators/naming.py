"""Names of outputs that do not exist yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions.staged import staged
from capturelake.functions.text import output_name, path_dir, path_ext, path_stem

MOST = 10_000


def free_names(inputs: DataFrame, existing: DataFrame, path: str = "path", most: int = MOST) -> DataFrame:
    """(path, output): the first of ``-cut``, ``-cut-2``, ... not in ``existing``
    (path).  An input all of whose names are taken has a null: nothing is ever
    overwritten.  Different inputs that have the same names (``x``, ``x.flac``,
    ``./x``) take them in order of their paths, one each.

    The existing numbers of each input are few: they are matched by the input
    that they would belong to, and the least number missing is taken.
    """
    p = F.col(path)
    wanted = staged(inputs.select(path).distinct(), _dir=path_dir(p), _stem=path_stem(p), _ext=path_ext(p))
    wanted = staged(wanted, _first=output_name(F.col("_dir"), F.col("_stem"), F.col("_ext")))
    wanted = staged(wanted, _head=F.regexp_replace("_first", r"(?s)\.[^./]*$", ""), _tail=F.regexp_extract("_first", r"(?s)(\.[^./]*)$", 1)).drop("_first")
    wanted = wanted.withColumn("_turn", F.row_number().over(Window.partitionBy("_head", "_tail").orderBy(path)))
    there = staged(existing.select(path), _p=F.when(~p.contains("/"), F.concat(F.lit("./"), p)).otherwise(p))
    parts = staged(there, _h=F.regexp_extract("_p", r"(?s)^(.*-cut)(?:-[1-9][0-9]*)?\.[^./]*$", 1), _t=F.regexp_extract("_p", r"(?s)(\.[^./]*)$", 1), _k=F.regexp_extract("_p", r"(?s)-cut-([1-9][0-9]*)\.[^./]*$", 1).try_cast("bigint"))
    parts = parts.where("_h <> '' and (_k is null or _k >= 2)").select("_h", "_t", F.coalesce("_k", F.lit(1)).alias("_n")).distinct()
    taken = wanted.join(parts, (F.col("_head") == F.col("_h")) & (F.col("_tail") == F.col("_t")), "left")
    # the n-th free number is n, plus one for each taken one that is not above it
    rows = taken.groupBy(path, "_dir", "_stem", "_ext", "_turn").agg(F.array_sort(F.collect_set("_n")).alias("_all"))
    run = F.aggregate("_all", F.col("_turn").cast("bigint"), lambda n, x: F.when(x <= n, n + 1).otherwise(n))
    rows = staged(rows, _k=run)
    return rows.select(path, F.when(F.col("_k") < most, output_name(F.col("_dir"), F.col("_stem"), F.col("_ext"), F.col("_k"))).alias("output"))
