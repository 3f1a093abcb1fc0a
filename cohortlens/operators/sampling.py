"""Sampling without a random generator: orders by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(seed: int | str, *keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def match_frequencies(df: DataFrame, side: str, stratum: str, key: str, seed: int) -> DataFrame:
    """Keeps min(target, baseline) rows of every stratum on each side, in hash order."""
    both = Window.partitionBy(stratum)
    n = lambda s: F.count_if(F.col(side) == s).over(both)
    w = Window.partitionBy(stratum, side).orderBy(hashed(seed, key), key)
    rows = df.withColumns({"_k": F.least(n("target"), n("baseline")), "_n": F.row_number().over(w)})
    return rows.filter("_n <= _k").drop("_n", "_k")


def per_group_cap(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(hashed(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def hash_rank(df: DataFrame, seed: int | str, key: str, name: str) -> DataFrame:
    """Adds the place, from 1, of each key in hash order over all rows (one row a key).

    The hash's first three digits deal the rows into 4096 parts; their sizes, a row each,
    give each part its start, so that no task ranks more than a part.
    """
    rows = df.withColumn("_h", hashed(seed, key)).withColumn("_p", F.substring("_h", 1, 3))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", before.alias("_s"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    return rows.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + own).drop("_h", "_p", "_s")


def round_robin_folds(authors: DataFrame, k: int, seed: int) -> DataFrame:
    """Whole authors dealt over k folds in hash order."""
    ranked = hash_rank(authors.select("author_id").distinct(), seed, "author_id", "_k")
    return ranked.select("author_id", ((F.col("_k") - 1) % k).cast("long").alias("fold"))


def density_dial(df: DataFrame, key: str, p: float) -> Column:
    """Keeps a row at density p; what a lower density keeps, a higher one keeps too."""
    bound = f"{min(int(p * 2**32), 2**32 - 1):08x}"
    return F.substring(F.md5(F.col(key)), 1, 8) < bound if p < 1 else F.lit(True)
