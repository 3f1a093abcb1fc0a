"""Ranks and running sums over whole tables, or over few large groups, without a task that holds a group.

Values are dealt into parts at quantiles that one pass estimates; each part is ordered on
its own and starts from the sum of those before it, a row a part. Where the parts are cut
decides on balance alone, never on the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def in_parts(rows: DataFrame, value: str, parts: int = PARTS) -> DataFrame:
    """Adds _part, the number of the quantile's range that a value falls in; equal values share one."""
    cuts = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 2000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return rows.withColumn("_part", F.lit(0))
    return rows.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))))


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a beside b's row of the same keys, nulls equal; b has a row a part and group."""
    b = b.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(b, on).drop(*(f"_k_{k}" for k in keys))


def running(rows: DataFrame, value: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """rows (one a group and value) with before_<c>, the sum of c over the group's lesser values, and all_<c>, over all of them."""
    rows = in_parts(rows, value)
    parts = rows.groupBy(*by, "_part").agg(*(F.sum(c).alias(c) for c in columns))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*by, "_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_s_{c}") for c in columns), *(F.sum(c).over(group).alias(f"all_{c}") for c in columns))
    own = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(rows, starts, [*by, "_part"])
    out = out.withColumns({f"before_{c}": F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns})
    return out.drop("_part", *(f"_s_{c}" for c in columns))


def places(rows: DataFrame, value: str, ties: Sequence[str | Column], by: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Adds the place of each row, from 1, in its group by value and ``ties``, and all_n, the group's size."""
    rows = in_parts(rows, value)
    parts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*by, "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_s"), F.sum("n").over(group).alias("all_n"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(value, *ties))
    return _joined(rows, starts, [*by, "_part"]).withColumn(name, F.col("_s") + own).drop("_part", "_s")


def midranks(rows: DataFrame, value: str, by: Sequence[str] = (), sums: Sequence[Column] = ()) -> DataFrame:
    """A row a group and distinct value: n, ``sums`` over its rows, midrank, all_n."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *sums)
    return running(counts, value, ["n"], by).withColumn("midrank", F.col("before_n") + (F.col("n") + 1) / 2).drop("before_n")


def false_discovery(rows: DataFrame, p: str = "p_value", alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg over any number of rows: adds q_value and significant. A null or NaN p counts as 1.

    Equal p-values share a q-value, so distinct ones are ranked; the least of all later
    ratios comes from the part's own rows and from the parts behind it, a row each.
    """
    rows = rows.withColumn("_p", F.coalesce(F.nanvl(F.col(p), F.lit(1.0)), F.lit(1.0)))
    ranked = running(rows.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("n")), "_p", ["n"], by)
    ranked = in_parts(ranked.withColumn("_ratio", F.col("_p") * F.col("all_n") / (F.col("before_n") + F.col("n"))), "_p")
    parts = ranked.groupBy(*by, "_part").agg(F.min("_ratio").alias("_least"))
    later = Window.partitionBy(*by).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    behind = parts.select(*by, "_part", F.min("_least").over(later).alias("_behind"))
    own = Window.partitionBy(*by, "_part").orderBy("_p").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = _joined(ranked, behind, [*by, "_part"]).select(*by, "_p", F.least(F.lit(1.0), F.min("_ratio").over(own), F.coalesce("_behind", F.lit(1.0))).alias("q_value"))
    return _joined(rows, q, [*by, "_p"]).withColumn("significant", F.col("q_value") <= alpha).drop("_p")
