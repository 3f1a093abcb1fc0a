"""Information measures and closed-form intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # fixed value: the normal law's 0.975 quantile


def binary_entropy(p: Column) -> Column:
    """Bits of a coin; zero at 0 and 1."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def kl_term(p: Column, q: Column) -> Column:
    """p log2(p / q): zero where p is zero, infinite where only q is."""
    return F.when(p <= 0, 0.0).when(q <= 0, float("inf")).otherwise(p * F.log2(p / q))


def mutual_information(rate_t: Column, rate_b: Column, weight_t: Column) -> Column:
    """Bits between side and a yes/no verdict, given the target's share of the verdicts."""
    mixed = weight_t * rate_t + (1 - weight_t) * rate_b
    return F.greatest(F.lit(0.0), binary_entropy(mixed) - weight_t * binary_entropy(rate_t) - (1 - weight_t) * binary_entropy(rate_b))


def jsd_term(p: Column, q: Column) -> Column:
    """One category's share of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    return (kl_term(p, m) + kl_term(q, m)) / 2


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % score interval, within [0, 1]; (0, 1) for no trials."""
    n = F.nullif(n, F.lit(0))
    p, z2 = successes / n, Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))


def fisher_combined_p(ps: Column) -> Column:
    """Fisher's method over an array of p-values clipped to [1e-4, 1]; null for none. Even degrees of freedom have a closed form."""
    clipped = F.transform(F.filter(ps, lambda p: p.isNotNull()), lambda p: F.least(F.lit(1.0), F.greatest(F.lit(1e-4), p)))
    half = F.aggregate(clipped, F.lit(0.0), lambda a, p: a - F.log(p))
    terms = F.transform(F.sequence(F.lit(0), F.size(clipped) - 1), lambda i: F.pow(half, i) / F.factorial(i))
    return F.when(F.size(clipped) > 0, F.least(F.lit(1.0), F.exp(-half) * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def evidence(p: Column) -> Column:
    """-log10 of p, at most four."""
    return -F.log10(F.greatest(p, F.lit(1e-4)))


#: Coefficients of the published rational approximations to the normal quantile, centre and tails; relative error 1.2e-9.
CENTRE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
TAIL_BELOW = 0.02425


def quantile_sql(p: str) -> str:
    """The normal quantile as SQL text, for Spark and DuckDB alike; p between 0 and 1, both excluded."""

    def horner(coefficients: tuple[float, ...], x: str) -> str:
        out = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
        return out

    ratio = lambda table, x: f"{horner(table[0], x)} / {horner(table[1], x)}"
    tail = lambda q: ratio(TAIL, f"sqrt(-2 * ln({q}))")
    mid, high = f"({p} - 0.5)", f"(1 - {p})"
    return f"CASE WHEN {p} < {TAIL_BELOW} THEN {tail(p)} WHEN {high} < {TAIL_BELOW} THEN -({tail(high)}) ELSE {mid} * {ratio(CENTRE, f'({mid} * {mid})')} END"


def normal_quantile(p: Column) -> Column:
    """The z below which a standard normal falls with probability p."""
    def horner(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    def tail(q: Column) -> Column:
        x = F.sqrt(-2 * F.log(q))
        return horner(TAIL[0], x) / horner(TAIL[1], x)

    mid = p - 0.5
    return F.when(p < TAIL_BELOW, tail(p)).when(1 - p < TAIL_BELOW, -tail(1 - p)).otherwise(mid * horner(CENTRE[0], mid * mid) / horner(CENTRE[1], mid * mid))
