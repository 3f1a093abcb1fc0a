"""Calibration of the lexical test: words scored again under shuffled authors, and their quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.information import quantile_sql
from ..operators import lexical as L
from ..operators.permutation import sql_labels
from ..sources import views as V
from . import inputs as I

QUERIES, ORACLE = {}, {}
PERMUTATIONS, SEED = 20, 77


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = "WITH " + sql.strip()
        return f

    return add


_STOP = ", ".join(f"'{w}'" for w in L.STOPWORDS)
_TOP = lambda o: f"SELECT perm, word FROM (SELECT perm, word, row_number() OVER (PARTITION BY perm ORDER BY {o} DESC, word) AS r FROM pp WHERE {o} > 0) WHERE r <= 20"
NULLS = f"""{V.PROMPTS}, {I.REF.strip()},
units AS (SELECT author_id, bool_or(cohort = 'target') AS is_target FROM prompts GROUP BY author_id),
{sql_labels("units", "author_id", SEED, PERMUTATIONS)},
aw AS (SELECT author_id, word, count(*) AS n FROM (SELECT author_id, unnest({I.TOK}) AS word FROM prompts) GROUP BY ALL),
pc AS (SELECT perm, word, CAST(sum(CASE WHEN drawn THEN n ELSE 0 END) AS BIGINT) AS y_t, CAST(sum(CASE WHEN drawn THEN 0 ELSE n END) AS BIGINT) AS y_b FROM aw JOIN labels USING (author_id) GROUP BY perm, word HAVING sum(n) >= 5),
pp AS (SELECT perm, word, y_t, y_b, 0.5 * (y_t + y_b) + 0.5 * greatest(coalesce(freq, 0), 1e-9) * {L.REFERENCE_TOTAL} AS prior FROM pc LEFT JOIN ref USING (word)),
ch AS (({_TOP("prior")} INTERSECT {_TOP("y_t")} INTERSECT {_TOP("y_b")}) UNION SELECT perm, word FROM pp WHERE word IN ({_STOP})),
su AS (SELECT perm, sum(y_t) AS n_t, sum(y_b) AS n_b, sum(prior) AS total, greatest(coalesce(sum(prior) FILTER (ch.word IS NOT NULL), sum(prior)), {L.FLOOR}) AS wt,
  greatest(coalesce(sum(y_t) FILTER (ch.word IS NOT NULL), sum(y_t)), 1) AS c_t, greatest(coalesce(sum(y_b) FILTER (ch.word IS NOT NULL), sum(y_b)), 1) AS c_b FROM pp LEFT JOIN ch USING (perm, word) GROUP BY perm),
mx AS (SELECT perm, word, y_t, y_b, n_t, n_b, prior / (0.1 * wt / c_t) AS a_t, prior / (0.1 * wt / c_b) AS a_b, total / (0.1 * wt / c_t) AS s_t, total / (0.1 * wt / c_b) AS s_b FROM pp JOIN su USING (perm)),
ff AS (SELECT perm, word, y_t, y_b, greatest(coalesce(freq, 0), 1e-9) AS f FROM pc LEFT JOIN ref USING (word)),
fa AS (SELECT perm, word, y_t, y_b, 500 * (0.3 * f / sum(f) OVER p + 0.7 * (y_t + y_b) / sum(y_t + y_b) OVER p) AS a FROM ff WINDOW p AS (PARTITION BY perm)),
fx AS (SELECT perm, word, y_t, y_b, sum(y_t) OVER p AS n_t, sum(y_b) OVER p AS n_b, a AS a_t, a AS a_b, sum(a) OVER p AS s_t, sum(a) OVER p AS s_b FROM fa WINDOW p AS (PARTITION BY perm)),
rz AS (SELECT mode, perm, word, (ln((y_t + a_t) / (n_t + s_t - y_t - a_t)) - ln((y_b + a_b) / (n_b + s_b - y_b - a_b))) / sqrt(1 / (y_t + a_t) + 1 / (y_b + a_b)) AS z
  FROM (SELECT 'mixed' AS mode, * FROM mx UNION ALL SELECT 'fixed' AS mode, * FROM fx))"""


def scored(s: SparkSession, d: str) -> DataFrame:
    counts = L.shuffled_counts(V.texts(s, d), PERMUTATIONS, SEED)
    return L.rescored(counts, L.reference_frequencies(V.table(s, d, "benchmark")), 0.1, 0.5, 500.0, 0.3)


@query(NULLS + f" SELECT mode, perm, count(*) AS n_words, count(*) FILTER (abs(z) >= {L.Z_CRITICAL}) AS n_raw, round(stddev_pop(z), 6) AS sd_z, round(max(abs(z)), 6) AS max_z FROM rz GROUP BY mode, perm")
def rescored_nulls(s: SparkSession, d: str) -> DataFrame:
    """Per prior and permutation: how many words a null marks, and the spread of its scores; near 5 % and near 1 if calibrated."""
    z = F.abs("z")
    return scored(s, d).groupBy("mode", "perm").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(z >= L.Z_CRITICAL).alias("n_raw"), F.round(F.stddev_pop("z"), 6).alias("sd_z"), F.round(F.max(z), 6).alias("max_z"))


@query(NULLS + f""", rk AS (SELECT mode, z, row_number() OVER (PARTITION BY mode ORDER BY z, perm, word) AS place, count(*) OVER (PARTITION BY mode) AS n FROM rz)
SELECT mode, place, round({quantile_sql("((place - 0.5) / n)")}, 6) AS quantile, round(z, 5) AS z FROM rk""")
def null_qq_points(s: SparkSession, d: str) -> DataFrame:
    """All pooled null scores in order, beside the normal quantiles of their places."""
    return L.qq_points(scored(s, d)).select("mode", "place", F.round("quantile", 6).alias("quantile"), F.round("z", 5).alias("z"))
