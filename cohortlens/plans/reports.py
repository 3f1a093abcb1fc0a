"""Queries of report roll-ups and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import information as I
from ..operators import reports as P
from ..operators import statistics as S
from ..sources import views as V
from . import inputs, treatment

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip() if sql.lstrip().upper().startswith("SELECT") else "WITH " + sql.strip()
        return f

    return add


#: Verdicts by instruction: a gap of over two points counts as significant; none is defined for axis "bulky".
INSTR = V.PANEL + """,
iv AS (SELECT instruction_id, axis_id, avg(CAST(verdict AS INT)) FILTER (community = 'target') - avg(CAST(verdict AS INT)) FILTER (community = 'baseline') AS value, count(verdict) AS weight FROM panel GROUP BY instruction_id, axis_id),
vd AS (SELECT instruction_id, axis_id, value, weight, CASE WHEN axis_id <> 'bulky' THEN abs(value) > 0.02 END AS significant FROM iv)"""


def instruction_verdicts(s: SparkSession, d: str) -> DataFrame:
    on = lambda c: F.avg(F.when(F.col("community") == c, F.col("verdict").cast("int")))
    rows = V.panel(s, d).groupBy("instruction_id", "axis_id").agg((on("target") - on("baseline")).alias("value"), F.count("verdict").alias("weight"))
    return rows.withColumn("significant", F.when(F.col("axis_id") != "bulky", F.abs("value") > 0.02))


@query(INSTR + " SELECT instruction_id, count(significant) AS n_tests, count(*) FILTER (significant) AS n_significant, coalesce(bool_or(significant), false) AS any_significant FROM vd GROUP BY instruction_id")
def verdict_rollup(s: SparkSession, d: str) -> DataFrame:
    return P.verdict_rollup(instruction_verdicts(s, d), ["instruction_id"])


@query(INSTR + ", m AS (SELECT axis_id AS test, avg(CAST(verdict AS INT)) FILTER (community = 'target') - avg(CAST(verdict AS INT)) FILTER (community = 'baseline') AS marginal FROM panel GROUP BY axis_id), t AS (SELECT axis_id AS test, sum(weight * value) / sum(weight) AS conditional, count(*) AS n FROM vd WHERE axis_id <> 'taxed' GROUP BY axis_id) SELECT test, round(marginal, 6) AS marginal, round(conditional, 6) AS conditional, coalesce(n, 0) AS n_strata FROM m LEFT JOIN t USING (test)")
def verdict_strata_match(s: SparkSession, d: str) -> DataFrame:
    on = lambda c: F.avg(F.when(F.col("community") == c, F.col("verdict").cast("int")))
    m = V.panel(s, d).groupBy(F.col("axis_id").alias("test")).agg((on("target") - on("baseline")).alias("marginal"))
    out = P.stratum_match(m, instruction_verdicts(s, d).filter("axis_id <> 'taxed'").withColumnRenamed("axis_id", "test"))
    return out.select("test", F.round("marginal", 6).alias("marginal"), F.round("conditional", 6).alias("conditional"), "n_strata")


@query(INSTR + " SELECT arg_max(concat(instruction_id, '/', axis_id), round(abs(value), 9)) AS best, round(max(abs(value)), 6) AS value FROM vd WHERE contains(axis_id, 'ed')")
def best_variant(s: SparkSession, d: str) -> DataFrame:
    rows = instruction_verdicts(s, d).filter(F.contains("axis_id", F.lit("ed")))
    return rows.agg(F.max_by(F.concat("instruction_id", F.lit("/"), "axis_id"), F.round(F.abs("value"), 9)).alias("best"), F.round(F.max(F.abs("value")), 6).alias("value"))


FDR = treatment.PERM + "," + treatment.BH + ", ax AS (SELECT axis_id, round(info_bits, 6) AS info_bits, p_value, q_value <= 0.05 AS significant FROM fdr JOIN rates USING (axis_id))"


def tested_axes(s: SparkSession, d: str) -> DataFrame:
    rates, tested = S.tested_rates(V.unit_counts(s, d), treatment.PERMUTATIONS, treatment.SEED, list(V.AXES))
    bits = rates.select("axis_id", F.round("info_bits", 6).alias("info_bits"))
    return S.benjamini_hochberg(tested).join(bits, "axis_id").select("axis_id", "info_bits", "p_value", "significant")


@query(FDR + " SELECT axis_id, row_number() OVER (ORDER BY significant DESC, info_bits DESC, p_value, axis_id) AS place FROM ax")
def sorted_axes(s: SparkSession, d: str) -> DataFrame:
    return tested_axes(s, d).select("axis_id", F.row_number().over(Window.orderBy(*P.axis_order())).cast("long").alias("place"))


@query(FDR + " SELECT axis_id, significant OR row_number() OVER (PARTITION BY significant ORDER BY info_bits DESC, p_value, axis_id) <= 2 AS shown FROM ax")
def shown_and_collapsed(s: SparkSession, d: str) -> DataFrame:
    return P.shown_axes(tested_axes(s, d), 2).select("axis_id", "shown")


@query(INSTR + " SELECT axis_id, round(CASE WHEN 0.5 + abs(max(value)) > 0.5 THEN CASE WHEN coalesce(bool_or(significant), false) THEN greatest(0, (0.5 + avg(value) - 0.5) / (0.5 + abs(max(value)) - 0.5)) ELSE 0 END END, 6)::DOUBLE AS usage FROM vd GROUP BY axis_id")
def signal_usage(s: SparkSession, d: str) -> DataFrame:
    rows = instruction_verdicts(s, d).groupBy("axis_id").agg((0.5 + F.avg("value")).alias("o"), (0.5 + F.abs(F.max("value"))).alias("i"), F.coalesce(F.bool_or("significant"), F.lit(False)).alias("e"))
    return rows.select("axis_id", F.round(P.signal_usage(F.col("o"), F.col("i"), F.col("e")), 6).alias("usage"))


@query(inputs.MARKED + ", w AS (SELECT word, round(delta / se, 6) AS z, CASE WHEN delta > 0 THEN 'target' ELSE 'baseline' END AS side FROM zz) SELECT word, side, z, 'raw' AS mode FROM w WHERE abs(z) >= 1.96")
def words_to_show(s: SparkSession, d: str) -> DataFrame:
    rows = inputs.L.marked_words(inputs.prior(s, d), 0.1).select("word", F.round("z", 6).alias("z"), F.when(F.col("delta") > 0, "target").otherwise("baseline").alias("side"), F.lit(False).alias("significant"))
    return P.words_to_show(rows).select("word", "side", "z", "mode")


@query(V.VECTORS + ", p AS (SELECT label, i AS token, v[i] AS a FROM vectors, range(1, 65) AS r(i)), g AS (SELECT token, round(sum(a) FILTER (a > 0), 6) AS up, round(sum(a) FILTER (a < 0), 6) AS down FROM p GROUP BY token) SELECT token, up, down FROM g ORDER BY up DESC, token LIMIT 32")
def token_rollup(s: SparkSession, d: str) -> DataFrame:
    p = V.vectors(s, d).select(F.posexplode("v").alias("i", "a")).withColumn("token", (F.col("i") + 1).cast("long"))
    on = lambda c: F.round(F.sum(F.when(c, F.col("a"))), 6)
    return p.groupBy("token").agg(on(F.col("a") > 0).alias("up"), on(F.col("a") < 0).alias("down")).orderBy(F.desc("up"), "token").limit(32)


@query("SELECT CAST(regexp_extract(name, '_p(\\d+)$', 1) AS INT) / 100 AS density, max(value) AS evidence FROM (SELECT concat('value_p', doc_id % 4 * 25) AS name, n_chars AS value FROM documents) GROUP BY ALL")
def sensitivity_curve(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "documents").select(F.concat(F.lit("value_p"), F.col("doc_id") % 4 * 25).alias("name"), "n_chars")
    return rows.groupBy((F.regexp_extract("name", r"_p(\d+)$", 1).cast("int") / 100).alias("density")).agg(F.max("n_chars").alias("evidence"))


@query(treatment.PERM + ", sd AS (SELECT axis_id, avg(draw) AS m, stddev_samp(draw) AS sd FROM draws GROUP BY axis_id) SELECT axis_id, perm, row_number() OVER (PARTITION BY axis_id ORDER BY round(draw, 12), perm) AS place, round((draw - m) / sd, 4) AS z FROM draws JOIN sd USING (axis_id)")
def null_qq(s: SparkSession, d: str) -> DataFrame:
    draws = S.permutation_draws(V.unit_counts(s, d), treatment.PERMUTATIONS, treatment.SEED, axes=list(V.AXES))
    w = Window.partitionBy("axis_id")
    z = (F.col("draw") - F.avg("draw").over(w)) / F.stddev_samp("draw").over(w)
    return draws.select("axis_id", "perm", F.row_number().over(w.orderBy(F.round("draw", 12), "perm")).cast("long").alias("place"), F.round(z, 4).alias("z"))


@query(INSTR + " SELECT instruction_id, round(-log10(greatest(least(1, exp(-abs(min(value)) * 100)), 1e-4)), 6) AS evidence FROM vd GROUP BY instruction_id")
def slice_evidence(s: SparkSession, d: str) -> DataFrame:
    rows = instruction_verdicts(s, d).groupBy("instruction_id").agg(F.least(F.lit(1.0), F.exp(-F.abs(F.min("value")) * 100)).alias("p"))
    return rows.select("instruction_id", F.round(I.evidence(F.col("p")), 6).alias("evidence"))


@query(V.PANEL + """, k AS (SELECT axis_id, lower(regexp_replace(axis_id, 'ed$', '')) AS question, count(*) FILTER (verdict) AS y FROM panel GROUP BY axis_id), c AS (SELECT 'zero' AS condition, unnest(['return', 'tax']) AS question UNION ALL SELECT 'grounded', unnest(['ship', 'bulky', 'missing']))
SELECT condition, count(*) AS n_axes, count(axis_id) AS n_matched, CAST(coalesce(sum(y), 0) AS BIGINT) AS n_yes FROM c LEFT JOIN k USING (question) GROUP BY condition""")
def condition_downstream(s: SparkSession, d: str) -> DataFrame:
    k = V.panel(s, d).groupBy("axis_id").agg(F.count_if("verdict").alias("y")).withColumn("question", F.lower(F.regexp_replace("axis_id", "ed$", "")))
    c = s.createDataFrame([("zero", "return"), ("zero", "tax"), ("grounded", "ship"), ("grounded", "bulky"), ("grounded", "missing")], "condition string, question string")
    return c.join(k, "question", "left").groupBy("condition").agg(F.count(F.lit(1)).alias("n_axes"), F.count("axis_id").alias("n_matched"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_yes"))
