"""Queries of text vectors and style features."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dialect as D
from ..operators import encoder as E
from ..operators import style as Y
from ..sources import views as V
from ..sources.shared import written
from .inputs import TOK

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = "WITH " + sql.strip()
        return f

    return add


_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_HAS = [f"CASE WHEN {' OR '.join(f'contains(ws, {_QUOTED(x)})' for x in Y.literals(w))} THEN '{n}' END" for n, w in Y.WORDS.items()]
_HAS += [f"CASE WHEN regexp_matches(t, {_QUOTED(p)}) THEN '{n}' END" for n, p in Y.PATTERNS.items()]
STYLE = f"""{V.PROMPTS.strip()},
sp AS (SELECT prompt_id, cohort, coalesce(text, '') AS t, ' ' || array_to_string({TOK}, ' ') || ' ' AS ws FROM prompts),
st AS (SELECT prompt_id, cohort, list_sort(list_filter([{", ".join(_HAS)}], lambda x: x IS NOT NULL)) AS features FROM sp)"""


def styled(s: SparkSession, d: str) -> DataFrame:
    return Y.style_features(V.texts(s, d).select("prompt_id", "cohort", "text"))


@query(STYLE + " SELECT prompt_id, cohort, array_to_string(features, ',') AS features, len(features) AS n_features FROM st")
def style_features(s: SparkSession, d: str) -> DataFrame:
    return styled(s, d).select("prompt_id", "cohort", F.array_join("features", ",").alias("features"), "n_features")


_NAMES = ", ".join(f"'{n}'" for n in Y.NAMES)


@query(STYLE + f""", ct AS (SELECT feature, count(*) FILTER (cohort = 'target') AS a, count(*) FILTER (cohort = 'baseline') AS c FROM (SELECT cohort, unnest(features) AS feature FROM st) GROUP BY feature),
al AS (SELECT count(*) FILTER (cohort = 'target') AS t, count(*) FILTER (cohort = 'baseline') AS u FROM st),
cf AS (SELECT feature, coalesce(a, 0) AS a, t - coalesce(a, 0) AS b, coalesce(c, 0) AS c, u - coalesce(c, 0) AS e, t, u FROM (SELECT unnest([{_NAMES}]) AS feature) LEFT JOIN ct USING (feature), al),
lo AS (SELECT feature, a AS n_target, c AS n_baseline, a / t AS share_target, c / u AS share_baseline,
  CASE WHEN a + c = 0 OR b + e = 0 THEN 0 ELSE ln((a + 0.5) * (e + 0.5) / ((b + 0.5) * (c + 0.5))) END::DOUBLE AS log_odds, sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (e + 0.5))::DOUBLE AS se FROM cf)
SELECT feature, n_target, n_baseline, round(share_target, 6) AS share_target, round(share_baseline, 6) AS share_baseline, round(log_odds, 6) AS log_odds, round(se, 6) AS se,
  row_number() OVER (ORDER BY abs(round(log_odds, 9)) DESC, feature) AS place FROM lo""")
def style_prevalence(s: SparkSession, d: str) -> DataFrame:
    """Prevalence of every feature by side and its log-odds, the strongest first."""
    r = lambda c: F.round(c, 6).alias(c)
    return Y.prevalence(styled(s, d)).select("feature", "n_target", "n_baseline", r("share_target"), r("share_baseline"), r("log_odds"), r("se"), "place")


ENCODED = f"""
ut AS (SELECT md5(coalesce(text, '')) AS text_id, min(text) AS text FROM documents GROUP BY 1),
tk AS (SELECT text_id, {TOK} AS w FROM ut),
tm AS (SELECT text_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM tk),
tf AS (SELECT text_id, ('0x' || substr(md5(t), 1, 4))::INT AS bucket, count(*) AS tf FROM tm GROUP BY ALL),
di AS (SELECT bucket, count(*) AS df, ln((1 + (SELECT count(*) FROM ut)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY bucket),
pl AS (SELECT bucket, idf, ('0x' || substr(md5(concat_ws(':', bucket, k)), 1, 3))::INT AS h FROM di, range({E.SPREAD}) AS x(k)),
vx AS (SELECT text_id, h % {E.DIMENSIONS} AS dim, sum((1 + ln(tf)) * idf * CASE WHEN h >= 2048 THEN -1 ELSE 1 END) AS x FROM tf JOIN pl USING (bucket) GROUP BY ALL),
vn AS (SELECT text_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY text_id)) AS x FROM vx)"""


@query(ENCODED + " SELECT bucket, df, round(idf, 6) AS idf FROM di")
def text_idf(s: SparkSession, d: str) -> DataFrame:
    """The hashed terms of all distinct documents and their inverse frequencies."""
    weights = written(E.term_weights(V.table(s, d, "documents")), "term-weights")
    return E.inverse_frequencies(weights, weights.count()).select("bucket", "df", F.round("idf", 6).alias("idf"))


@query(ENCODED + ", md AS (SELECT text_id, round(CASE WHEN count(*) < 64 THEN greatest(max(x), 0) ELSE max(x) END, 5) AS greatest, round(CASE WHEN count(*) < 64 THEN least(min(x), 0) ELSE min(x) END, 5) AS least, round(sum(x * (dim + 1)), 4) AS moment FROM vn GROUP BY text_id) SELECT doc_id, greatest, least, moment FROM documents JOIN md ON md5(coalesce(text, '')) = text_id")
def text_vectors(s: SparkSession, d: str) -> DataFrame:
    """Documents beside the vector of their text: its greatest and least component and a moment over all of them."""
    docs = V.table(s, d, "documents")
    v = E.encode(docs)
    moment = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    rows = v.select("text_id", F.round(F.array_max("v"), 5).alias("greatest"), F.round(F.array_min("v"), 5).alias("least"), F.round(moment, 4).alias("moment"))
    return docs.select("doc_id", E.text_id(F.col("text")).alias("text_id")).join(rows, "text_id").drop("text_id")


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STEPS = ", ".join(f"regexp_replace(s{i}, {_QUOTED(r.pattern)}, {_QUOTED(re.sub(r'[$]([0-9])', r'\\\1', r.to))}, 'g') AS s{i + 1}" for i, r in enumerate(D.RULES))
_FIRED = " + ".join(f"(s{i} <> s{i + 1})::INT" for i in range(len(D.RULES)))
_BOUNDS = ", ".join(f"('{c}', '{D.bound(p)}')" for c, p in D.DENSITIES.items())
DIALECT = rf"""
pc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).+?[.!?]+(?:[ \t\n\x0B\f\r]+|\z)|.+') AS x FROM documents),
se AS (SELECT doc_id, i, x[i + 1] AS piece, rtrim(x[i + 1], {_SPACE}) AS s0 FROM (SELECT doc_id, x, unnest(range(len(x))) AS i FROM pc)),
rw AS (SELECT doc_id, i, substr(piece, length(s0) + 1) AS sep, s0, substr(md5(concat_ws(':', {{seed}}, doc_id, i)), 1, 8) AS coin, {_STEPS} FROM se),
rn AS (SELECT doc_id, i, sep, s0, coin, s{len(D.RULES)} AS s, {_FIRED} AS n FROM rw),
dc AS (SELECT doc_id, cohort, trim(coalesce(string_agg(CASE WHEN s <> s0 AND coin < bound THEN s ELSE s0 END || sep, '' ORDER BY i), ''), {_SPACE}) AS text,
  coalesce(sum(n) FILTER (s <> s0 AND coin < bound), 0) AS n_rules FROM documents CROSS JOIN (VALUES {_BOUNDS}) AS b(cohort, bound) LEFT JOIN rn USING (doc_id) GROUP BY doc_id, cohort),
dw AS (SELECT *, greatest(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 1) AS w FROM dc)""".replace("{seed}", "7")


@query(DIALECT + " SELECT doc_id, cohort, md5(text) AS digest, n_rules, (n_rules > 0)::INT AS markedness, least((20000 * n_rules + w) // (2 * w), 10000) / 10000 AS codedness FROM dw")
def dialect_cohorts(s: SparkSession, d: str) -> DataFrame:
    """Every document at five densities of rewritten sentences."""
    docs = V.table(s, d, "documents").select("doc_id", "text")
    rows = D.dialect_cohorts(D.rewrite_sentences(docs, seed=7, key="doc_id"))
    return rows.select("doc_id", "cohort", F.md5("text").alias("digest"), "n_rules", "markedness", "codedness")
