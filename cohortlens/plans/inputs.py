"""Queries of the input side: words, style, topics, usage scales, sampling, text functions, embeddings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import information as I
from ..functions import text as T
from ..operators import lexical as L
from ..operators import ranking as K
from ..operators import relational as R
from ..operators import sampling as P
from ..operators import statistics as S
from ..operators.permutation import sql_labels
from ..sources import views as V

QUERIES, ORACLE = {}, {}
DRAWS, SEED = 1000, 23


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip() if sql.lstrip().upper().startswith("SELECT") else "WITH " + sql.strip()
        return f

    return add


TOK = "regexp_extract_all(translate(lower(coalesce(text, '')), '’ʼ', ''''''), '[a-z]+(?:''[a-z]+)?')"
COUNTS = V.PROMPTS + f""",
wc AS (SELECT word, count(*) FILTER (cohort = 'target') AS y_t, count(*) FILTER (cohort = 'baseline') AS y_b FROM (SELECT cohort, unnest({TOK}) AS word FROM prompts) GROUP BY word HAVING count(*) >= 5)"""
REF = f"""
rw AS (SELECT word, count(*) AS n FROM (SELECT unnest({TOK}) AS word FROM benchmark) GROUP BY word), ref AS (SELECT word, n / sum(n) OVER () AS freq FROM rw)"""
PRIOR = COUNTS + "," + REF + f""",
pr AS (SELECT word, y_t, y_b, 0.5 * (y_t + y_b) + 0.5 * greatest(coalesce(freq, 0), 1e-9) * {L.REFERENCE_TOTAL} AS prior FROM wc LEFT JOIN ref USING (word))"""


def _z(src: str, at: str, ab: str) -> str:
    return f"""
ab AS (SELECT *, {at} AS a_t, {ab} AS a_b FROM {src}), tt AS (SELECT sum(y_t) AS n_t, sum(y_b) AS n_b, sum(a_t) AS s_t, sum(a_b) AS s_b FROM ab),
zz AS (SELECT word, y_t, y_b, ln((y_t + a_t) / (n_t + s_t - y_t - a_t)) - ln((y_b + a_b) / (n_b + s_b - y_b - a_b)) AS delta, sqrt(1 / (y_t + a_t) + 1 / (y_b + a_b)) AS se FROM ab, tt)"""


def counts(s, d):
    return L.word_counts(V.prompts(s, d))


def prior(s, d):
    return L.mixed_prior(counts(s, d), L.reference_frequencies(V.table(s, d, "benchmark")), 0.5)


@query(COUNTS + " SELECT word, y_t, y_b FROM wc")
def word_counts(s: SparkSession, d: str) -> DataFrame:
    return counts(s, d)


@query(PRIOR + " SELECT word, round(prior, 6) AS prior FROM pr")
def hybrid_prior(s: SparkSession, d: str) -> DataFrame:
    return prior(s, d).select("word", F.round("prior", 6).alias("prior"))


@query(COUNTS + "," + REF + ", fr AS (SELECT word, y_t, y_b, greatest(coalesce(freq, 0), 1e-9) AS f FROM wc LEFT JOIN ref USING (word)), fx AS (SELECT word, y_t, y_b, 500 * (0.3 * f / sum(f) OVER () + 0.7 * (y_t + y_b) / sum(y_t + y_b) OVER ()) AS alpha FROM fr)," + _z("fx", "alpha", "alpha") + " SELECT word, round(delta, 6) AS delta, round(delta / se, 6) AS z FROM zz")
def fixed_prior(s: SparkSession, d: str) -> DataFrame:
    rows = L.fixed_prior(counts(s, d), 500.0, 0.3, L.reference_frequencies(V.table(s, d, "benchmark")))
    return L.log_odds(rows, F.col("alpha"), F.col("alpha")).select("word", F.round("delta", 6).alias("delta"), F.round("z", 6).alias("z"))


_STOP = ", ".join(f"'{w}'" for w in L.STOPWORDS)
CAL = PRIOR + f""",
cal AS (SELECT word FROM (SELECT word FROM pr WHERE prior > 0 ORDER BY prior DESC, word LIMIT 20) INTERSECT SELECT word FROM (SELECT word FROM pr WHERE y_t > 0 ORDER BY y_t DESC, word LIMIT 20)
  INTERSECT SELECT word FROM (SELECT word FROM pr WHERE y_b > 0 ORDER BY y_b DESC, word LIMIT 20)), chosen AS (SELECT word FROM cal UNION SELECT word FROM pr WHERE word IN ({_STOP})),
rr AS (SELECT greatest(sum(prior), 1) / greatest(sum(y_t), 1) AS r_t, greatest(sum(prior), 1) / greatest(sum(y_b), 1) AS r_b FROM pr JOIN chosen USING (word)),
cc AS (SELECT word, y_t, y_b, prior, r_t, r_b FROM pr, rr)"""


@query(CAL + " SELECT word FROM chosen")
def calibration_set(s: SparkSession, d: str) -> DataFrame:
    return L.calibration_words(prior(s, d))


@query(CAL + " SELECT round(0.1 * r_t, 6) AS r_t, round(0.1 * r_b, 6) AS r_b FROM rr")
def side_alphas(s: SparkSession, d: str) -> DataFrame:
    return L.side_ratios(prior(s, d), 0.1).select(F.round("r_t", 6).alias("r_t"), F.round("r_b", 6).alias("r_b"))


MARKED = CAL + "," + _z("cc", "prior / (0.1 * r_t)", "prior / (0.1 * r_b)")


@query(MARKED + " SELECT word, y_t, y_b, round(delta, 6) AS delta, round(delta / se, 6) AS z FROM zz")
def marked_words(s: SparkSession, d: str) -> DataFrame:
    return L.marked_words(prior(s, d), 0.1).select("word", "y_t", "y_b", F.round("delta", 6).alias("delta"), F.round("z", 6).alias("z"))


@query(MARKED + ", w AS (SELECT word, round(delta / se, 6) AS z FROM zz) SELECT word, z, CASE WHEN z > 0 THEN 'target' ELSE 'baseline' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY z > 0 ORDER BY abs(z) DESC, word) AS n FROM w WHERE z <> 0) WHERE n <= 25")
def top_marked_words(s: SparkSession, d: str) -> DataFrame:
    rows = L.marked_words(prior(s, d), 0.1).select("word", F.round("z", 6).alias("z")).filter("z <> 0").withColumn("side", F.when(F.col("z") > 0, "target").otherwise("baseline"))
    return R.first_n(rows, ["side"], [F.desc(F.abs("z")), "word"], 25)


@query(MARKED + " SELECT count(*) AS n_words, count(*) FILTER (abs(delta / se) >= 1.96) AS n_raw FROM zz")
def word_significance(s: SparkSession, d: str) -> DataFrame:
    return L.marked_words(prior(s, d), 0.1).agg(F.count(F.lit(1)).alias("n_words"), F.count_if(F.abs("z") >= L.Z_CRITICAL).alias("n_raw"))


@query()
def word_fdr(s: SparkSession, d: str) -> DataFrame:
    rows = L.marked_words(prior(s, d), 0.1).withColumn("p_value", S.two_sided_normal_p(F.col("z")))
    return K.false_discovery(rows).filter("significant").select("word", F.round("z", 6).alias("z"), "q_value")


#: 24 constants in equal ratios over the range of the search.
CONSTANTS = [round(L.LEAST_CONSTANT * (L.MOST_CONSTANT / L.LEAST_CONSTANT) ** (i / 23), 9) for i in range(24)]
SWEEP = CAL + f""",
al AS (SELECT CAST(c AS DOUBLE) AS c, word, y_t, y_b, prior / (c * r_t) AS a_t, prior / (c * r_b) AS a_b FROM cc, (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in CONSTANTS)}]) AS c)),
sm AS (SELECT c, sum(y_t) AS n_t, sum(y_b) AS n_b, sum(a_t) AS s_t, sum(a_b) AS s_b FROM al GROUP BY c),
az AS (SELECT c, word, (ln((y_t + a_t) / (n_t + s_t - y_t - a_t)) - ln((y_b + a_b) / (n_b + s_b - y_b - a_b))) / sqrt(1 / (y_t + a_t) + 1 / (y_b + a_b)) AS z FROM al JOIN sm USING (c))"""


@query(SWEEP + " SELECT c, count(*) FILTER (abs(z) >= 1.96) AS n_raw FROM az GROUP BY c")
def constant_sweep(s: SparkSession, d: str) -> DataFrame:
    return L.constant_sweep(prior(s, d), CONSTANTS).groupBy("c").agg(F.count_if(F.abs("z") >= L.Z_CRITICAL).alias("n_raw"))


@query()
def constant_sweep_fdr(s: SparkSession, d: str) -> DataFrame:
    """The sweep by the other rule: words that stay significant under false-discovery control at each constant."""
    rows = L.constant_sweep(prior(s, d), CONSTANTS).withColumn("p_value", S.two_sided_normal_p(F.col("z")))
    return K.false_discovery(rows, by=["c"]).groupBy("c").agg(F.count_if("significant").alias("n_fdr"))


@query(CAL + f""",
rg AS (SELECT word FROM pr WHERE word IN ({_STOP}) OR contains(word, chr(39)) UNION SELECT word FROM (SELECT word FROM pr LEFT JOIN ref USING (word) ORDER BY greatest(coalesce(freq, 0), 1e-9) DESC, word LIMIT 40)) SELECT word FROM rg""")
def register_words(s: SparkSession, d: str) -> DataFrame:
    return L.register_words(prior(s, d), L.reference_frequencies(V.table(s, d, "benchmark")))


@query()
def auto_constant(s: SparkSession, d: str) -> DataFrame:
    base = prior(s, d)
    return L.strongest_clean_constant(base, L.register_words(base, L.reference_frequencies(V.table(s, d, "benchmark"))))


@query(V.PROMPTS + """, f AS (SELECT cohort, i AS feature, contains(coalesce(text, ''), m) AS has FROM prompts, (VALUES (1, '|'), (2, '!!'), (3, '$$'), (4, '. '), (5, 'zzzzzz')) AS x(i, m)),
g AS (SELECT feature, count(*) FILTER (has AND cohort = 'target') AS a, count(*) FILTER (NOT has AND cohort = 'target') AS b, count(*) FILTER (has AND cohort = 'baseline') AS c, count(*) FILTER (NOT has AND cohort = 'baseline') AS e FROM f GROUP BY feature)
SELECT feature, CASE WHEN a + c = 0 OR b + e = 0 THEN 0 ELSE round(ln((a + 0.5) * (e + 0.5) / ((b + 0.5) * (c + 0.5))), 6) END::DOUBLE AS log_odds, round(sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (e + 0.5)), 6)::DOUBLE AS se FROM g""")
def feature_log_odds(s: SparkSession, d: str) -> DataFrame:
    p = V.prompts(s, d)
    has = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.contains(F.coalesce("text", F.lit("")), F.lit(m)).alias("has")) for i, m in enumerate(("|", "!!", "$$", ". ", "zzzzzz"), 1))))
    f = p.select("cohort", has.alias("f")).select("cohort", "f.*")
    n = lambda h, c: F.count_if((F.col("has") == h) & (F.col("cohort") == c))
    g = f.groupBy("feature").agg(n(True, "target").alias("a"), n(False, "target").alias("b"), n(True, "baseline").alias("c"), n(False, "baseline").alias("e"))
    a, b, c, e = (F.col(x) + 0.5 for x in "abce")
    flat = (F.col("a") + F.col("c") == 0) | (F.col("b") + F.col("e") == 0)
    return g.select("feature", F.when(flat, 0.0).otherwise(F.round(F.log(a * e / (b * c)), 6)).alias("log_odds"), F.round(F.sqrt(1 / a + 1 / b + 1 / c + 1 / e), 6).alias("se"))


# --- topics and permutation over authors ---------------------------------------------------------------------

AUTHOR_TOPICS = V.PROMPTS + f""",
ac AS (SELECT author_id, cohort, topic_id, count(*) AS n FROM prompts GROUP BY ALL), au AS (SELECT DISTINCT author_id, cohort FROM prompts),
an AS (SELECT author_id, cohort = 'target' AS is_target FROM au),
{sql_labels("an", "author_id", SEED, DRAWS)},
lb AS (SELECT perm, author_id, drawn AS is_target FROM labels UNION ALL SELECT -1, author_id, is_target FROM an),
ct AS (SELECT perm, topic_id, CAST(sum(n) FILTER (is_target) AS DOUBLE) AS t, CAST(sum(n) FILTER (NOT is_target) AS DOUBLE) AS b FROM ac JOIN lb USING (author_id) GROUP BY ALL),
sh AS (SELECT perm, coalesce(t, 0) / sum(t) OVER (PARTITION BY perm) AS p, coalesce(b, 0) / sum(b) OVER (PARTITION BY perm) AS q FROM ct),
js AS (SELECT perm, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS jsd FROM sh GROUP BY perm)"""


@query(AUTHOR_TOPICS + f" SELECT round(o.jsd, 6) AS jsd, (1 + count(*) FILTER (j.jsd >= o.jsd - 1e-12)) / (1 + {DRAWS}) AS p_value FROM js j, (SELECT jsd FROM js WHERE perm = -1) o WHERE perm >= 0 GROUP BY o.jsd")
def jsd_perm(s: SparkSession, d: str) -> DataFrame:
    p = V.prompts(s, d)
    n = p.groupBy("author_id", F.col("cohort").alias("community"), F.col("topic_id").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    topics = sorted(r["category"] for r in n.select("category").distinct().collect())  # a handful
    real, p_value = S.permutation_jsd(n, "author_id", topics, DRAWS, SEED)
    return s.createDataFrame([(round(real, 6), p_value)], "jsd double, p_value double")


@query(V.PROMPTS + """, c AS (SELECT domain, count(*) FILTER (cohort = 'target') AS t, count(*) FILTER (cohort = 'baseline') AS b FROM prompts GROUP BY domain), x AS (SELECT t / sum(t) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT round(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 6) AS jsd FROM x""")
def domain_jsd(s: SparkSession, d: str) -> DataFrame:
    t = F.col("cohort") == "target"
    c = V.prompts(s, d).groupBy("domain").agg(F.count_if(t).alias("t"), F.count_if(~t).alias("b"))
    w = Window.partitionBy()
    x = c.select((F.col("t") / F.sum("t").over(w)).alias("p"), (F.col("b") / F.sum("b").over(w)).alias("q"))
    return x.agg(F.round(F.sum(I.jsd_term(F.col("p"), F.col("q"))), 6).alias("jsd"))


@query(V.PROMPTS + ", c AS (SELECT topic_id, count(*) FILTER (cohort = 'target') / sum(count(*) FILTER (cohort = 'target')) OVER () - count(*) FILTER (cohort = 'baseline') / sum(count(*) FILTER (cohort = 'baseline')) OVER () AS gap FROM prompts GROUP BY topic_id) SELECT topic_id, round(gap, 6) AS gap FROM c ORDER BY abs(round(gap, 6)) DESC, topic_id LIMIT 2")
def divergent_topics(s: SparkSession, d: str) -> DataFrame:
    t = F.col("cohort") == "target"
    w = Window.partitionBy()
    c = V.prompts(s, d).groupBy("topic_id").agg(F.count_if(t).alias("t"), F.count_if(~t).alias("b"))
    g = c.select("topic_id", F.round(F.col("t") / F.sum("t").over(w) - F.col("b") / F.sum("b").over(w), 6).alias("gap"))
    return g.orderBy(F.desc(F.abs("gap")), "topic_id").limit(2)


MW = V.USAGE + """,
a AS (SELECT side, scale, author_id, avg(answer) AS value FROM usage WHERE answer > 0 GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY scale ORDER BY value) + (count(*) OVER (PARTITION BY scale, value) - 1) / 2 AS mr, count(*) OVER (PARTITION BY scale, value) AS t FROM a),
u AS (SELECT scale, count(*) FILTER (side = 'target') AS n_t, count(*) FILTER (side = 'baseline') AS n_b, sum(mr) FILTER (side = 'target') AS rs, CAST(sum(t * t - 1) AS BIGINT) AS tie FROM r GROUP BY scale),
mw AS (SELECT scale, n_t, n_b, tie, rs - n_t * (n_t + 1) / 2 AS u_t FROM u)"""


@query(MW + " SELECT scale, n_t AS n_target, n_b AS n_baseline, tie AS tie_term, u_t AS u_target, round(1 - 2 * u_t / (n_t * n_b), 6) AS rank_biserial FROM mw")
def mann_whitney(s: SparkSession, d: str) -> DataFrame:
    out = S.mann_whitney(R.author_means(V.usage(s, d), ["side", "scale"]), ["scale"])
    return out.select("scale", "n_target", "n_baseline", "tie_term", "u_target", F.round("rank_biserial", 6).alias("rank_biserial"))


@query()
def usage_fdr(s: SparkSession, d: str) -> DataFrame:
    tested = S.mann_whitney_p(S.mann_whitney(R.author_means(V.usage(s, d), ["side", "scale"]), ["scale"]))
    return S.benjamini_hochberg(tested.filter("p_value IS NOT NULL"), tie="scale").select("scale", "u_target", "p_value", "q_value", "significant")


@query(V.USAGE + ", a AS (SELECT side, scale, author_id, avg(answer) AS value FROM usage WHERE answer > 0 GROUP BY ALL) SELECT scale, author_id, side, rank() OVER (PARTITION BY scale ORDER BY value) + (count(*) OVER (PARTITION BY scale, value) - 1) / 2 AS midrank FROM a")
def midrank(s: SparkSession, d: str) -> DataFrame:
    a = R.author_means(V.usage(s, d), ["side", "scale"])
    return a.join(K.midranks(a, "value", ["scale"]), ["scale", "value"]).select("scale", "author_id", "side", "midrank")


# --- sampling ------------------------------------------------------------------------------------------------


@query(V.PROMPTS + ", r AS (SELECT prompt_id, cohort, topic_id, row_number() OVER (PARTITION BY topic_id, cohort ORDER BY md5(concat_ws(':', '5', prompt_id)), prompt_id) AS n, count(*) FILTER (cohort = 'target') OVER (PARTITION BY topic_id) AS t, count(*) FILTER (cohort = 'baseline') OVER (PARTITION BY topic_id) AS b FROM prompts) SELECT prompt_id, cohort, topic_id FROM r WHERE n <= least(t, b)")
def match_frequencies(s: SparkSession, d: str) -> DataFrame:
    return P.match_frequencies(V.prompts(s, d), "cohort", "topic_id", "prompt_id", 5).select("prompt_id", "cohort", "topic_id")


@query(V.PROMPTS + " SELECT author_id, prompt_id FROM (SELECT author_id, prompt_id, row_number() OVER (PARTITION BY author_id ORDER BY md5(concat_ws(':', '9', prompt_id)), prompt_id) AS n FROM prompts) WHERE n <= 4")
def per_author_cap(s: SparkSession, d: str) -> DataFrame:
    return P.per_group_cap(V.prompts(s, d), "author_id", "prompt_id", 4, 9).select("author_id", "prompt_id")


@query(V.PROMPTS + " SELECT author_id, (row_number() OVER (ORDER BY md5(concat_ws(':', '3', author_id)), author_id) - 1) % 5 AS fold FROM (SELECT DISTINCT author_id FROM prompts)")
def fold_round_robin(s: SparkSession, d: str) -> DataFrame:
    return P.round_robin_folds(V.prompts(s, d), 5, 3)


@query(V.PROMPTS + " SELECT author_id, row_number() OVER (ORDER BY md5(concat_ws(':', 'null', author_id)), author_id) % 2 AS half FROM (SELECT DISTINCT author_id FROM prompts WHERE cohort = 'target')")
def null_split(s: SparkSession, d: str) -> DataFrame:
    a = V.prompts(s, d).filter("cohort = 'target'").select("author_id").distinct()
    return P.hash_rank(a, "null", "author_id", "k").select("author_id", (F.col("k") % 2).cast("long").alias("half"))


@query(V.AUTHORS + " SELECT age, author_id FROM (SELECT age, author_id, row_number() OVER (PARTITION BY age ORDER BY md5(concat_ws(':', '1', author_id)), author_id) AS n FROM authors WHERE cohort = 'target') WHERE n <= 3")
def stratified_author_sample(s: SparkSession, d: str) -> DataFrame:
    return P.per_group_cap(V.authors(s, d).filter("cohort = 'target'"), "age", "author_id", 3, 1).select("age", "author_id")


@query("SELECT CAST(p AS DOUBLE) AS p, count(*) AS n FROM documents, (VALUES (0.25, '40000000'), (0.5, '80000000'), (0.75, 'c0000000')) AS x(p, b) WHERE substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) < b GROUP BY p")
def density_dial(s: SparkSession, d: str) -> DataFrame:
    docs = V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("k"))
    kept = F.explode(F.array(*(F.when(P.density_dial(docs, "k", p), F.lit(p)) for p in (0.25, 0.5, 0.75))))
    return docs.select(kept.alias("p")).filter("p IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# --- text functions ------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({TOK}) AS n_tokens, len(list_distinct({TOK})) AS n_types FROM documents")
def tokenizer(s: SparkSession, d: str) -> DataFrame:
    t = V.table(s, d, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_types"))


_PHRASE = "coalesce(nullif(trim(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^a-z0-9]+', ' ', 'g')), ''), 'unknown request')"


@query(f"SELECT doc_id, {_PHRASE} AS phrase, array_to_string(string_split({_PHRASE}, ' ')[1:4], '_') AS instruction_id FROM documents")
def phrase_normalize(s: SparkSession, d: str) -> DataFrame:
    p = V.table(s, d, "documents").select("doc_id", T.normalized_phrase(F.col("text")).alias("phrase"))
    return p.withColumn("instruction_id", T.instruction_id(F.col("phrase")))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(concat(p_name, ' isFooBar ', p_brand), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_+', '_', 'g'), '_') AS axis_id FROM part")
def normalize_axis_id(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "part").select("p_partkey", T.axis_id(F.concat("p_name", F.lit(" isFooBar "), "p_brand")).alias("axis_id"))


_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{x}') AND length(w) - {len(x)} >= 4 THEN substr(w, 1, length(w) - {len(x)})" for x in T.SUFFIXES) + " ELSE w END"
_QSTOP = ", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS)
STEMS = f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: w NOT IN ({_QSTOP})), lambda w: {_STEM}))"


@query(f"SELECT item_id, array_to_string(list_sort({STEMS}), ' ') AS stems FROM benchmark")
def question_key(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.question_tokens(F.col("text"))), " ").alias("stems"))


_WS = r"[ \t\n\x0B\f\r]+"


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda w: w <> '')[1:120], ' ') AS head FROM documents")
def truncate_words(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "documents").select("doc_id", T.first_words(F.col("text"), 120).alias("head"))


@query(
    r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?s).+?[.!?]+(?:[ \t\n\x0B\f\r]+|\z)|.+'), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]'))) AS n_sentences,
  md5(coalesce(text, '')) AS joined FROM documents"""
)
def sentence_split(s: SparkSession, d: str) -> DataFrame:
    """The number of sentences, and the digest of the text that joining them gives: that of the text itself."""
    rows = V.table(s, d, "documents")
    return rows.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.md5(F.array_join(T.sentence_pieces(F.col("text")), "")).alias("joined"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text), 6) AS ascii_share FROM documents WHERE length(text) > 0")
def post_cleaning(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "documents").filter(F.length("text") > 0).select("doc_id", F.round(T.ascii_share(F.col("text")), 6).alias("ascii_share"))


@query("SELECT user_id, CASE WHEN a < 18 THEN 'under 18' WHEN a < 25 THEN '18-24' WHEN a < 35 THEN '25-34' WHEN a < 50 THEN '35-49' ELSE '50+' END AS bracket FROM (SELECT DISTINCT user_id, user_id % 70 AS a FROM events)")
def age_bracket(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "events").select("user_id").distinct().select("user_id", T.age_bracket(F.col("user_id") % 70).alias("bracket"))


@query("SELECT doc_id, CASE WHEN starts_with(h, 'YES') THEN true WHEN starts_with(h, 'NO') THEN false END AS verdict FROM (SELECT doc_id, upper(CASE doc_id % 4 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'no, it does not' WHEN 2 THEN 'perhaps' ELSE 'YES' END) AS h FROM documents)")
def yes_no_parse(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, ' "Yes."').when(k == 1, "no, it does not").when(k == 2, "perhaps").otherwise("**YES**")
    return V.table(s, d, "documents").select("doc_id", T.yes_no(raw).alias("verdict"))


@query("SELECT doc_id, (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'and') AS INT)) > (CAST(contains(lower(text), 'der') AS INT) + CAST(contains(lower(text), 'les') AS INT) + CAST(contains(lower(text), 'que') AS INT)) AS reads_target FROM documents")
def cue_counting(s: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return V.table(s, d, "documents").select("doc_id", (T.cue_count(c, ("the", "and")) > T.cue_count(c, ("der", "les", "que"))).alias("reads_target"))


@query(V.TRACE + " SELECT model, CASE WHEN starts_with(model, 'mock') THEN 'mock' WHEN starts_with(model, 'claude') THEN 'anthropic' WHEN starts_with(model, 'gemini') THEN 'google' ELSE 'openai' END AS provider, count(*) AS n FROM trace GROUP BY ALL")
def model_routing(s: SparkSession, d: str) -> DataFrame:
    return V.trace(s, d).groupBy("model", T.model_provider(F.col("model")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, round(-log10(greatest(p, 1e-4)), 6) AS evidence FROM (SELECT source, count(*) FILTER (lang = 'xx') / count(*) + 1.0 / count(*) AS p FROM documents GROUP BY source)")
def evidence(s: SparkSession, d: str) -> DataFrame:
    p = V.table(s, d, "documents").groupBy("source").agg((F.count_if(F.col("lang") == "xx") / F.count(F.lit(1)) + 1 / F.count(F.lit(1))).alias("p"))
    return p.select("source", F.round(I.evidence(F.col("p")), 6).alias("evidence"))


# --- conditional verdicts ------------------------------------------------------------------------------------

STRATUM = V.PROMPTS + """, sx AS (SELECT domain, count(*) FILTER (cohort = 'target') AS n_t, count(*) FILTER (cohort = 'baseline') AS n_b, avg(codedness) FILTER (cohort = 'target') - avg(codedness) FILTER (cohort = 'baseline') AS stat,
  greatest(1e-4, least(1, abs(avg(codedness) FILTER (cohort = 'target') - avg(codedness) FILTER (cohort = 'baseline')) * 5)) AS p FROM prompts GROUP BY domain)"""


def strata(s, d):
    t = F.col("cohort") == "target"
    gap = F.avg(F.when(t, F.col("codedness"))) - F.avg(F.when(~t, F.col("codedness")))
    rows = V.prompts(s, d).groupBy("domain").agg(F.count_if(t).alias("n_t"), F.count_if(~t).alias("n_b"), gap.alias("stat"))
    return rows.withColumn("p", F.greatest(F.lit(1e-4), F.least(F.lit(1.0), F.abs("stat") * 5)))


@query(STRATUM + " SELECT round(sum(least(n_t, n_b) * stat) / sum(least(n_t, n_b)), 6) AS conditional, count(*) AS n_strata FROM sx")
def weighted_mean_by_stratum(s: SparkSession, d: str) -> DataFrame:
    w = F.least("n_t", "n_b")
    return strata(s, d).agg(F.round(F.sum(w * F.col("stat")) / F.sum(w), 6).alias("conditional"), F.count(F.lit(1)).alias("n_strata"))


@query(STRATUM + ", x AS (SELECT -sum(ln(p)) AS h, count(*) AS k FROM sx), t AS (SELECT h, unnest(range(k)) AS i FROM x) SELECT round(least(1, sum(exp(-h) * pow(h, i) / factorial(CAST(i AS INT)))), 6) AS p_value FROM t")
def fisher_combine(s: SparkSession, d: str) -> DataFrame:
    return strata(s, d).agg(F.collect_list("p").alias("ps")).select(F.round(I.fisher_combined_p(F.col("ps")), 6).alias("p_value"))


@query(STRATUM + """, c AS (SELECT sum(least(n_t, n_b) * stat) / sum(least(n_t, n_b)) AS cond, -sum(ln(p)) AS h FROM sx), m AS (SELECT avg(codedness) FILTER (cohort = 'target') - avg(codedness) FILTER (cohort = 'baseline') AS marg FROM prompts),
q AS (SELECT cond, marg, exp(-h) * (1 + h + h * h / 2) AS p FROM c, m)
SELECT round(marg, 6) AS marginal, round(cond, 6) AS conditional, CASE WHEN p <= 0.05 AND cond > marg + 1e-9 THEN 'revealed' WHEN p <= 0.05 THEN 'survives' WHEN abs(marg) > 0.05 THEN 'topic-choice' ELSE 'inconclusive' END AS label FROM q""")
def conditional_verdict(s: SparkSession, d: str) -> DataFrame:
    w = F.least("n_t", "n_b")
    c = strata(s, d).agg((F.sum(w * F.col("stat")) / F.sum(w)).alias("cond"), F.collect_list("p").alias("ps")).withColumn("p", I.fisher_combined_p(F.col("ps")))
    t = F.col("cohort") == "target"
    m = V.prompts(s, d).agg((F.avg(F.when(t, F.col("codedness"))) - F.avg(F.when(~t, F.col("codedness")))).alias("marg"))
    label = F.when((F.col("p") <= 0.05) & (F.col("cond") > F.col("marg") + 1e-9), "revealed").when(F.col("p") <= 0.05, "survives").when(F.abs("marg") > 0.05, "topic-choice").otherwise("inconclusive")
    return c.join(F.broadcast(m)).select(F.round("marg", 6).alias("marginal"), F.round("cond", 6).alias("conditional"), label.alias("label"))  # a row each


# --- embeddings ----------------------------------------------------------------------------------------------


@query(V.VECTORS + " SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM vectors")
def vector_norms(s: SparkSession, d: str) -> DataFrame:
    return V.vectors(s, d).select("vec_id", F.round(F.sqrt(R.dot("v", "v")), 6).alias("norm"))


@query(V.VECTORS + """, h AS (SELECT vec_id, side, v FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY md5(concat_ws(':', '330', vec_id)), vec_id) AS n FROM vectors) WHERE n <= 60)
SELECT CASE WHEN a.side = b.side THEN 'within' ELSE 'between' END AS kind, count(*) AS n, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS mean FROM h a JOIN h b ON a.vec_id < b.vec_id GROUP BY ALL""")
def similarity_summary(s: SparkSession, d: str) -> DataFrame:
    # a sample of 60 a side by definition, so its pairs are few
    h = P.per_group_cap(V.vectors(s, d), "side", "vec_id", 60, 330).select("vec_id", "side", "v")
    b = h.select(F.col("vec_id").alias("vb"), F.col("side").alias("sb"), F.col("v").alias("w"))
    p = h.join(F.broadcast(b), F.col("vec_id") < F.col("vb"))
    kind = F.when(F.col("side") == F.col("sb"), "within").otherwise("between")
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(R.cosine("v", "w")), 6).alias("mean"))


@query(V.VECTORS + ", sc AS (SELECT vec_id, side = 'target' AS y, round(v[1], 9) AS s FROM vectors), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS mr FROM sc) SELECT round((sum(mr) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM r")
def roc_auc(s: SparkSession, d: str) -> DataFrame:
    sc = V.vectors(s, d).select((F.col("side") == "target").alias("y"), F.round(F.col("v")[0], 9).alias("s"))
    r = K.midranks(sc, "s", sums=[F.count_if("y").alias("p")]).withColumnRenamed("midrank", "mr")
    a = r.agg(F.sum(F.col("mr") * F.col("p")).alias("rs"), F.sum("p").alias("p"), (F.sum("n") - F.sum("p")).alias("q"))
    return a.select(F.round((F.col("rs") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


def _weights(k: int = 64) -> list[float]:
    return [math.sin(i + 1) for i in range(k)]


_W = "[" + ", ".join(f"sin({i + 1}.0)" for i in range(64)) + "]"


@query(V.VECTORS + f", p AS (SELECT vec_id, i, v[i] * ({_W})[i] / 64 AS a FROM vectors, range(1, 65) AS r(i)) SELECT vec_id, i AS token, round(a, 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(a), 9) DESC, i) AS n FROM p) WHERE n <= 3")
def token_attribution(s: SparkSession, d: str) -> DataFrame:
    w = F.array(*map(F.lit, _weights()))
    p = V.vectors(s, d).select("vec_id", F.posexplode(F.zip_with("v", w, lambda x, y: x * y / 64)).alias("i", "a")).withColumn("token", (F.col("i") + 1).cast("long"))
    return R.first_n(p, ["vec_id"], [F.desc(F.round(F.abs("a"), 9)), "token"], 3).select("vec_id", "token", F.round("a", 6).alias("contribution"))


# --- mock world ----------------------------------------------------------------------------------------------

#: Planted yes rates of the two sides per axis, as md5 bounds of 8 hex digits.
RATES = {"warm": ("c0000000", "60000000"), "long": ("80000000", "80000000"), "hedged": ("40000000", "90000000")}
_RATE = ", ".join(f"('{a}', '{t}', '{b}')" for a, (t, b) in RATES.items())


@query(V.PROMPTS + f""", r AS (SELECT prompt_id, cohort, k FROM prompts, range(3) AS x(k)), v AS (SELECT cohort, axis_id, substr(md5(concat_ws(':', '42', prompt_id, k, axis_id)), 1, 8) < CASE WHEN cohort = 'target' THEN t ELSE b END AS y FROM r, (VALUES {_RATE}) AS a(axis_id, t, b))
SELECT axis_id, count(*) AS n, round(avg(CAST(y AS INT)) FILTER (cohort = 'target'), 6) AS rate_target, round(avg(CAST(y AS INT)) FILTER (cohort = 'baseline'), 6) AS rate_baseline FROM v GROUP BY axis_id""")
def mock_pipeline(s: SparkSession, d: str) -> DataFrame:
    axes = F.explode(F.array(*(F.struct(F.lit(a).alias("axis_id"), F.lit(t).alias("t"), F.lit(b).alias("b")) for a, (t, b) in RATES.items())))
    r = V.prompts(s, d).select("prompt_id", "cohort", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("*", axes.alias("a"))
    coin = F.substring(P.hashed(42, "prompt_id", "k", "a.axis_id"), 1, 8) < F.when(F.col("cohort") == "target", F.col("a.t")).otherwise(F.col("a.b"))
    v = r.select(F.col("a.axis_id").alias("axis_id"), "cohort", coin.cast("int").alias("y"))
    on = lambda c: F.round(F.avg(F.when(F.col("cohort") == c, F.col("y"))), 6)
    return v.groupBy("axis_id").agg(F.count(F.lit(1)).alias("n"), on("target").alias("rate_target"), on("baseline").alias("rate_baseline"))
