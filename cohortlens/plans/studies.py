"""Queries of the call surface: what models are asked and say, the mock world from prompts to report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import protocol as P
from ..operators import judging as J
from ..operators import statistics as S
from ..operators import taxonomy
from ..sources import views as V
from . import scripted as M
from . import treatment as T

QUERIES, ORACLE = {}, {}
SAMPLES, SEED = 3, 42


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip() if sql.lstrip().upper().startswith("SELECT") else "WITH " + sql.strip()
        return f

    return add


def text_of(x: str) -> str:
    """A SQL literal; line breaks by chr(10)."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


_BASE = " UNION ALL ".join(f"SELECT response_id, sample_index, '{a}' AS axis_id, {a} AS base FROM responses" for a in V.AXES)


@query(V.RESPONSES + f""", u AS ({_BASE} UNION ALL SELECT response_id, sample_index, 'absent', NULL FROM responses)
SELECT response_id, axis_id, CASE WHEN sample_index % 7 <> 0 THEN base END AS verdict FROM u""")
def verdict_map(s: SparkSession, d: str) -> DataFrame:
    said = F.to_json(F.struct(*(F.when(F.col(a), "Yes.").otherwise('"no"').alias(a) for a in V.AXES)))
    reply = F.when(F.col("sample_index") % 7 != 0, F.concat(F.lit("<think>{}</think>Here:\n```json\n"), said, F.lit("\n```"))).otherwise("I cannot say.")
    return V.responses(s, d).select("response_id", F.explode(P.verdict_map(reply, [*V.AXES, "absent"])).alias("axis_id", "verdict"))


_LINES = "\n".join(f"- {a}: {q}" + ("\n    rubric: as asked" if i == 0 else "") for i, (a, q) in enumerate(V.QUESTIONS.items()))


@query(V.RESPONSES + f""" SELECT response_id, md5({text_of("Evaluate the response below along each axis." + chr(10) * 2 + "Axes:" + chr(10) + _LINES + chr(10) * 2 + P.RESPONSE_START + chr(10))} || response_id || {text_of(chr(10) + P.RESPONSE_END + chr(10) * 2 + 'Answer with ONLY a JSON object mapping every axis id to "YES" or "NO". Do not include any other text.')}) AS prompt_md5, 'returned,shipped,discounted,taxed,bulky' AS listed FROM responses""")
def judge_prompts(s: SparkSession, d: str) -> DataFrame:
    axes = F.array(*(F.struct(F.lit(a).alias("axis_id"), F.lit(q).alias("question"), F.lit(" as asked " if i == 0 else None).cast("string").alias("rubric")) for i, (a, q) in enumerate(V.QUESTIONS.items())))
    prompt = P.judge_prompt(axes, F.col("response_id"))
    return V.responses(s, d).select("response_id", F.md5(prompt).alias("prompt_md5"), F.array_join(P.listed_axes(prompt), ",").alias("listed"))


@query("SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS slice_md5 FROM documents")
def sentinel_slice(s: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit(f"before {P.RESPONSE_START}\n"), F.coalesce("text", F.lit("")), F.lit(f"\n{P.RESPONSE_END} after"))
    return V.table(s, d, "documents").select("doc_id", F.md5(P.between(marked, P.RESPONSE_START, P.RESPONSE_END)).alias("slice_md5"))


RULES = M.RULES + ((("the", "and"), "english words"), (("der", "und"), "german words"))
_CASE = "CASE " + " ".join("WHEN " + " OR ".join("contains(lower(coalesce(text, '')), '" + w.replace("'", "''") + "')" for w in words) + f" THEN '{label}'" for words, label in RULES) + " ELSE 'other' END"


@query(f"SELECT doc_id, {_CASE} AS label FROM documents")
def keyword_cascade(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "documents").select("doc_id", P.first_rule(F.col("text"), list(RULES), "other").alias("label"))


@query("""t AS (SELECT doc_id, trim(coalesce(source, '')) AS title, trim(coalesce(text, '')) AS body FROM documents),
u AS (SELECT doc_id, body, CASE WHEN body <> '' THEN trim(title || chr(10) || chr(10) || body) ELSE title END AS t FROM t)
SELECT doc_id, length(t) AS n FROM u WHERE lower(body) NOT IN ('[removed]', '[deleted]') AND length(t) >= 80 AND NOT contains(lower(t), 'idiot') AND NOT contains(lower(t), 'scum')
  AND (contains(lower(t), 'the') OR contains(lower(t), 'ein')) AND doc_id % 10 <> 0""")
def keyword_filter(s: SparkSession, d: str) -> DataFrame:
    text = P.usable_post(F.col("source"), F.col("text"), ("idiot", "scum"), ("the", "ein"), F.col("doc_id") % 10 == 0)
    return V.table(s, d, "documents").select("doc_id", text.alias("t")).filter("t IS NOT NULL").select("doc_id", F.length("t").cast("long").alias("n"))


_NONE = ", ".join(f"'{w}'" for w in P.DOMAIN_STOPWORDS)


@query(f"SELECT item_id, coalesce(list_filter(regexp_split_to_array(replace(lower(coalesce(text, '')), ',', ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: length(x) > 4 AND x NOT IN ({_NONE}))[1], 'advice') AS keyword FROM benchmark")
def domain_keyword(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "benchmark").select("item_id", P.domain_keyword(F.col("text")).alias("keyword"))


@query(V.PROMPTS + """, r AS (SELECT cohort, text, row_number() OVER (PARTITION BY cohort ORDER BY md5(concat_ws(':', '0', prompt_id)), prompt_id) AS n FROM prompts),
l AS (SELECT cohort, n, '- ' || substr(regexp_replace(trim(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), 1, 700) AS t FROM r WHERE n <= 6)
SELECT cohort AS community, md5(string_agg(t, chr(10) ORDER BY n)) AS block_md5 FROM l GROUP BY cohort""")
def sample_block(s: SparkSession, d: str) -> DataFrame:
    rows = V.prompts(s, d).select(F.col("cohort").alias("community"), F.col("prompt_id").alias("response_id"), "text")
    return J.sample_block(rows).select("community", F.md5("block").alias("block_md5"))


@query("""l AS (SELECT lang, source, n_chars % 400 AS topic, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS place FROM documents),
n AS (SELECT *, place = min(place) OVER (PARTITION BY lang, source, topic) AS is_new FROM l),
q AS (SELECT *, place - coalesce(max(CASE WHEN is_new THEN place END) OVER (PARTITION BY lang, source ORDER BY place), -1) AS quiet FROM n),
e AS (SELECT *, min(CASE WHEN quiet >= 2 THEN place END) OVER (PARTITION BY lang, source) AS stop FROM q)
SELECT lang, source, count(*) AS n_asked, count(*) FILTER (is_new) AS n_topics FROM e WHERE stop IS NULL OR place <= stop GROUP BY lang, source""")
def early_stop(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("lang", "source")
    rows = V.table(s, d, "documents").select("lang", "source", (F.col("n_chars") % 400).alias("topic"), (F.row_number().over(by.orderBy("doc_id")) - 1).alias("place"))
    rows = rows.withColumn("is_new", F.col("place") == F.min("place").over(Window.partitionBy("lang", "source", "topic")))
    out = taxonomy.until_quiet(rows, ["lang", "source"], "place", "is_new", 2)
    return out.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_asked"), F.count_if("is_new").alias("n_topics"))


CONDITIONS = {"zero_context": "Propose axes.", "literature": "Propose axes from these abstracts.", "seeded": "", "grounded": "Propose axes from these requests."}


def proposals(s: SparkSession) -> DataFrame:
    return J.propose_axes(CONDITIONS, "mock:helper", M.MOCK, s, SEED)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{q}', 'zero_context,literature,grounded')" for a, q, *_ in M.MOCK_AXES) + ") AS t(axis_id, question, sources)")
def union_axes(s: SparkSession, d: str) -> DataFrame:
    return J.union_axes(proposals(s)).select("axis_id", "question", F.array_join("sources", ",").alias("sources"))


@query("SELECT * FROM (VALUES ('grounded', 'literature', 5, 1::DOUBLE), ('grounded', 'zero_context', 5, 1::DOUBLE), ('literature', 'zero_context', 5, 1::DOUBLE)) AS t(condition_a, condition_b, shared, jaccard)")
def question_overlap(s: SparkSession, d: str) -> DataFrame:
    return J.condition_overlap(proposals(s))


# --- the mock study: prompts, responses, judges, panel, tests, report ----------------------------------------

JUDGES = ("mock:judge", "mock:judge:noisy", "mock:judge:second")


def study_prompts(s: SparkSession, d: str) -> DataFrame:
    """The documents as requests, each with a cue of its side before it."""
    cue = F.when(F.col("cohort") == "target", "so it's giving tarot night. ").otherwise("after barstool with the wifey. ")
    return V.prompts(s, d).select("prompt_id", F.col("cohort").alias("community"), F.col("domain").alias("instruction_id"), F.concat(cue, F.coalesce("text", F.lit(""))).alias("text"))


def study_answers(s: SparkSession, d: str, world: str) -> DataFrame:
    return J.collect_responses(study_prompts(s, d), f"mock:target:{world}", M.MOCK, SAMPLES, SEED)


def study_verdicts(s: SparkSession, answers: DataFrame) -> DataFrame:
    axes = [(r["axis_id"], r["question"], r["rubric"]) for r in J.union_axes(proposals(s)).collect()]
    return J.judge(answers, axes, list(JUDGES), M.MOCK, seed=SEED)


def study_axes(s: SparkSession, answers: DataFrame) -> DataFrame:
    """axis_id, n and rate of both sides, delta, info_bits, p_value, q_value, significant."""
    m = S.cluster_matrix(J.panel_verdict(study_verdicts(s, answers))).persist()
    tested = S.benjamini_hochberg(S.permutation_p_values(m, T.PERMUTATIONS, T.SEED)).drop("delta", "exceed")
    return S.axis_rates(m).join(tested, "axis_id")


_CUES = {side: " + ".join("CAST(contains(lower(t), '" + c.replace("'", "''") + "') AS INT)" for c in cues) for side, cues in (("target", M.TARGET_CUES), ("baseline", M.BASELINE_CUES))}
_AXIS_IDS = tuple(a for a, *_ in M.MOCK_AXES)


def study_sql(world: str) -> str:
    """The study as one statement: planted coins, judges' flips, votes, rates and permutation tests."""
    seed = "('0x' || substr(md5({key}), 1, 7))::BIGINT"
    rate = ", ".join(f"('{a}', '{M.bound(hi)}', '{M.bound(lo)}')" for a, (hi, lo) in M.RATES[world].items())
    sep = "chr(31)"
    judged = ", ".join(f"('{j}', '{M.bound(M.NOISY_FLIPS) if j.endswith('noisy') else '0'}')" for j in JUDGES)
    head = V.PROMPTS + f""",
asked AS (SELECT prompt_id, cohort AS community, k, prompt_id || '#' || k AS response_id, CASE WHEN cohort = 'target' THEN 'so it''s giving tarot night. ' ELSE 'after barstool with the wifey. ' END || coalesce(text, '') AS t,
  {seed.format(key=f"concat_ws({sep}, '{SEED}', prompt_id, CAST(k AS VARCHAR))")} AS seed FROM prompts, range({SAMPLES}) AS x(k)),
cued AS (SELECT prompt_id, community, response_id, seed, ({_CUES["target"]}) > ({_CUES["baseline"]}) AS cue, {seed.format(key=f"concat_ws({sep}, '{SEED}', 'judge', response_id)")} AS jseed FROM asked),
shown AS (SELECT prompt_id, community, response_id, jseed, axis_id, substr(md5(concat_ws(':', 'mock:target:{world}', CAST(seed AS VARCHAR), axis_id)), 1, 8) < CASE WHEN cue THEN hi ELSE lo END AS v
  FROM cued, (VALUES {rate}) AS r(axis_id, hi, lo)),
said AS (SELECT prompt_id, community, response_id, axis_id, judge, v <> (substr(md5(concat_ws(':', judge, CAST(jseed AS VARCHAR), axis_id)), 1, 8) < flip) AS verdict FROM shown, (VALUES {judged}) AS j(judge, flip)),
voted AS (SELECT prompt_id, community, response_id, axis_id, count(*) FILTER (verdict) > count(*) FILTER (NOT verdict) AS verdict FROM said GROUP BY ALL),
matrix AS (SELECT prompt_id, community, axis_id, CAST(sum(CAST(verdict AS INT)) AS BIGINT) AS yes, count(verdict) AS n FROM voted GROUP BY ALL)"""
    return T.tests_sql(T.rates_sql(head), _AXIS_IDS, T.SEED, T.PERMUTATIONS) + "," + T.BH + ", axes AS (SELECT rates.*, p_value, q_value, q_value <= 0.05 AS significant FROM rates JOIN fdr USING (axis_id))"


_SHOWN = " SELECT axis_id, n_target, n_baseline, round(rate_target, 6) AS rate_target, round(rate_baseline, 6) AS rate_baseline, round(delta, 6) AS delta, round(info_bits, 6) AS info_bits, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value, significant FROM axes"


def _study(s: SparkSession, d: str, world: str) -> DataFrame:
    return study_axes(s, study_answers(s, d, world)).select("axis_id", "n_target", "n_baseline", *T.r6("rate_target", "rate_baseline", "delta", "info_bits", "p_value", "q_value"), "significant")


@query(study_sql("biased") + _SHOWN)
def mock_study_biased(s: SparkSession, d: str) -> DataFrame:
    return _study(s, d, "biased")


@query(study_sql("null") + _SHOWN)
def mock_study_null(s: SparkSession, d: str) -> DataFrame:
    return _study(s, d, "null")


@query(study_sql("biased") + """, pq AS (SELECT (rate_target + 0.01) / sum(rate_target + 0.01) OVER () AS p, (rate_baseline + 0.01) / sum(rate_baseline + 0.01) OVER () AS q FROM axes WHERE significant),
top AS (SELECT string_agg(axis_id, ',' ORDER BY round(info_bits, 9) DESC, axis_id) AS top_axes FROM (SELECT * FROM axes WHERE significant ORDER BY round(info_bits, 9) DESC, axis_id LIMIT 3)),
side AS (SELECT count(*) FILTER (cohort = 'target') AS prompts_target, count(*) FILTER (cohort = 'baseline') AS prompts_baseline FROM prompts)
SELECT 'biased' AS run, prompts_target, prompts_baseline, (SELECT count(*) FROM axes WHERE significant) AS significant_axes, (SELECT count(*) FROM axes) AS total_axes,
  (SELECT CASE WHEN count(*) >= 2 THEN round(sum(p * log2(p / q)), 6) END FROM pq) AS d_pi_bits, CAST(0 AS DOUBLE) AS refusal_gap, coalesce(top_axes, '') AS top_axes FROM side, top""")
def run_summary(s: SparkSession, d: str) -> DataFrame:
    from ..operators import reports as R

    answers = study_answers(s, d, "biased")
    return R.run_summary("biased", study_prompts(s, d), study_axes(s, answers), answers)
