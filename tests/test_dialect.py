"""The dialect dial beside a plain rewriting of each sentence, its nesting, the cache of rewritings, the delta table."""

import hashlib
import re

import pytest

from cohortlens.operators import dialect as D
from cohortlens.sources.deltas import DeltaTable
from pyspark.sql import functions as F

TEXTS = [
    "He is running home. They were there!  There is not a way... She wants that",
    "I don't know any of it. I didn't see anything.\n\nYou guys are going to win? He has already left; those cats have been sleeping.",
    "No mark here, and they're late", "", "   ", None, "?!", " Leading. Trailing. \t", "He usually is here. " * 400, "a.b.c they are x", "Nothing of it. Nothing of it.",
]


def plain(text):
    pieces = re.findall(r"(?s).+?[.!?]+(?:[ \t\n\x0B\f\r]+|\Z)|.+", text or "")
    out = []
    for p in pieces:
        core = p.rstrip(D.SPACE)
        now, n = core, 0
        for r in D.RULES:
            then = re.sub(r.pattern, re.sub(r"\$(\d)", r"\\\1", r.to), now)
            now, n = then, n + (then != now)
        out.append((p, core, now, n))
    return out


def coin(seed, key, i):
    return hashlib.md5(f"{seed}:{key}:{i}".encode()).hexdigest()[:8]


def at(text, key, p, seed):
    parts, rules = [], 0
    for i, (piece, core, now, n) in enumerate(plain(text)):
        keep = now != core and coin(seed, key, i) < D.bound(p)
        parts.append(now + piece[len(core):] if keep else piece)
        rules += n if keep else 0
    text = "".join(parts).strip(D.SPACE)
    words = max(len(re.findall(r"[^ \t\n\x0B\f\r]+", text)), 1)
    return text, rules, int(rules > 0), min((20000 * rules + words) // (2 * words), 10000) / 10000


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame([(f"p{i}", f"a{i % 4}", "old", t) for i, t in enumerate(TEXTS)], "prompt_id string, author_id string, cohort string, text string")


def test_every_density_equals_plain_rewriting(prompts):
    rows = D.dialect_cohorts(D.rewrite_sentences(prompts, seed=3)).collect()
    assert len(rows) == len(TEXTS) * len(D.DENSITIES)
    for r in rows:
        want = at(TEXTS[int(r["prompt_id"][1:])], r["prompt_id"], D.DENSITIES[r["cohort"]], 3)
        assert (r["text"], r["n_rules"], r["markedness"], r["codedness"]) == want
    full = {r["prompt_id"]: r for r in rows if r["cohort"] == "value_p100"}
    assert full["p0"]["text"] == "He running home. They was there!  There ain't a way... She want that" and full["p0"]["n_rules"] == 4
    assert full["p1"]["text"] == "I don't know no of it. I didn't see nothing.\n\nYou guys gon win? He done left; them cats been sleeping."
    assert full["p3"]["text"] == full["p5"]["text"] == "" and full["p5"]["codedness"] == 0


def test_each_rule_changes_its_example_and_needs_hold_in_every_match(spark):
    texts = {
        "negated_auxiliary": "it is not so", "negative_concord": "I don't want any more", "negative_concord_pronoun": "we never saw anybody", "existential_it": "there are two", "going_to": "he is going to go",
        "habitual_be": "she always is late", "zero_copula": "they're late", "levelled_was": "we were late", "remote_been": "he has been singing", "completive_done": "I have already eaten", "uninflected_third_person": "it works",
        "demonstrative_them": "see those dogs", "plural_you": "you all know", "relative_what": "all that he said",
    }
    assert list(texts) == [r.name for r in D.RULES]
    for r in D.RULES:
        m = re.search(r.pattern, texts[r.name])
        assert m and any(x in m.group(0) for x in r.needs), r.name
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    free = tuple(r._replace(needs=("",)) for r in D.RULES)
    both = docs.select(D.rewritten(F.col("text")).alias("a"), D.rewritten(F.col("text"), free).alias("b"))
    assert both.filter("NOT (a <=> b)").count() == 0 and both.filter("a.n_rules > 0").count() > 0


def test_densities_nest_and_pieces_join_to_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("prompt_id"), "text")
    s = D.rewrite_sentences(docs, seed=1)
    assert s.filter(F.array_join(F.transform("sentences", lambda x: x["piece"]), "") != F.coalesce("text", F.lit(""))).count() == 0
    many = spark.range(20).select(F.col("id").cast("string").alias("prompt_id"), F.lit("They are late. " * 30).alias("text"))
    s = D.rewrite_sentences(many, seed=1)
    low, high = ({(r["prompt_id"], i) for r in s.collect() for i, x in enumerate(r["sentences"]) if x["coin"] is not None and x["coin"] < D.bound(p)} for p in (0.25, 0.5))
    assert low < high and 100 < len(low) < 200 < len(high) < 400


def test_unmarked_cohorts_split_authors(prompts):
    rows = D.unmarked_cohorts(prompts).collect()
    assert len(rows) == 2 * len(TEXTS) and {r["codedness"] for r in rows} == {0.0}
    sides = {c: {r["author_id"] for r in rows if r["cohort"] == c} for c in ("null_split_a", "null_split_b", "baseline")}
    assert len(sides["null_split_a"]) == len(sides["null_split_b"]) == 2 and not sides["null_split_a"] & sides["null_split_b"]


def test_cache_asks_for_each_distinct_sentence_once(spark, prompts, tmp_path):
    asked = []

    def rewrite(rows):
        asked.extend(r["core"] for r in rows.collect())
        to = D.rewritten(F.col("core"))
        return rows.filter("core <> '?!'").select("core", to["text"].alias("text"), to["n_rules"].alias("n_rules"))

    cache = D.RewriteCache(spark, str(tmp_path / "c"), rewrite)
    key = lambda rows: sorted((r["prompt_id"], r["cohort"], r["text"], r["n_rules"]) for r in rows.collect())
    want = key(D.dialect_cohorts(D.rewrite_sentences(prompts, seed=3)))
    assert key(D.dialect_cohorts(cache.sentences(prompts, seed=3))) == want
    n = len(asked)
    assert n == len(set(asked)) and asked.count("Nothing of it.") == 1
    assert key(D.dialect_cohorts(cache.sentences(prompts, seed=3))) == want and len(asked) == n
    more = spark.createDataFrame([("x", "a", "Nothing of it. He is new.")], "prompt_id string, author_id string, text string")
    assert cache.sentences(more).count() == 1 and asked[n:] == ["He is new."]
    assert cache.sentences(prompts.limit(0)).count() == 0


def test_delta_without_a_record_is_not_read(spark, tmp_path):
    t = DeltaTable(spark, str(tmp_path / "t"), "a long")
    assert t.read().count() == 0
    t.append(spark.range(3).toDF("a"))
    spark.range(5).toDF("a").write.parquet(str(tmp_path / "t" / "delta-lost"))  # a writer that died before its record
    t.append(spark.range(2).toDF("a"))
    assert t.read().count() == 5
