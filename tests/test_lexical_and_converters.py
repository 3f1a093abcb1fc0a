"""Fixed values, calibration and converters against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from cohortlens.functions import text as T
from cohortlens.operators import etl
from cohortlens.operators import lexical as L
from cohortlens.operators import relational as R
from cohortlens.operators import sampling as P
from pyspark.sql import functions as F


def test_question_tokens_stem_and_drop_stop_words(spark):
    q = ["Does the response give recommendations?", "Does the response recommend its users' purchases, or stories?", None]
    got = [sorted(r[0]) for r in spark.createDataFrame([(x,) for x in q], "q string").select(T.question_tokens(F.col("q"))).collect()]
    assert got == [["give", "recommend"], ["purchas", "recommend", "stor", "user"], []]


def test_prices_by_bare_model(spark):
    rows = [("gpt-4o-mini-2024", 0.15 + 0.6), ("openai:gpt-4o", 12.5), ("anthropic:claude-haiku-4", 6.0), ("claude-3-5-haiku-x", 4.8), ("mock:target", 0.0), ("unknown", 0.0)]
    df = spark.createDataFrame([(m, 10**6, 10**6) for m, _ in rows], "model string, input_tokens long, output_tokens long")
    assert [r["cost_usd"] for r in R.with_cost(df).collect()] == [pytest.approx(p) for _, p in rows]


def vocabulary(seed, n=400):
    rng = np.random.default_rng(seed)
    words = [*L.STOPWORDS, "i'm", "don't", *(f"w{i}" for i in range(n))]
    t, b = rng.poisson(30, len(words)) + 1, rng.poisson(30, len(words)) + 1
    t[40:60] += rng.integers(0, 200, 20)
    return words, t, b, rng.random(len(words)) * 80 + 1


def log_odds(t, b, at, ab):
    odds = lambda y, a: np.log((y + a) / (y.sum() + a.sum() - y - a))
    return (odds(t, at) - odds(b, ab)) / np.sqrt(1 / (t + at) + 1 / (b + ab))


def ratios(words, t, b, prior, c):
    top = lambda x: {words[i] for i in np.argsort(-x, kind="stable")[:20] if x[i] > 0}
    chosen = (top(prior) & top(t) & top(b)) | set(L.STOPWORDS)
    at = np.isin(words, sorted(chosen))
    at = at if at.any() else np.ones(len(words), bool)
    return c * prior[at].sum() / max(1, t[at].sum()), c * prior[at].sum() / max(1, b[at].sum())


@pytest.mark.parametrize("seed", [0, 1])
def test_strongest_constant_equals_plain_bisection(spark, seed):
    words, t, b, prior = vocabulary(seed)
    register = set(L.STOPWORDS) | {"i'm", "don't", "w7"}
    at = np.isin(words, sorted(register))

    def clean(c):
        rt, rb = ratios(words, t, b, prior, c)
        return np.abs(log_odds(t, b, prior / rt, prior / rb)[at]).max() < 1.96

    low, high = 0.005, 1.0
    want = low if not clean(low) else high if clean(high) else None
    if want is None:
        for _ in range(24):
            mid = (low + high) / 2
            low, high = (mid, high) if clean(mid) else (low, mid)
        want = low
    df = spark.createDataFrame([(w, int(x), int(y), float(p)) for w, x, y, p in zip(words, t, b, prior)], "word string, y_t long, y_b long, prior double")
    got = L.strongest_clean_constant(df, spark.createDataFrame([(w,) for w in register], "word string")).first()["c"]
    assert got == pytest.approx(want, abs=1e-9)
    z = {r["word"]: r["z"] for r in L.constant_sweep(df, [got]).collect()}
    assert max(abs(z[w]) for w in register if w in z) < 1.96
    reference = spark.createDataFrame([(f"w{i}", 0.001 * i) for i in range(60)], "word string, freq double")
    found = {r["word"] for r in L.register_words(df, reference).collect()}
    assert found == set(L.STOPWORDS) | {"i'm", "don't"} | {f"w{i}" for i in range(20, 60)}


def test_ratios_without_calibration_words_take_the_vocabulary(spark):
    df = spark.createDataFrame([("x", 30, 0, 2.0), ("y", 0, 10, 3.0)], "word string, y_t long, y_b long, prior double")
    r = L.side_ratios(df, 0.5).first()
    assert (r["r_t"], r["r_b"]) == (pytest.approx(0.5 * 5 / 30), pytest.approx(0.5 * 5 / 10))


def packed(posts, most, least, units):
    chunks, held, seen = [], [], set()
    for post in posts:
        words = post.split()
        if not words or " ".join(words) in seen or any(m in post.lower() for m in etl.BOILERPLATE):
            continue
        seen.add(" ".join(words))
        if len(words) > most:
            chunks += [held] if len(held) >= least else []
            chunks, held = [*chunks, words[:most]], []
        elif len(held) + len(words) > most:
            chunks, held = chunks + ([held] if len(held) >= least else []), words
        else:
            held = held + words
    chunks += [held] if len(held) >= least else []
    return [" ".join(c) for c in chunks[:units]]


@pytest.mark.parametrize("units", [None, 2])
def test_greedy_pack_equals_plain_python(spark, units):
    rng = random.Random(3)
    posts = {f"a{k}": [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 5, 12, 30, 70]))) for _ in range(14)] for k in range(6)}
    posts["a0"] += ["This comment has been removed by us " * 3, posts["a0"][2], "", None]
    rows = [(a, i, p) for a, ps in posts.items() for i, p in enumerate(ps)]
    got = {}
    for r in etl.greedy_pack(spark.createDataFrame(rows, "author_id string, place int, text string"), 40, 8, units).orderBy("author_id", "chunk").collect():
        got.setdefault(r["author_id"], []).append(r["text"])
    assert got == {a: c for a, ps in posts.items() if (c := packed([p or "" for p in ps], 40, 8, units))}
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "author_id string, chunk int")
    assert {r["author_id"] for r in etl.eligible_authors(df, 2).collect()} == {"a"}


def test_greedy_pack_of_one_author_over_many_blocks(spark, monkeypatch):
    """Blocks of 40 to 50 posts, composed by doubling, make the chunks that one pass makes."""
    rng = random.Random(8)
    posts = {a: [f"p{i} " + " ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 0, 1, 4, 11, 38, 39, 40, 60]))) for i in range(n)] for a, n in (("big", 3000), ("edge", 150), ("small", 7), ("one", 1))}
    df = spark.createDataFrame([(a, i, p) for a, ps in posts.items() for i, p in enumerate(ps)], "author_id string, place int, text string").repartition(7)
    want = {a: packed(ps, 40, 8, None) for a, ps in posts.items()}
    for block in (40, 50, 4096):
        monkeypatch.setattr(etl, "BLOCK", block)
        got = {}
        for r in sorted(etl.greedy_pack(df, 40, 8).collect(), key=lambda r: r["chunk"]):
            got.setdefault(r["author_id"], []).append(r["text"])
        assert got == {a: c for a, c in want.items() if c}
    assert etl.greedy_pack(df.limit(0)).count() == 0


def test_cleaning(spark):
    df = spark.createDataFrame([("a \\u00e9 b\\\\n c & amp ; d &lt;",), (None,)], "t string")
    assert [r[0] for r in df.select(etl.cleaned_post(F.col("t"))).collect()] == ["a b c & d <", ""]
    tweets = ["RT @x hello there my good friends", "see https://a.b/c @you", "this is a fine tweet  about\n nothing @me", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tweets], "t string").select(etl.cleaned_tweet(F.col("t"))).collect()]
    assert got == ["", "", "this is a fine tweet about nothing @me", ""]
    one = spark.createDataFrame([("Every week",), ("never",)], "v string").select(etl.mapped(F.col("v"), etl.FREQUENCIES, 0)).collect()
    assert [r[0] for r in one] == [4, 0]


def test_hash_rank_is_one_order(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(500)], "k string")
    rows = P.hash_rank(df, 9, "k", "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 501))
    assert [r["k"] for r in rows] == sorted((f"k{i}" for i in range(500)), key=lambda k: hashlib.md5(f"9:{k}".encode()).hexdigest())
