"""Ranks over parts, false discovery, the normal quantile and re-scored nulls, against plain Python."""

import statistics

import numpy as np
import pytest

from cohortlens.functions import information as I
from cohortlens.operators import lexical as L
from cohortlens.operators import permutation as P
from cohortlens.operators import ranking as K
from cohortlens.operators import statistics as S
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(v)) for g in ("a", "b", None) for i, v in enumerate(rng.choice([0.0, 0.01, 0.02, *rng.random(40)], 300))]
    rows += [("a", 1000 + i, 0.0) for i in range(900)]  # a hot value
    return rows, spark.createDataFrame(rows, "g string, i long, v double")


def test_places_and_midranks(table):
    rows, df = table
    got = {(r["g"], r["i"]): (r["place"], r["all_n"]) for r in K.places(df, "v", ["i"], ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        assert [got[g, r[1]] for r in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    ranks = {(r["g"], r["v"]): r["midrank"] for r in K.midranks(df, "v", ["g"]).collect()}
    for (g, v), rank in ranks.items():
        own = [r[2] for r in rows if r[0] == g]
        assert rank == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2
    assert K.places(df.limit(0), "v", ["i"]).count() == 0 and K.midranks(df.limit(0), "v").count() == 0
    assert sorted(r["place"] for r in K.places(df, "v", ["g", "i"]).collect()) == list(range(1, len(rows) + 1))


def test_no_task_ranks_a_whole_table(table):
    plan = K.places(table[1], "v", ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_part" in plan
    for line in plan.splitlines():  # windows over everything read a row a part alone
        assert "row_number() windowspecdefinition(v" not in line


def test_false_discovery_equals_the_axis_form(spark, table):
    df = table[1].withColumn("v", F.when(F.col("i") % 50 == 0, None).when(F.col("i") % 51 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    for by in ([], ["g"]):
        a = {(r["g"], r["i"]): (r["q_value"], r["significant"]) for r in S.benjamini_hochberg(df, "v", by=by, tie="i").collect()}
        b = {(r["g"], r["i"]): (r["q_value"], r["significant"]) for r in K.false_discovery(df, "v", by=by).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert K.false_discovery(df.limit(0), "v").count() == 0


def test_normal_quantiles(spark):
    ps = [1e-12, 1e-6, 0.001, 0.02424, 0.02426, 0.3, 0.5, 0.9, 0.97576, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [tuple(r) for r in df.select(I.normal_quantile(F.col("p")), F.expr(I.quantile_sql("p"))).collect()]
    for p, (a, b) in zip(ps, got):
        assert a == pytest.approx(statistics.NormalDist().inv_cdf(p), rel=1e-8, abs=1e-8) and b == pytest.approx(a)


def test_shuffled_counts_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{'t' if i % 3 == 0 else 'b'}{i % 12}", "target" if i % 3 == 0 else "baseline", " ".join(rng.choice(["the", "of", "tree", "it's", "rare"], 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "author_id string, cohort string, text string")
    units = df.select("author_id", "cohort").distinct()
    drawn = P.draws(units, "author_id", F.col("cohort") == "target", 7, 3)
    x, y = P.hashes(F.col("author_id"))
    found = units.select("author_id", x.alias("x"), y.alias("y")).collect()
    label = dict(zip([r["author_id"] for r in found], drawn.labels(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]), [r["author_id"] for r in found])))
    assert all(sum(v[p] for v in label.values()) == len({r[0] for r in rows if r[1] == "target"}) for p in range(7))
    want = {}
    for a, _, text in rows:
        for w in text.split():
            for p in range(7):
                t = want.setdefault((p, w), [0, 0])
                t[0 if label[a][p] else 1] += 1
    got = {(r["perm"], r["word"]): [r["y_t"], r["y_b"]] for r in L.shuffled_counts(df, 7, 3, 1).collect()}
    assert got == want
    with pytest.raises(ValueError):
        L.shuffled_counts(df, 63, 0)


def test_nulls_score_as_the_test_itself(spark):
    """The score of one permutation is that of ``marked_words`` and ``fixed_prior`` on its counts."""
    rng = np.random.default_rng(6)
    words = [*L.STOPWORDS[:9], *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(f"a{i % 20}", "target" if i % 20 < 9 else "baseline", " ".join(rng.choice(words, 30))) for i in range(80)]
    counts = L.shuffled_counts(spark.createDataFrame(rows, "author_id string, cohort string, text string"), 3, 5, 2)
    reference = spark.createDataFrame([("the", 0.06), ("of", 0.03), ("wa", 0.001)], "word string, freq double")
    got = {(r["mode"], r["perm"], r["word"]): r["z"] for r in L.rescored(counts, reference, 0.2, 0.5, 300.0, 0.4).collect()}
    for p in range(3):
        one = counts.filter(F.col("perm") == p).drop("perm")
        mixed = L.marked_words(L.mixed_prior(one, reference, 0.5), 0.2)
        fixed = L.log_odds(L.fixed_prior(one, 300.0, 0.4, reference), F.col("alpha"), F.col("alpha"))
        for mode, rows in (("mixed", mixed), ("fixed", fixed)):
            for r in rows.collect():
                assert got.pop((mode, p, r["word"])) == pytest.approx(r["z"], abs=1e-9)
    assert not got
