"""Votes are counted where an order's responses lie: nothing is spread out by axis or judge before it is exchanged."""

import re

import numpy as np
import pytest
from cohortlens.operators import models, permutation
from cohortlens.plans import models as models_plans
from cohortlens.plans import relational, treatment
from cohortlens.sources import views
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def exchanged_by(df):
    """What rows are dealt by, in the plan before it runs."""
    return re.findall(r"Exchange hashpartitioning\(([^#]+)#", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["aggregate_scored", "c2st_features", "panel_vote", "kappa_to_axis", "fleiss_kappa", "cohen_kappa", "verdict_pairs", "flip_rate"])
def test_responses_are_exchanged_by_order_alone(spark, name):
    by = exchanged_by(treatment.QUERIES[name](spark, DATA))
    assert "response_id" not in by and "prompt_id" not in by


def test_units_are_exchanged_by_order_alone(spark):
    assert "prompt_id" not in exchanged_by(views.unit_counts(spark, DATA))


def test_repeated_responses_are_counted_as_sql_does(spark, monkeypatch):
    """Two rows of one id, one readable only: each row of the first judge meets each readable verdict of another."""
    li = views.table(spark, DATA, "lineitem").filter("l_linenumber = 1").limit(1).persist()
    twice = li.union(li.withColumn("l_linestatus", F.lit(None).cast("string")))
    real = views.table
    monkeypatch.setattr(views, "table", lambda s, d, t: twice if t == "lineitem" else real(s, d, t))
    rows = {r["axis_id"]: r for r in views.ballots(spark, DATA).collect()}
    assert {r["n"] for r in rows.values()} == {2}
    assert rows["shipped"]["yes_j0"] + rows["shipped"]["no_j0"] == 1 and rows["taxed"]["yes_j0"] + rows["taxed"]["no_j0"] == 2
    flips = {(r["judge"], r["axis_id"]): r["n"] for r in treatment.flip_rate(spark, DATA).collect()}
    assert flips["j1", "shipped"] == 2 and flips["j1", "taxed"] == 4
    assert models_plans.treatment.behaviour(spark, DATA).count() == 1


def test_behaviour_classifier_ranks_only_rows_at_the_split(spark):
    """The split is that of a rank over all rows; equal rows are one with a weight."""
    rows = [(f"r{i}", "target" if i % 3 else "baseline", float(i % 3 > 0) if i % 5 else 0.5, float(i % 2)) for i in range(900)]
    df = spark.createDataFrame([*rows, ("x", "target", None, 1.0)], "response_id string, community string, a double, b double")
    got = models.c2st_behavior(df, "community", ["a", "b"]).first()
    rank = F.expr("row_number() over (partition by community order by md5(concat('0:', response_id)), response_id)")
    test = df.dropna().withColumn("k", rank).filter("k <= case community when 'target' then 180 else 90 end")
    # both sides of an unknown a are guessed as the larger side
    want = test.filter("a = cast(community = 'target' as int) or (a = 0.5 and community = 'target')").count() / 270
    assert (got["n_dropped"], got["n"], got["accuracy"]) == (1, 270, pytest.approx(want))


def test_few_integer_keys_are_made(monkeypatch):
    """Nearly all units of a permutation are decided by shares; one pass counts, one adds up."""
    made, key = [], permutation._key

    def counted(x, y, coef):
        made.append(len(x))
        return key(x, y, coef)

    monkeypatch.setattr(permutation, "_key", counted)
    rng = np.random.default_rng(1)
    n, coef = 20_000, permutation.coefficients(3, 50)
    x, y = rng.integers(0, permutation.PRIME, n), rng.integers(0, permutation.PRIME, n)
    low, high = np.full(50, permutation.PRIME // 3), np.full(50, permutation.PRIME // 3 + 10**6)
    want = permutation.keys(x, y, coef)
    made.clear()
    for units, perms, below, i, j, k in permutation._decided(x, y, coef, low, high):
        part = want[units, perms]
        assert (below == (part < low[perms])).all()
        assert sorted(k.tolist()) == sorted(part[(part >= low[perms]) & (part < high[perms])].tolist())
    assert sum(made) < n * 50 // 100


def test_rejudged_rows_are_counted_not_joined(spark, monkeypatch):
    """As the join of both judges' rows, also where an id is repeated, or one of its rows is unreadable; nothing is exchanged by id."""
    li = views.table(spark, DATA, "lineitem").limit(200).persist()
    more = li.union(li.withColumn("l_linestatus", F.lit(None).cast("string"))).union(li.limit(20))
    real = views.table
    monkeypatch.setattr(views, "table", lambda s, d, t: more if t == "lineitem" else real(s, d, t))
    v = views.verdicts(spark, DATA)
    again = v.filter("judge = 'j2' AND verdict IS NOT NULL").select("response_id", "axis_id", F.col("verdict").alias("again"))
    rows = v.filter("judge = 'j0'").join(again, ["response_id", "axis_id"])
    want = rows.groupBy("axis_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == F.col("again")).alias("equal"))
    got = relational.rejudge_join(spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "response_id" not in exchanged_by(got)
