"""What several steps read is computed once."""

from cohortlens.operators import etl
from cohortlens.operators import lexical as L


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tweets_are_cleaned_before_they_are_returned(spark):
    rows = [(f"a{i % 3}", "target", f"one two three four five six seven {i // 6}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "author_id string, cohort string, text string, extra int")
    out = etl.tweet_cohort(df, 3, 2)
    assert out.columns == df.columns and out.count() == 6 and out.select("author_id", "text").distinct().count() == 6
    assert "regexp_replace" not in plan(etl.with_null_split(out))


def test_null_scores_are_written_before_they_are_ranked(spark):
    scored = spark.range(100).selectExpr("'m' AS mode", "cast(id % 4 as int) AS perm", "concat('w', id) AS word", "sqrt(id) AS z")
    out = L.qq_points(scored)
    assert [r["z"] for r in out.orderBy("place").collect()] == [i**0.5 for i in range(100)]
    assert "Range (" not in plan(out) and "parquet" in plan(out)
