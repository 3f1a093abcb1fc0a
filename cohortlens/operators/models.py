"""A classifier of behaviour and a projection, by Spark's own models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.information import wilson
from .sampling import hashed


def c2st_behavior(features: DataFrame, label: str, columns: list[str], test: float = 0.3, seed: int = 0) -> DataFrame:
    """Accuracy on one split by hash rank within each label, its Wilson interval, and whether it is above the majority rate.

    Rows with an empty feature are left out and counted (n_dropped). Under ten rows, or of one label only: nulls.
    The fit is Spark's own logistic regression, so rows never leave the cluster. Rows are not ranked: they are
    counted by label, features and the first digits of their hash, equal ones are a row with a weight in the fit,
    and only those whose digits are the split's own are ordered.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    spark = features.sparkSession
    given = features.select("response_id", (F.col(label) == "target").cast("double").alias("label"), *columns).withColumn("_h", hashed(seed, "response_id")).withColumn("_p", F.substring("_h", 1, 3))
    groups = given.groupBy("label", *columns, "_p").agg(F.count(F.lit(1)).alias("w")).persist()
    try:
        whole = groups.dropna(subset=[*columns, "label"])
        parts = whole.groupBy("label", "_p").agg(F.sum("w").alias("n")).orderBy("label", "_p").collect()  # a row a label and three digits
        sizes = {v: sum(r["n"] for r in parts if r["label"] == v) for v in sorted({r["label"] for r in parts})}
        n = sum(sizes.values())
        dropped = (groups.agg(F.sum("w").alias("n")).first()["n"] or 0) - n
        if len(sizes) < 2 or n < 10:
            row = [(dropped, n, None, None, None, None, None)]
            return spark.createDataFrame(row, "n_dropped long, n long, accuracy double, low double, high double, majority double, above_chance boolean")
        cuts = []
        for v, size in sizes.items():
            rest = max(1, round(test * size))
            for r in (r for r in parts if r["label"] == v):
                if rest <= r["n"]:
                    cuts.append((v, r["_p"], rest))
                    break
                rest -= r["n"]
        at = spark.createDataFrame(cuts, "label double, _cut string, _rest long")  # a row a label
        # the condition on the hash alone comes first, so that other rows are left out where they are read
        split = given.filter(F.col("_p").isin(*(c[1] for c in cuts))).dropna(subset=[*columns, "label"]).join(F.broadcast(at), "label").filter("_p = _cut")
        place = F.row_number().over(Window.partitionBy("label").orderBy("_h", "response_id"))
        split = split.withColumn("_test", place <= F.col("_rest")).groupBy("label", *columns, "_test").agg(F.count(F.lit(1)).alias("w"))
        clear = whole.join(F.broadcast(at), "label").filter("_p <> _cut").withColumn("_test", F.col("_p") < F.col("_cut"))
        rows = clear.select("label", *columns, "_test", "w").unionByName(split).groupBy("label", *columns, "_test").agg(F.sum("w").alias("w"))
        rows = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select("features", "label", "_test", F.col("w").cast("double").alias("w")).persist()
        try:
            trained = n - sum(max(1, round(test * size)) for size in sizes.values())
            train = rows.filter(~F.col("_test"))
            model = LogisticRegression(regParam=1 / max(trained, 1), elasticNetParam=0.0, standardization=False, weightCol="w").fit(train)
            hit = F.sum(F.when(F.col("prediction") == F.col("label"), F.col("w")).otherwise(0.0))
            k, m, ones = model.transform(rows.filter("_test")).agg(hit, F.sum("w"), F.sum(F.col("label") * F.col("w"))).first()
        finally:
            rows.unpersist()
    finally:
        groups.unpersist()
    out = spark.createDataFrame([(dropped, int(k), int(m), ones / m)], "n_dropped long, k long, n long, share double")
    low, high = wilson(F.col("k"), F.col("n"))
    majority = F.greatest(F.col("share"), 1 - F.col("share"))
    return out.select("n_dropped", "n", (F.col("k") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"), majority.alias("majority"), (low > majority).alias("above_chance"))


def pca2d(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """Joint projection on two principal components (their signs are arbitrary)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, "side", array_to_vector("v").alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="c").fit(rows).transform(rows)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    out = model.transform(centred).withColumn("p", vector_to_array("p"))
    share = model.explainedVariance.toArray().tolist()
    return out.select(key, "side", F.col("p")[0].alias("pc1"), F.col("p")[1].alias("pc2"), F.lit(share[0]).alias("share1"), F.lit(share[1]).alias("share2"))
