"""Relational operators: slices, checks, joins, shares, top-k and merges of tidy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (model prefix, US dollars per million input tokens, per million output tokens); the first that fits holds.
PRICES = (
    ("mock:", 0.0, 0.0),
    ("claude-opus", 15.0, 75.0),
    ("claude-sonnet", 3.0, 15.0),
    ("claude-haiku", 1.0, 5.0),
    ("claude-3-5-haiku", 0.8, 4.0),
    ("gpt-5-nano", 0.05, 0.4),
    ("gpt-5-mini", 0.25, 2.0),
    ("gpt-5", 1.25, 10.0),
    ("gpt-4o-mini", 0.15, 0.6),
    ("gpt-4o", 2.5, 10.0),
    ("gpt-4.1-mini", 0.4, 1.6),
    ("gpt-4.1", 2.0, 8.0),
    ("o3", 2.0, 8.0),
    ("o4-mini", 1.1, 4.4),
    ("gemini-3.5-flash", 0.3, 2.5),
    ("gemini-3.1-flash-lite", 0.1, 0.4),
    ("gemini-3-flash", 0.3, 2.5),
    ("gemini-2.5-flash-lite", 0.1, 0.4),
    ("gemini-2.5-flash", 0.3, 2.5),
    ("gemini-2.5-pro", 1.25, 10.0),
    ("gemini-2.0-flash", 0.1, 0.4),
)
#: Prefixes of a model's name that say who serves it; prices are by what follows.
PROVIDERS = ("anthropic", "openai", "google")
UNRECORDED = ("", "0")


def dataset_problems(prompts: DataFrame, authors: DataFrame, cohorts: tuple[str, ...] = ("target", "baseline")) -> DataFrame:
    """(problem, n): keys, known cohorts, prompts without an author, empty texts."""
    twice = prompts.groupBy("prompt_id").count().filter("count > 1")
    orphans = prompts.join(authors, ["cohort", "author_id"], "left_anti")
    unknown = prompts.filter(~F.col("cohort").isin(*cohorts))
    empty = prompts.filter(F.trim(F.coalesce("text", F.lit(""))) == "")
    return _counts([("duplicate prompt_id", twice), ("unknown cohort", unknown), ("prompt without author", orphans), ("empty text", empty)])


def _counts(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n") for name, df in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def cohort_slice(prompts: DataFrame, authors: DataFrame, cohort: str, author_mask: Column | None = None, prompt_mask: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One side of a comparison: its prompts and the authors that still have one. The key is (cohort, author_id)."""
    a = authors.filter(F.col("cohort") == cohort)
    a = a if author_mask is None else a.filter(author_mask)
    p = prompts.filter(F.col("cohort") == cohort)
    p = p if prompt_mask is None else p.filter(prompt_mask)
    p = p.join(a, ["cohort", "author_id"], "left_semi")
    return p, a.join(p, ["cohort", "author_id"], "left_semi")


def first_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, prompt (the first user turn) and reply (the assistant turn after it, if any)."""
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("u")).select("conv_id", "u.turn", F.col("u.text").alias("prompt"))
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return first.join(replies, ["conv_id", "turn"], "left")


def first_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def seed_hex(*parts) -> Column:
    """Eight hex digits that depend on the parts alone."""
    sep = F.lit("\x1f")
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = [x for c in cols for x in (sep, c)][1:]
    return F.substring(F.md5(F.concat(*joined)), 1, 8)


def slice_mask(column: str, op: str, value: str) -> Column:
    """eq, in, not_in over a text column ("*" stands for an unrecorded answer); contains, not_contains over a
    multi-select by whole element, contains_text by substring. not_contains needs a recorded answer."""
    c = F.col(column)
    values = [v for item in value.split(",") for v in (UNRECORDED if item == "*" else (item.strip(),))]
    if op == "eq":
        return c == value
    if op == "in":
        return c.isin(*values)
    if op == "not_in":
        return ~c.isin(*values)
    lowered = F.transform(c, lambda x: F.lower(F.trim(x)))
    if op == "contains":
        return F.array_contains(lowered, value.lower())
    if op == "contains_text":
        return F.exists(lowered, lambda x: F.contains(x, F.lit(value.lower())))
    if op == "not_contains":
        return (F.size(c) > 0) & ~F.array_contains(lowered, value.lower())
    raise ValueError(f"unknown slice operation {op!r}")


def stratum_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(F.col(column).cast("string")).alias("value")).distinct().filter(~F.col("value").isin("", "0", "nan"))


def foreign_keys(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(problem, n): rows whose key the other table lacks."""
    return _counts([(name, a.select(F.col(k).alias("k")).join(b.select(F.col(m).alias("k")), "k", "left_anti")) for name, a, k, b, m in checks])


def jaccard_pairs(df: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """Pairs of token sets with Jaccard at least the threshold, found by prefix filtering.

    With tokens in order of rarity, two such sets share one of their first
    size - ceil(threshold * size) + 1 tokens; only sets that do are compared.
    """
    long = df.select(key, F.explode(tokens).alias("t"))
    rare = long.join(long.groupBy("t").agg(F.count(F.lit(1)).alias("f")), "t")
    sets = rare.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s"))
    sets = sets.select(key, F.transform("s", lambda x: x["t"]).alias("s"))
    size = F.size("s")
    prefix = sets.select(key, "s", F.explode(F.slice("s", F.lit(1), (size - F.ceil(size * threshold) + 1).cast("int"))).alias("t"))
    a = prefix.select(F.col(key).alias("a"), F.col("s").alias("sa"), "t")
    b = prefix.select(F.col(key).alias("b"), F.col("s").alias("sb"), "t")
    close = (F.size("sb") >= F.size("sa") * threshold) & (F.size("sa") >= F.size("sb") * threshold)
    pairs = a.join(b, "t").filter((F.col("a") < F.col("b")) & close).dropDuplicates(["a", "b"])
    both = F.size(F.array_intersect("sa", "sb"))
    jaccard = both / (F.size("sa") + F.size("sb") - both)
    return pairs.withColumn("j", jaccard).filter(F.col("j") >= threshold).select("a", "b", F.round("j", 6).alias("jaccard"))


def set_overlap(sets: DataFrame, key: str, members: str) -> DataFrame:
    """Jaccard of every pair of a few named sets, by counts over their members."""
    long = sets.select(key, F.explode(members).alias("m"))
    size = long.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    a, b = long.select(F.col(key).alias("a"), "m"), long.select(F.col(key).alias("b"), "m")
    common = a.join(b, "m").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    names = size.select(F.col(key).alias("a"), F.col("n").alias("na")).join(size.select(F.col(key).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    out = names.join(common, ["a", "b"], "left").fillna(0, ["c"])
    return out.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


def _centroids(vectors: DataFrame, group: str) -> DataFrame:
    long = vectors.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(group, F.transform("s", lambda z: z["x"]).alias("c"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def closest_centroids(vectors: DataFrame, group: str, n: int, done: list[tuple] = ()) -> DataFrame:
    """The n closest pairs of group centroids not yet done. A row a group, so its pairs are few."""
    c = _centroids(vectors, group)
    a, b = c.select(F.col(group).alias("a"), F.col("c").alias("ca")), c.select(F.col(group).alias("b"), F.col("c").alias("cb"))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("cosine", cosine("ca", "cb"))
    for x, y in done:
        pairs = pairs.filter(~((F.col("a") == x) & (F.col("b") == y)))
    return pairs.orderBy(F.desc("cosine"), "a", "b").limit(n).select("a", "b", F.round("cosine", 6).alias("cosine"))


def nearest_centroid(vectors: DataFrame, key: str, group: str) -> DataFrame:
    """Each vector's closest catalog entry; the catalog has a row a group and travels as one array."""
    catalog = _centroids(vectors, group).agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "c"))).alias("catalog"))
    rows = vectors.crossJoin(F.broadcast(catalog))  # one row
    best = F.array_max(F.transform("catalog", lambda e: F.struct(F.round(cosine(F.col("v"), e["c"]), 9).alias("s"), (-e["g"]).alias("g"))))
    return rows.select(key, (-best["g"]).alias("nearest"))


def closed_shares(df: DataFrame, side: str, key: str, catalog: DataFrame) -> DataFrame:
    """Counts and shares per side over a closed catalog; absent entries are zero."""
    n = df.groupBy(key, side).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(side).agg(F.sum("n").alias("t"))
    grid = catalog.join(F.broadcast(total))  # a row a side
    out = grid.join(n, [key, side], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(key, side, "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def author_means(usage: DataFrame, by: list[str]) -> DataFrame:
    """Each author's mean of the recorded answers (above zero)."""
    return usage.filter("answer > 0").groupBy(*by, "author_id").agg(F.avg("answer").alias("value"))


def trace_rollup(trace: DataFrame) -> DataFrame:
    """Per role and model: calls, cached, errors, refused, tokens and the upper median of latency.

    The median is exact and needs no group's values in one place: counts by value, then a running sum.
    """
    by = ["role", "model"]
    sums = trace.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached"), F.count("error").alias("errors"), F.count_if("refused").alias("refused"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    counts = trace.groupBy(*by, "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    running = counts.withColumns({"c": F.sum("n").over(w.orderBy("latency_ms")), "t": F.sum("n").over(w)})
    median = running.filter("c >= t div 2 + 1").groupBy(*by).agg(F.min("latency_ms").alias("p50"))
    return sums.join(median, by)


def with_cost(usage: DataFrame) -> DataFrame:
    """Adds cost_usd by the first price whose prefix fits the model; zero for an unknown one."""
    served = F.split_part("model", F.lit(":"), F.lit(1)).isin(*PROVIDERS)
    bare = F.when(served, F.regexp_replace("model", "^[^:]*:", "")).otherwise(F.col("model"))
    fits = lambda i: F.coalesce(*(F.when(F.startswith(bare, F.lit(p[0])), F.lit(p[i])) for p in PRICES), F.lit(0.0))
    return usage.withColumn("cost_usd", (F.col("input_tokens") * fits(1) + F.col("output_tokens") * fits(2)) / 1e6)


def histogram(df: DataFrame, side: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by side over equal bins of [low, high]; the last bin is closed."""
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / (high - low) * bins)).cast("long")
    return df.groupBy(side, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key it lacks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def interleave(df: DataFrame, side: str, order: str) -> DataFrame:
    """Adds place: target and baseline rows take turns; the longer side's tail follows.

    The place is arithmetic from the row's rank within its side, so no order over all rows is needed.
    """
    sizes = {r[side]: r["n"] for r in df.groupBy(side).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    t, b = sizes.get("target", 0), sizes.get("baseline", 0)
    k = F.row_number().over(Window.partitionBy(side).orderBy(order))
    rows = df.withColumn("_k", k)
    other = F.when(F.col(side) == "target", F.least(F.col("_k") - 1, F.lit(b))).otherwise(F.least(F.col("_k"), F.lit(t)))
    return rows.withColumn("place", (F.col("_k") + other).cast("long")).drop("_k")


def run_problems(responses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(severity, message, n) of a run."""
    key = ["response_id"]
    twice = responses.groupBy(*key).count().filter("count > 1")
    orphan = verdicts.join(responses.select(*key), key, "left_anti")
    wrong = verdicts.join(responses.select("response_id", F.col("community").alias("c")), key).filter("community <> c")
    checks = [("problem", "repeated response", twice), ("problem", "verdict without response", orphan), ("problem", "community mismatch", wrong), ("warning", "unparsed verdict", verdicts.filter("verdict IS NULL")), ("warning", "refused", responses.filter("refused"))]
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("severity"), F.lit(m).alias("message"), "n") for s, m, df in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
