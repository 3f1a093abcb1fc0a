"""Quality rules: base rules and robust multivariate outliers (minimum covariance determinant).

Only DataFrame and SQL functions: one pass over the texts makes a narrow table
of statistics; the estimator then works on that table alone. Each concentration
step is one aggregation by (group, distance bin), so that no group's rows ever
meet in one task; all sums are of integers, hence the same in any order.

Defined cases
- null text: no words; base_failed, not kept. Empty and blank texts likewise.
- null lang or source: a group of its own, like any other value.
- groups of fewer than ``MIN_GROUP`` rows that pass the base rules take the
  estimate of their language, or else of all documents: of all rows that pass,
  those of large groups too.
- equal rows: each is judged alone, alike. Extra columns are ignored.
- empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Query, join_small, materialise, read

WHITESPACE = "\t\n\x0b\x0c\r"
#: Fewest rows for an estimate of a group's own.
MIN_GROUP = 60
#: Share of a group's rows on which the determinant is minimised.
SUBSET = 0.75
C_STEPS = 4
#: Makes the covariance of the nearest 75 % of four-dimensional normal rows consistent.
CONSISTENCY = 1.4853
#: Fixed-point units of a statistic.
SCALE = 1000
#: Standard deviation, in statistic units, added to each axis: no axis is ever flat.
FLOORS = (0.06, 0.05, 0.15, 0.15)
#: Squared distance beyond which a row is an outlier. The statistics have
#: heavier tails than a normal law, so this is far above its 0.999 quantile (18.5).
CUTOFF = 30.0
BINS, BINS_PER_UNIT = 2047, 32
#: Bits of a window's hash, less those that its place takes.
HASH_BITS = 64
DIMS = range(len(FLOORS))


def base_statistics(docs: DataFrame) -> DataFrame:
    """The rows of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _n_lines and base_failed.

    docs must have none of these columns, nor helpers of the names dropped at the end.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = text
    for c in WHITESPACE:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    out = docs.withColumn("_flat", flat).withColumn("_w", F.array_remove(F.split("_flat", " "), ""))
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.replace(F.col("_flat"), F.lit(" "), F.lit(""))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_lines": F.expr(r"filter(split(coalesce(text, ''), '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        }
    )
    # A window's hash and, in the low bits, its place: sorting brings equal windows
    # together. Windows beside each other with equal hashes have their words compared; should
    # they differ anywhere in a text, its windows are sorted by their words instead.
    out = out.withColumn("_b", F.greatest(F.length(F.bin(F.col("n_words"))), F.lit(64 - HASH_BITS)))
    word = lambda at, k: f"_w[cast({at} + {k} as int)]"
    three = lambda at: ", ".join(word(at, k) for k in range(3))
    place = lambda x: f"({x} & (shiftleft(1L, _b) - 1L))"
    out = out.withColumn("_h", F.expr(f"CASE WHEN n_words < 4 THEN array(0L) ELSE transform(sequence(0L, n_words - 3L), i -> shiftleft(xxhash64({three('i')}), _b) | i) END")).withColumn("_s", F.expr("sort_array(_h)"))
    same = lambda x, y: f"shiftrightunsigned({x}, _b) = shiftrightunsigned({y}, _b)"
    out = out.withColumn("_p", F.expr(f"filter(_s, (x, i) -> {same('x', 'get(_s, i - 1)')} OR {same('x', 'get(_s, i + 1)')})"))
    differ = " OR ".join(f"{word(place('x'), k)} <> {word(place('get(_p, i - 1)'), k)}" for k in range(3))
    out = out.withColumn("_mixed", F.expr(f"exists(transform(_p, (x, i) -> i > 0 AND {same('x', 'get(_p, i - 1)')} AND ({differ})), x -> x)"))
    by_words = f"array_sort(transform(sequence(0L, n_words - 3L), i -> struct(concat_ws(' ', {three('i')}) AS s, i AS p)))"
    repeated = "filter(_o, (x, i) -> x.s = get(_o, i - 1).s OR x.s = get(_o, i + 1).s)"
    out = out.withColumn("_o", F.expr(f"CASE WHEN _mixed THEN {by_words} END"))
    out = out.withColumn("_p", F.expr(f"sort_array(CASE WHEN _mixed THEN transform({repeated}, x -> x.p) ELSE transform(_p, x -> {place('x')}) END)"))
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr("aggregate(transform(_p, (x, i) -> least(3L, coalesce(get(_p, i + 1) - x, 3L))), 0L, (a, v) -> a + v)"),
            "_n_lines": F.size("_lines"),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("_flat", "_w", "_lines", "_b", "_h", "_s", "_p", "_mixed", "_o")


def statistic_vector() -> list[Column]:
    """Four transformed statistics, in fixed-point units: log mean word length and three stabilised shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda k, of: F.asin(F.sqrt(F.least(F.lit(1.0), k / of)))
    raw = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        share(F.col("n_symbols"), F.greatest(F.col("word_chars"), F.lit(1))),
        share(F.col("n_dup_lines"), F.greatest(F.col("_n_lines"), F.lit(1))),
        share(F.col("n_repeat_words"), n),
    ]
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _with_group(stats: DataFrame) -> tuple[DataFrame, int]:
    """Adds _ls and _l (language and source, language) and _g, the finest level whose estimate holds for a row; returns the most groups there can be."""
    # the first letter keeps a language apart from its null source, of which JSON says nothing
    named = stats.withColumns({"_l": F.concat(F.lit("l"), F.to_json(F.struct("lang"))), "_ls": F.concat(F.lit("s"), F.to_json(F.struct("lang", "source")))})
    counts = materialise(named.filter(~F.col("base_failed")).groupBy("_l", "_ls").agg(F.count("*").alias("_n")), "quality-groups")
    n = counts.count()
    counts = counts.withColumn("_n_l", F.sum("_n").over(Window.partitionBy("_l")))
    group = F.when(F.col("_n") >= MIN_GROUP, F.col("_ls")).when(F.col("_n_l") >= MIN_GROUP, F.col("_l")).otherwise("*")
    keys = counts.select("_ls", group.alias("_g"))
    return join_small(named, keys, "_ls", n, "left").withColumn("_g", F.coalesce("_g", F.lit("*"))), 2 * n + 1


def _start(good: DataFrame) -> DataFrame:
    """Per group the median and the interquartile spread of each axis, as a mean and a Cholesky factor."""
    long = good.select("_g", F.posexplode(F.array(*(f"x{i}" for i in DIMS))).alias("d", "x")).groupBy("_g", "d", "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy("_g", "d")
    cum = long.withColumns({"c": F.sum("n").over(w.orderBy("x")), "t": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("c") >= F.lit(q) * F.col("t"), F.col("x")))
    q = cum.groupBy("_g", "d").agg(*(at(v).alias(k) for k, v in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
    pick = lambda c, i: F.max(F.when(F.col("d") == i, F.col(c)))
    wide = q.groupBy("_g").agg(*(pick("q2", i).cast("double").alias(f"m{i}") for i in DIMS), *(((pick("q3", i) - pick("q1", i)) / 1.349).alias(f"s{i}") for i in DIMS))
    chol = [(F.sqrt(F.col(f"s{i}") ** 2 + (FLOORS[i] * SCALE) ** 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in DIMS for j in range(i + 1)]
    return wide.select("_g", *(f"m{i}" for i in DIMS), *chol)


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor c."""
    y: list[Column] = []
    for i in DIMS:
        left = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"c{i}{j}") * y[j]
        y.append(left / F.col(f"c{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factor(moments: DataFrame) -> DataFrame:
    """Means and the Cholesky factor of the floored, consistent covariance from integer moments."""
    out = moments.select("_g", *((F.col(f"a{i}") / F.col("n")).alias(f"m{i}") for i in DIMS), *(f"b{i}{j}" for i in DIMS for j in range(i + 1)), "n")
    for i in DIMS:
        for j in range(i + 1):
            left = CONSISTENCY * (F.col(f"b{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (F.lit((FLOORS[i] * SCALE) ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                left = left - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            # the floor keeps each pivot positive; greatest() guards rounding alone
            out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-6))) if i == j else left / F.col(f"c{j}{j}"))
    return out.select("_g", *(f"m{i}" for i in DIMS), *(f"c{i}{j}" for i in DIMS for j in range(i + 1)))


def _concentrate(good: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """One C-step: estimates from the SUBSET of each group nearest to the present estimates."""
    near = join_small(good, params, "_g", groups).withColumn("_bin", F.least(F.lit(BINS), F.floor(F.sqrt(_distance()) * BINS_PER_UNIT)).cast("int"))
    sums = [F.sum(f"x{i}").alias(f"a{i}") for i in DIMS] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}{j}") for i in DIMS for j in range(i + 1)]
    bins = near.groupBy("_g", "_bin").agg(F.count("*").alias("n"), *sums)
    w = Window.partitionBy("_g")
    bins = bins.withColumns({"c": F.sum("n").over(w.orderBy("_bin")), "t": F.sum("n").over(w)})
    inside = bins.filter(F.col("c") - F.col("n") < F.lit(SUBSET) * F.col("t"))
    names = ["n", *(f"a{i}" for i in DIMS), *(f"b{i}{j}" for i in DIMS for j in range(i + 1))]
    return _factor(inside.groupBy("_g").agg(*(F.sum(c).alias(c) for c in names)))


def estimates(good: DataFrame, groups: int) -> DataFrame:
    """Minimum-covariance-determinant estimates: one row per group _g."""
    params = _start(good)
    for _ in range(C_STEPS):
        params = _concentrate(good, params, groups)
    return params


def quality_verdicts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with its statistics, base_failed, distance2 and kept."""
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), "text", "lang", "source")
    stats = base_statistics(own).select(*(f"_k{i}" for i in range(len(keep))), "lang", "source", *base, *statistic_vector())
    stats = materialise(stats, "quality-stats")
    rows, groups = _with_group(stats)
    # a language's estimate and that of all documents are fitted on all their rows, not on those that need it alone
    levels = F.explode(F.array("_ls", "_l", F.lit("*"))).alias("_g")
    params = estimates(rows.filter(~F.col("base_failed")).select(levels, *(f"x{i}" for i in DIMS)), groups)
    # rows of a group with no estimate (none passed the base rules) have failed anyway
    out = join_small(rows, params, "_g", groups, "left").withColumn("distance2", _distance())
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(False)))
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *base, "kept", "distance2")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, all columns. Rows are matched by id and text, so equal rows share a verdict."""
    key = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), F.xxhash64("lang", "source").alias("_ls")]
    tagged = docs.select("doc_id", "text", "lang", "source", *key)
    verdicts = quality_verdicts(tagged, keep=("_id", "_t", "_ls")).filter("kept").select("_id", "_t", "_ls").distinct()
    on = docs["doc_id"].eqNullSafe(verdicts["_id"]) & (F.xxhash64(docs["text"]) == verdicts["_t"]) & (F.xxhash64(docs["lang"], docs["source"]) == verdicts["_ls"])
    return docs.join(verdicts, on, "left_semi")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents")).withColumn("distance2", F.round("distance2", 4))


def _sql() -> str:
    """The whole operator for DuckDB: base statistics, robust start, concentration steps, verdicts."""
    xs = ", ".join(f"x{i}" for i in DIMS)
    pairs = [(i, j) for i in DIMS for j in range(i + 1)]
    y = []
    for i in DIMS:
        left = f"x{i} - m{i}" + "".join(f" - c{i}{j} * y{j}" for j in range(i))
        y.append(f"({left}) / c{i}{i} AS y{i}")
    distance = ", ".join(y) + ", " + " + ".join(f"y{i} * y{i}" for i in DIMS) + " AS d2"
    start = ", ".join(f"max(q2) FILTER (dim = {i}) AS m{i}" for i in DIMS) + ", " + ", ".join(
        f"sqrt(pow((max(q3) FILTER (dim = {i}) - max(q1) FILTER (dim = {i})) / 1.349::DOUBLE, 2) + {(FLOORS[i] * SCALE) ** 2}::DOUBLE) AS c{i}{j}" if i == j else f"0::DOUBLE AS c{i}{j}" for i, j in pairs
    )
    share = lambda k, of: f"round(asin(sqrt(least(1, {k} / {of}))) * {SCALE})"
    factor = [f"a{i} / n AS m{i}" for i in DIMS]
    for i, j in pairs:
        left = f"{CONSISTENCY}::DOUBLE * (b{i}{j} / n - (a{i} / n) * (a{j} / n)) + {(FLOORS[i] * SCALE) ** 2 if i == j else 0}::DOUBLE" + "".join(f" - c{i}{k} * c{j}{k}" for k in range(j))
        factor.append(f"sqrt(greatest({left}, 1e-6::DOUBLE)) AS c{i}{j}" if i == j else f"({left}) / c{j}{j} AS c{i}{j}")
    moments = [f"CAST(sum(x{i}) AS BIGINT) AS a{i}" for i in DIMS] + [f"CAST(sum(x{i} * x{j}) AS BIGINT) AS b{i}{j}" for i, j in pairs]
    again = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ["n", *(f"a{i}" for i in DIMS), *(f"b{i}{j}" for i, j in pairs)])
    steps = "".join(
        f"""
e{k} AS (SELECT good.g, {xs}, {distance} FROM good JOIN p{k - 1} USING (g)),
h{k} AS (SELECT g, CAST(least({BINS}, floor(sqrt(d2) * {BINS_PER_UNIT})) AS INT) AS bin, count(*) AS n, {", ".join(moments)} FROM e{k} GROUP BY ALL),
i{k} AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY g) AS tot FROM h{k}),
s{k} AS (SELECT g, {again} FROM i{k} WHERE cum - n < {SUBSET} * tot GROUP BY g),
p{k} AS (SELECT g, {", ".join(factor)} FROM s{k}),"""
        for k in range(1, C_STEPS + 1)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tri AS (SELECT r, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS s FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(3) AS x(k) GROUP BY r),
b0 AS (SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CAST(round(ln(greatest(word_chars, 1) / greatest(n_words, 1)) * {SCALE}) AS BIGINT) AS x0, CAST({share("n_symbols", "greatest(word_chars, 1)")} AS BIGINT) AS x1,
  CAST({share("n_dup_lines", "greatest(len(lines), 1)")} AS BIGINT) AS x2, CAST({share("n_repeat_words", "greatest(n_words, 1)")} AS BIGINT) AS x3 FROM b0),
gc AS (SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS nl FROM b WHERE NOT base_failed GROUP BY lang, source),
gn AS (SELECT *, concat('s', to_json({{'l': lang, 's': source}})) AS gs, concat('l', to_json({{'l': lang}})) AS gl FROM gc),
gk AS (SELECT lang, source, gs, gl, CASE WHEN n >= {MIN_GROUP} THEN gs WHEN nl >= {MIN_GROUP} THEN gl ELSE '*' END AS g FROM gn),
rows_ AS (SELECT b.*, gs, gl, coalesce(g, '*') AS g FROM b LEFT JOIN gk ON b.lang IS NOT DISTINCT FROM gk.lang AND b.source IS NOT DISTINCT FROM gk.source),
good AS (SELECT unnest([gs, gl, '*']) AS g, {xs} FROM rows_ WHERE NOT base_failed),
lg AS ({" UNION ALL ".join(f"SELECT g, {i} AS dim, x{i} AS x, count(*) AS n FROM good GROUP BY ALL" for i in DIMS)}),
lc AS (SELECT *, sum(n) OVER (PARTITION BY g, dim ORDER BY x) AS c, sum(n) OVER (PARTITION BY g, dim) AS tt FROM lg),
q AS (SELECT g, dim, min(x) FILTER (c >= 0.25 * tt) AS q1, min(x) FILTER (c >= 0.5 * tt) AS q2, min(x) FILTER (c >= 0.75 * tt) AS q3 FROM lc GROUP BY g, dim),
p0 AS (SELECT g, {start} FROM q GROUP BY g),{steps}
f AS (SELECT rows_.*, {distance} FROM rows_ LEFT JOIN p{C_STEPS} USING (g))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {CUTOFF}, false) AS kept, round(d2, 4) AS distance2 FROM f"""


QUERIES: dict[str, Query] = {"op10_quality_rules": op10_quality_rules}
ORACLE: dict[str, str] = {"op10_quality_rules": _sql()}
