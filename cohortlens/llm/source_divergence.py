"""Source divergence audit: how far each source's use of words is from the other sources and from its language.

Within a language a kept term is a column of counts, one a source. Many terms have
equal columns, above all rare ones, so columns are grouped: terms of one sparse
source-count vector form a class, every pair of sources is evaluated once per class,
and the result is multiplied by the number of its terms. Terms are ranked through
their classes too: all terms of a class tie, so that only its first ``top`` by name
can be among the first ``top`` of any source.

A source's probability of a term is p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)),
with N its occurrences of kept terms and V the language's number of kept terms; the
divergence of two probabilities is floor((p - q)^2 / (p + q)). All of it is integer
arithmetic; products that may pass 64 bits are decimals.

Texts are counted in Arrow batches, each task adding up what it holds before one
exchange by (language, term). Classes are dealt to tasks by (language, lane), so a
language that holds most terms is spread; a task sends on one number for each pair
of sources, whatever the number of its classes. The rows of part ``pair`` are all
ordered pairs of a language's sources: that is the report itself.

Defined cases
- null text, lang or source: the empty string. An empty text has no terms, but its
  (lang, source) group is reported.
- a language without kept terms: all its pairs have value 0; it has no rows of part
  ``term``. A language of one source has no pairs.
- equal rows, also with one doc_id, are documents of their own. doc_id is not read.
- ties: by name, in UTF-8 order. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Query, gives_back, materialise, read, segments, shuffle_partitions

MIN_DOCS, TOP = 10, 10
SCALE, PRIOR = 1_000_000_000, 2
#: Counters that a task holds before it passes them on.
HELD_TERMS = 400_000
#: Numbers of one block of classes x sources in a task.
CELLS = 1 << 18
#: All but ASCII letters and bytes of letters beyond ASCII become a space; A-Z become a-z.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents); a key may come in several rows that add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
        documents: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in occurrences.items():
                df = documents[lang, source]
                columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(found), np.int64))), pa.array([source], pa.string()).take(pa.array(np.zeros(len(found), np.int64)))]
                columns += [pa.array([t.decode() for t in found], pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([df[t] for t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])
            occurrences.clear()
            documents.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                key, own = (lang, source), set()
                held -= len(occurrences[key])
                for part in segments(text.as_py().encode().translate(_TERMS), b" "):
                    terms = part.split()
                    occurrences[key].update(terms)
                    own.update(terms)
                documents[key].update(own)
                held += len(occurrences[key])
                if held > HELD_TERMS:
                    yield from emit()
                    held = 0
        yield from emit()

    return _named(docs, "text").mapInArrow(gives_back(run), "lang string, source string, term string, n long, df long")


def _named(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", *more)))


def probability(count: str, size: str, kept: str) -> str:
    """SQL of p; the product is a decimal, as it may pass 64 bits."""
    return f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + {PRIOR} as decimal(20, 0))) div cast({size} + {PRIOR} * {kept} as decimal(20, 0))"


def divergence(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)); p and q are at most 1e9 + 1, so 64 bits suffice."""
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def kept_terms(docs: DataFrame, groups: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term and vec, its counts in sources: an array of (i, n) for the sources that have it, by i.

    ``groups``: lang, source and i, the source's place in its language.
    """
    counts = term_counts(docs).repartition("lang", "term")
    by_source = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    # as many entries as the language has sources, at most
    terms = by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = terms.filter(F.col("df") >= min_docs).drop("df")
    places = groups.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "i"))).alias("at"))
    # the map of a language's sources goes to lanes of its terms, not to one task
    lanes = max(1, shuffle_partitions(docs.sparkSession))
    kept = kept.withColumn("lane", F.pmod(F.xxhash64("term"), F.lit(lanes)).cast("int"))
    places = places.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    vec = F.sort_array(F.transform("by", lambda e: F.struct(F.element_at("at", e["source"]).alias("i"), e["n"].alias("n"))))
    return kept.join(places, ["lang", "lane"]).select("lang", "term", vec.alias("vec"))


def classes(kept: DataFrame, top: int = TOP) -> DataFrame:
    """lang, vec, multiplicity and first: how many terms have this vector, and its first ``top`` of them by name."""
    many = kept.groupBy("lang", "vec").agg(F.count("*").alias("multiplicity"))
    first = kept.withColumn("r", F.row_number().over(Window.partitionBy("lang", "vec").orderBy("term"))).filter(F.col("r") <= top)
    return many.join(first.groupBy("lang", "vec").agg(F.sort_array(F.collect_list("term")).alias("first")), ["lang", "vec"])


def sizes(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a language with kept terms: kept (V), total (its occurrences of them) and by_source, those of each source by place."""
    found = kept.select("lang", F.explode("vec").alias("e")).groupBy("lang", F.col("e.i").alias("i")).agg(F.sum("e.n").alias("n"))
    all_sources = groups.join(found, ["lang", "i"], "left").select("lang", "i", F.coalesce("n", F.lit(0)).alias("n"))
    by_lang = all_sources.groupBy("lang").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("i", "n"))).alias("s"))
    return by_lang.select("lang", "total", F.expr("transform(s, x -> x.n)").alias("by_source")).join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the divergences of all pairs of a language's sources over the classes of this task."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        many = b.column("multiplicity").to_numpy(zero_copy_only=False)
        at = 0
        while at < len(langs):
            absent = np.asarray(b.column("absent")[at].as_py(), np.int64)
            step, n = max(1, CELLS // len(absent)), len(absent)
            end = at + 1
            while end < len(langs) and langs[end] == langs[at] and end - at < step:
                end += 1
            p = np.tile(absent, (end - at, 1))
            places, values = b.column("places").slice(at, end - at), b.column("p").slice(at, end - at)
            row = np.repeat(np.arange(end - at), places.value_lengths().to_numpy())
            p[row, places.flatten().to_numpy()] = values.flatten().to_numpy()
            total, m = sums.setdefault(langs[at], np.zeros((n, n), np.int64)), many[at:end]
            for i in range(n - 1):
                apart = p[:, i + 1 :] - p[:, i : i + 1]
                total[i, i + 1 :] += m @ (apart * apart // (p[:, i + 1 :] + p[:, i : i + 1]))
            at = end
    for lang, total in sums.items():
        i, j = np.triu_indices(len(total), 1)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["lang", "i", "j", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: see the module."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialise(_named(docs).distinct().withColumn("i", place), "divergence-groups")
    kept = materialise(kept_terms(docs, groups, min_docs), "divergence-kept")
    lanes = max(1, shuffle_partitions(docs.sparkSession))
    known = sizes(kept, groups).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    dealt = classes(kept, top).withColumn("lane", F.pmod(F.xxhash64("vec"), F.lit(lanes)).cast("int"))
    found = dealt.join(known, ["lang", "lane"]).select(
        "lang",
        "multiplicity",
        "first",
        F.expr("transform(vec, e -> e.i)").alias("places"),
        F.expr(f"transform(vec, e -> {probability('e.n', 'by_source[e.i]', 'kept')})").alias("p"),
        F.expr(f"transform(by_source, s -> {probability('0', 's', 'kept')})").alias("absent"),
        F.expr(probability("aggregate(vec, 0L, (a, e) -> a + e.n)", "total", "kept")).alias("q"),
    )
    found = materialise(found, "divergence-classes")
    sums = found.select("lang", "multiplicity", "places", "p", "absent").mapInArrow(_pair_sums, "lang string, i int, j int, value long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    others = groups.select("lang", F.col("i").alias("j"), F.col("source").alias("item"))
    pairs = groups.join(others, "lang").filter(F.col("i") != F.col("j")).join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    each = found.select("lang", "first", "q", F.explode(F.arrays_zip("places", "p")).alias("e")).filter(F.col("e.p") > F.col("q"))
    each = each.select("lang", F.col("e.places").alias("i"), F.expr(divergence("e.p", "q")).alias("value"), F.explode("first").alias("item"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    in_source = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    each = each.withColumn("rank", F.row_number().over(in_source)).filter(F.col("rank") <= top).join(groups, ["lang", "i"])
    terms = each.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce("source", '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + {PRIOR})) // (n.n + {PRIOR} * v.v)::HUGEINT AS BIGINT) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + ({SCALE}::HUGEINT * (sum(c) + {PRIOR})) // (nl + {PRIOR} * v)::HUGEINT AS BIGINT) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS nl FROM n GROUP BY lang) USING (lang) GROUP BY lang, term, nl, v),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr) QUALIFY part = 'pair' OR rank <= {TOP}"""


QUERIES: dict[str, Query] = {"op12_source_divergence": op12_source_divergence}
ORACLE: dict[str, str] = {"op12_source_divergence": _SQL}
