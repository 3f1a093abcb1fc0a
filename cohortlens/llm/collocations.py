"""Phrase collocation mining: word sequences that occur together more than their parts suggest.

Texts are cut into pieces at punctuation and line ends, pieces into words, and the
n-grams of 1 to ``max_n`` words of each piece become rows that one aggregation a
language counts. A phrase seen ``min_count`` times has parts seen as often, so an
n-gram is made a row only if both its (n - 1)-grams may be that frequent: level by
level, the hashes of n-grams are counted first, and those that reach ``min_count``
set bits in a filter that the next level asks. A filter has no false negatives and
two n-grams of one hash can only look more frequent than they are, so it leaves out
nothing; the counts themselves are of the phrases as text. Its size follows the
number of frequent n-grams up to FILTER_BITS, beyond which it lets more through.

Joins on the counted rows give each cut of a phrase its left and right part; scores
are decimals, as products may pass 64 bits. A phrase is dropped if a one-word
extension of it, itself frequent, has at least ``cover`` percent of its count. (An
extension by more words needs one by one word that is at least as frequent.)

Defined cases
- null text: no words. Null lang: ``und``, together with documents so labelled.
- documents are rows: equal rows count each. doc_id is not read, extra columns are ignored.
- a language without candidates has no rows; an empty table has none.
- very long texts are read in parts that end where a piece ends, so no phrase is cut;
  a piece is read as a whole.
- ties: score, then count, both descending, then the phrase in UTF-8 order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Query, gives_back, materialise, read, segments, shuffle_partitions

MAX_N, MIN_COUNT, COVER, TOP = 4, 30, 80, 2000
UNKNOWN = "und"
#: Most bits of a level's filter: 16 MB in every executor. Sixteen bits for each frequent n-gram are used up to that.
FILTER_BITS, BITS_EACH, LEAST_BITS = 1 << 27, 16, 1 << 16
#: Bytes of one block in a task, and n-grams that a task holds before it passes their counts on.
BLOCK_BYTES, HELD = 1 << 20, 1 << 20
#: A-Z become a-z; the marks [.,;:!?] and the bytes 0A-0D end a piece; a tab is a space.
_BYTES = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Numbers for words in the order of first sight; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """The words of some texts of one language as numbers, with 0 where a piece ends, and the hash of each n-gram."""

    def __init__(self, lang: str, texts: list[bytes]):
        words = _Words({b"\n": 0})
        found = b"\n".join(texts).replace(b"\n", b" \n ").split(b" ")
        x = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        if b"" in words:
            x = x[x != words[b""]]
        self.lang, self.words, self.x = lang, list(words), x
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        self.h = hashes[x] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))

    def levels(self, max_n: int, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to max_n words: where n-grams begin that may be frequent, and their hashes.

        ``filters``: of 1, 2, ... words. Of n-grams without a filter both (n - 1)-grams pass theirs.
        """
        at = np.flatnonzero(self.x)
        code = self.h[at]
        for n in range(1, max_n + 1):
            if n > 1:
                whole = np.zeros(len(self.x) + 1, np.uint64)
                alive = np.zeros(len(self.x) + 1, bool)
                whole[at], alive[at] = code, True
                at = np.flatnonzero(alive[:-1] & alive[1:])
                code = _mixed(whole[at], self.h[at + n - 1])
            if n <= len(filters):
                passes = _holds(filters[n - 1], code)
                at, code = at[passes], code[passes]
            yield at, code


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        c = (a ^ (a >> np.uint64(29))) * _MIX + b
        return (c ^ (c >> np.uint64(32))) * _MIX


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(bits.size * 64 - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            for part in segments(text.as_py().encode().translate(_BYTES), b"\n", BLOCK_BYTES):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
                if size[lang] >= BLOCK_BYTES:
                    size.pop(lang)
                    yield Block(lang, held.pop(lang))
    for lang, texts in held.items():
        yield Block(lang, texts)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def frequent_filter(docs: DataFrame, n: int, filters: list[np.ndarray], min_count: int = MIN_COUNT) -> np.ndarray:
    """Bits at the hashes of all n-grams that occur min_count times in their language, and of some more; docs: lang, text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, total = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, of = np.unique(np.concatenate(held), return_inverse=True)
            return u, np.bincount(of, np.concatenate(many), len(u)).astype(np.int64)

        def batch(u: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "c"])

        for block in _blocks(batches):
            *_, (_, codes) = block.levels(n, shared.value)
            u, c = np.unique(codes, return_counts=True)
            held.append(u)
            many.append(c)
            total += len(u)
            if total > 2 * HELD:
                u, c = merged()
                held, many, total = [u], [c], len(u)
                if total > HELD:
                    yield batch(u, c)
                    held, many, total = [], [], 0
        if total:
            yield batch(*merged())

    counts = docs.mapInArrow(gives_back(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    frequent = materialise(counts.filter(F.col("c") >= min_count).select("h"), f"collocations-{n}")
    bits = LEAST_BITS
    while bits < min(FILTER_BITS, BITS_EACH * frequent.count()):
        bits *= 2
    place = F.col("h").bitwiseAND(bits - 1)
    by_word = frequent.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    found = by_word.toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    shared.unpersist()
    return out


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, words (how many), phrase and f of all phrases seen min_count times; words 0: how many words the language has in all.

    docs: lang, text, without nulls.
    """
    filters: list[np.ndarray] = []
    for n in range(1, max_n):
        filters.append(frequent_filter(docs, n, filters, min_count))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = block.x
            langs, sizes, phrases, counts = [], [0], [""], [int((x > 0).sum())]
            at = np.flatnonzero(x)
            code = np.zeros(len(x) + 1, np.int64)
            code[at] = x[at]
            for n, (may, _) in enumerate(block.levels(max_n, shared.value), 1):
                # equal words have equal numbers, so phrases are told apart as such and not by a hash
                pair = code[may] * len(block.words) + x[may + n - 1] if n > 1 else code[may]
                u, first, of, c = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                code = np.zeros(len(x) + 1, np.int64)
                code[may] = of + 1
                begin = may[first]
                sizes += [n] * len(u)
                counts += c.tolist()
                phrases += [b" ".join([block.words[w] for w in x[i : i + n]]).decode() for i in begin.tolist()]
            langs = [block.lang] * len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], ["lang", "words", "phrase", "f"])

    rows = docs.mapInArrow(gives_back(run), "lang string, words int, phrase string, f long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= min_count) | (F.col("words") == 0))


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases; see the module."""
    counts = materialise(phrase_counts(_named(docs), max_n, min_count), "collocations")
    phrases = counts.filter("words > 0")
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    candidates = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # the two phrases that lack the last or the first word of a longer candidate
    longer = candidates.filter("words > 2").withColumn("phrase", F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    # decimals, as the products may pass 64 bits
    covered = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {cover}")
    best = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~covered)
    # the first of each lane, then the first of those: no task sorts all phrases of a language
    lane = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    first = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *keys).orderBy(F.desc("s.score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    ranked = first(first(best.withColumn("lane", lane), "lane"))
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", "s.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS k, array_to_string(w[i : i + {n - 1}], ' ') AS phrase FROM p, unnest(range(1, len(w) - {n - 2})) AS u(i)" for n in range(1, MAX_N + 1))
_SQL = f"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS x FROM d)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, a, i, h.f AS l, t.f AS r, CAST((2000000::HUGEINT * a) // (h.f + t.f) AS BIGINT) AS score FROM c, unnest(range(1, m)) AS u(i)
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:i], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(w[i + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
x AS (SELECT DISTINCT c.lang, s.phrase FROM c JOIN c s ON s.lang = c.lang AND s.m < c.m AND 100 * c.a >= {COVER} * s.a
  AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN t USING (lang) ANTI JOIN x ON x.lang = b.lang AND x.phrase = b.phrase QUALIFY rank <= {TOP}"""


QUERIES: dict[str, Query] = {"op13_collocations": op13_collocations}
ORACLE: dict[str, str] = {"op13_collocations": _SQL}
