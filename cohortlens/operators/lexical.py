"""Marked words: log-odds of word use between two sides under a Dirichlet prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.information import normal_quantile
from ..functions.text import word_tokens
from ..sources.shared import written
from .permutation import draws, hashes
from .ranking import places

#: Total of the published word-count reference that the mixed prior is scaled to.
REFERENCE_TOTAL = 1_161_192
FLOOR = 1e-9
Z_CRITICAL = 1.96
#: The 27 common words that always calibrate the prior's strength.
STOPWORDS = (
    "the", "of", "and", "to", "a", "in", "for", "is", "on", "that", "by", "this", "with", "i", "you", "it", "not", "or", "be", "are", "from", "at", "as", "your", "am", "an", "my",
)
#: The search for the strongest constant, and the most frequent reference words that count as register.
LEAST_CONSTANT, MOST_CONSTANT, STEPS, REGISTER = 0.005, 1.0, 24, 40


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """df beside sums over all its rows: an aggregation and one broadcast row, where a window would gather all rows in one task."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in totals.items()))))


def word_counts(prompts: DataFrame, least: int = 5) -> DataFrame:
    """(word, y_t, y_b) of words that both sides together use at least so often."""
    words = prompts.select("cohort", F.explode(word_tokens(F.col("text"))).alias("word"))
    t = F.col("cohort") == "target"
    return words.groupBy("word").agg(F.count_if(t).alias("y_t"), F.count_if(~t).alias("y_b")).filter(F.col("y_t") + F.col("y_b") >= least)


def reference_frequencies(texts: DataFrame) -> DataFrame:
    """(word, freq) of a reference corpus."""
    n = texts.select(F.explode(word_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return with_totals(n, _n=F.sum("n")).select("word", (F.col("n") / F.col("_n")).alias("freq"))


def mixed_prior(counts: DataFrame, reference: DataFrame, w: float) -> DataFrame:
    """Adds prior: (1 - w) (y_t + y_b) + w * reference frequency * REFERENCE_TOTAL."""
    ref = F.greatest(F.coalesce("freq", F.lit(0.0)), F.lit(FLOOR))
    return counts.join(reference, "word", "left").withColumn("prior", (1 - w) * (F.col("y_t") + F.col("y_b")) + w * ref * REFERENCE_TOTAL).drop("freq")


def log_odds(df: DataFrame, alpha_t: Column, alpha_b: Column) -> DataFrame:
    """Adds delta and z. Totals run over the whole vocabulary."""
    rows = with_totals(df.withColumns({"_at": alpha_t, "_ab": alpha_b}), _nt=F.sum("y_t"), _nb=F.sum("y_b"), _sum_t=F.sum("_at"), _sum_b=F.sum("_ab"))
    side = lambda y, a, n, s: F.log((F.col(y) + F.col(a)) / (F.col(n) + F.col(s) - F.col(y) - F.col(a)))
    delta = side("y_t", "_at", "_nt", "_sum_t") - side("y_b", "_ab", "_nb", "_sum_b")
    rows = rows.withColumn("delta", delta).withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("y_t") + F.col("_at")) + 1 / (F.col("y_b") + F.col("_ab"))))
    return rows.drop("_at", "_ab", "_nt", "_nb", "_sum_t", "_sum_b")


def fixed_prior(df: DataFrame, strength: float, w: float, reference: DataFrame) -> DataFrame:
    """alpha = strength (w p_reference + (1 - w) p_corpus), alike on both sides; both are shares over the vocabulary."""
    rows = df.join(reference, "word", "left").withColumn("freq", F.greatest(F.coalesce("freq", F.lit(0.0)), F.lit(FLOOR)))
    rows = with_totals(rows, _n=F.sum(F.col("y_t") + F.col("y_b")), _f=F.sum("freq"))
    return rows.withColumn("alpha", strength * (w * F.col("freq") / F.col("_f") + (1 - w) * (F.col("y_t") + F.col("y_b")) / F.col("_n"))).drop("freq", "_n", "_f")


def calibration_words(df: DataFrame, k: int = 20) -> DataFrame:
    """The words that rank among the k first by prior, target and baseline counts, and the stop words of the vocabulary."""
    top = lambda c: df.filter(F.col(c) > 0).orderBy(F.desc(c), "word").limit(k).select("word")
    return top("prior").intersect(top("y_t")).intersect(top("y_b")).union(df.filter(F.col("word").isin(*STOPWORDS)).select("word")).distinct()


def side_ratios(df: DataFrame, c: float) -> DataFrame:
    """Per side r = c * prior weight / side weight over the calibration words, or the whole vocabulary if it has none; alpha is prior / r."""
    chosen = df.join(F.broadcast(calibration_words(df).withColumn("_in", F.lit(True))), "word", "left")  # at most k + 27 words
    s = lambda col: F.coalesce(F.sum(F.when(F.col("_in"), F.col(col))), F.sum(col))
    weight = F.greatest(s("prior"), F.lit(FLOOR))
    return chosen.agg((c * weight / F.greatest(s("y_t"), F.lit(1.0))).alias("r_t"), (c * weight / F.greatest(s("y_b"), F.lit(1.0))).alias("r_b"))


def marked_words(df: DataFrame, c: float) -> DataFrame:
    """Prior counts scaled to each side so that calibration words weigh c."""
    r = side_ratios(df, c).first()
    return log_odds(df, F.col("prior") / r["r_t"], F.col("prior") / r["r_b"])


def _with_unit(df: DataFrame) -> DataFrame:
    """df beside the totals and the side ratios at a constant of one: a row of five numbers."""
    totals = df.agg(F.sum("y_t").alias("_n_t"), F.sum("y_b").alias("_n_b"), F.sum("prior").alias("_total"))
    return df.crossJoin(F.broadcast(totals.crossJoin(side_ratios(df, 1.0))))


def _z_at(c: Column) -> Column:
    """The z of a word of ``_with_unit`` at a constant."""
    part = lambda s: F.col("prior") / (c * F.col(f"r_{s}"))
    odds = lambda s: F.log((F.col(f"y_{s}") + part(s)) / (F.col(f"_n_{s}") + F.col("_total") / (c * F.col(f"r_{s}")) - F.col(f"y_{s}") - part(s)))
    return (odds("t") - odds("b")) / F.sqrt(1 / (F.col("y_t") + part("t")) + 1 / (F.col("y_b") + part("b")))


def constant_sweep(df: DataFrame, constants: list[float]) -> DataFrame:
    """(c, word, z) of every word at every constant: one pass, the constants a bounded list."""
    return _with_unit(df).withColumn("c", F.explode(F.array(*(F.lit(float(c)) for c in constants)))).select("c", "word", _z_at(F.col("c")).alias("z"))


def register_words(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Words of the vocabulary that are register: stop words, contractions, and the most frequent ones of the reference."""
    rows = df.select("word").join(reference, "word", "left").withColumn("freq", F.greatest(F.coalesce("freq", F.lit(0.0)), F.lit(FLOOR)))
    top = rows.orderBy(F.desc("freq"), "word").limit(REGISTER).select("word")
    fixed = rows.filter(F.col("word").isin(*STOPWORDS) | F.contains("word", F.lit("'"))).select("word")
    return fixed.union(top).distinct()


def strongest_clean_constant(df: DataFrame, register: DataFrame, low: float = LEAST_CONSTANT, high: float = MOST_CONSTANT, steps: int = STEPS) -> DataFrame:
    """(c): by bisection the largest at which no register word is marked; low if none is clean, high if all are.

    |z| falls with c, so every register word is bisected on its own, over the same
    midpoints, and the least of their constants is that of all of them: one aggregation.
    """
    rows = _with_unit(df).join(register, "word", "left_semi")
    clean = lambda c: F.abs(_z_at(c)) < Z_CRITICAL
    span = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        mid = (at["low"] + at["high"]) / 2
        return F.struct(F.when(clean(mid), mid).otherwise(at["low"]).alias("low"), F.when(clean(mid), at["high"]).otherwise(mid).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, halve)["low"]
    own = F.when(~clean(F.lit(low)), F.lit(low)).when(clean(F.lit(high)), F.lit(high)).otherwise(found)
    return rows.agg(F.coalesce(F.min(own), F.lit(high)).alias("c"))


# --- nulls: words scored again under shuffled authors ----------------------------------------------------------


def author_words(prompts: DataFrame) -> DataFrame:
    """(author_id, word, n)."""
    words = prompts.select("author_id", F.explode(word_tokens(F.col("text"))).alias("word"))
    return words.groupBy("author_id", "word").agg(F.count(F.lit(1)).alias("n"))


def shuffled_counts(prompts: DataFrame, permutations: int, seed: int, least: int = 5) -> DataFrame:
    """(perm, word, y_t, y_b) with whole authors dealt to the sides anew, by the draws of ``permutation``.

    An author's draws are the bits of one number, so the counts of author and word are joined
    once and added up by word for all permutations together; the vocabulary may be of any size.
    """
    if permutations > 62:
        raise ValueError("at most 62 permutations, the bits of a number")
    units = prompts.select("author_id", "cohort").distinct()
    drawn = draws(units, "author_id", F.col("cohort") == "target", permutations, seed)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 1 << np.arange(permutations, dtype=np.int64)
        for b in batches:
            column = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            label = drawn.labels(column("x"), column("y"), b.column("author_id").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("author_id"), pa.array(label.astype(np.int64) @ place)], ["author_id", "bits"])

    x, y = hashes(F.col("author_id"))
    marked = units.select(F.col("author_id").cast("string").alias("author_id"), x.alias("x"), y.alias("y")).mapInArrow(bits, "author_id string, bits long")
    counts = author_words(prompts).join(marked, "author_id")
    on = lambda p: F.sum(F.when(F.shiftright("bits", p).bitwiseAND(1) > 0, F.col("n")).otherwise(0))
    words = counts.groupBy("word").agg(F.sum("n").alias("n"), F.array(*(on(p) for p in range(permutations))).alias("t")).filter(F.col("n") >= least)
    words = written(words, "shuffled-counts")  # read several times by what scores them
    each = words.select("word", "n", F.posexplode("t").alias("perm", "y_t"))
    return each.select("perm", "word", "y_t", (F.col("n") - F.col("y_t")).alias("y_b"))


def rescored(counts: DataFrame, reference: DataFrame, c: float, w: float, strength: float, fixed_w: float, k: int = 20) -> DataFrame:
    """(mode, perm, word, z) of shuffled counts under both priors: ``mixed``, calibrated anew in each permutation, and ``fixed``."""
    rows = mixed_prior(counts, reference, w)
    top = lambda o: F.row_number().over(Window.partitionBy("perm").orderBy(F.desc(o), "word"))
    # the first k by each count, found apart so that each is cut before it is exchanged
    first = [rows.filter(F.col(o) > 0).select("perm", "word", top(o).alias("r")).filter(F.col("r") <= k).select("perm", "word") for o in ("prior", "y_t", "y_b")]
    common = first[0].join(first[1], ["perm", "word"]).join(first[2], ["perm", "word"])
    chosen = common.union(rows.filter(F.col("word").isin(*STOPWORDS)).select("perm", "word")).distinct()
    # at most k + 27 words a permutation
    marked = rows.join(F.broadcast(chosen.withColumn("_in", F.lit(True))), ["perm", "word"], "left")
    s = lambda col: F.coalesce(F.sum(F.when(F.col("_in"), F.col(col))), F.sum(col))
    weight = F.greatest(s("prior"), F.lit(FLOOR))
    sums = marked.groupBy("perm").agg(
        F.sum("y_t").alias("_n_t"), F.sum("y_b").alias("_n_b"), F.sum("prior").alias("_total"),
        (weight / F.greatest(s("y_t"), F.lit(1.0))).alias("r_t"), (weight / F.greatest(s("y_b"), F.lit(1.0))).alias("r_b"),
    )
    mixed = rows.join(F.broadcast(sums), "perm").select(F.lit("mixed").alias("mode"), "perm", "word", _z_at(F.lit(c)).alias("z"))
    alphas = fixed_prior(counts.filter("perm = 0"), strength, fixed_w, reference).select("word", "alpha")  # y_t + y_b is the same in all
    flat = counts.join(alphas, "word")
    of_all = flat.groupBy("perm").agg(F.sum("y_t").alias("_n_t"), F.sum("y_b").alias("_n_b"), F.sum("alpha").alias("_s"))
    odds = lambda y, n: F.log((F.col(y) + F.col("alpha")) / (F.col(n) + F.col("_s") - F.col(y) - F.col("alpha")))
    z = (odds("y_t", "_n_t") - odds("y_b", "_n_b")) / F.sqrt(1 / (F.col("y_t") + F.col("alpha")) + 1 / (F.col("y_b") + F.col("alpha")))
    return mixed.union(flat.join(F.broadcast(of_all), "perm").select(F.lit("fixed").alias("mode"), "perm", "word", z.alias("z")))


def qq_points(scored: DataFrame) -> DataFrame:
    """(mode, place, quantile, z): each mode's pooled scores in order beside the normal quantiles of their places."""
    # read three times: for the parts' bounds, their sizes and the rows
    ranked = places(written(scored, "null-scores"), "z", ["perm", "word"], ["mode"])
    return ranked.select("mode", "place", normal_quantile((F.col("place") - 0.5) / F.col("all_n")).alias("quantile"), "z")
