"""A sensitivity dial: texts whose sentences are rewritten by ordered rules, at nested densities.

A text is a stream of sentences that joins to the text again. Every sentence is rewritten
once; a density p keeps those rewritings whose coin lies below p. The coin belongs to
the sentence's place, so what a density rewrites, each higher one rewrites too.
With rules the work stays in the text's row, without an exchange; a costly rewriter
(a model, a parser) takes the way through ``RewriteCache``, which asks it once a sentence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentence_pieces
from ..sources.deltas import DeltaTable
from .sampling import hashed, hash_rank

#: White space, as the sentence splitter knows it.
SPACE = " \t\n\x0b\f\r"
#: cohort -> density.
DENSITIES = {"value_p05": 0.05, "value_p10": 0.10, "value_p25": 0.25, "value_p50": 0.50, "value_p100": 1.00}


class Rule(NamedTuple):
    """Replaces each match of a pattern (without look-around, so that any dialect of patterns takes it).

    Every match holds one of ``needs``: a text without them isn't searched by the pattern, which costs far more.
    """

    name: str
    pattern: str
    to: str
    needs: tuple[str, ...] = ("",)


#: Morphosyntax that the public literature describes for the dialect, in the order in which it applies.
RULES = (
    Rule("negated_auxiliary", r"(^|[^A-Za-z])(?:am not|is not|isn't|are not|aren't|has not|hasn't|have not|haven't)([^A-Za-z]|$)", "$1ain't$2", (" not", "n't")),
    Rule("negative_concord", r"(n't|[Nn]ever|[Nn]obody) ([a-z]+) (?:a|an|any) ", "$1 $2 no ", ("n't ", "ever ", "obody ")),
    Rule("negative_concord_pronoun", r"(n't|[Nn]ever|[Nn]obody) ([a-z]+) any(thing|body|where)", "$1 $2 no$3", (" any",)),
    Rule("existential_it", r"(^|[^A-Za-z])(?:there is|there are|there's)([^A-Za-z]|$)", "$1it's$2", ("there is", "there are", "there's")),
    Rule("going_to", r"(^|[^A-Za-z])(?:is|are) going to([^A-Za-z]|$)", "$1gon$2", (" going to",)),
    Rule("habitual_be", r"(^|[^A-Za-z])([Hh]e|[Ss]he|[Ii]t|[Ww]e|[Yy]ou|[Tt]hey) (?:usually|always|often) (?:is|are) ", "$1$2 be ", (" usually ", " always ", " often ")),
    Rule("zero_copula", r"(^|[^A-Za-z])([Hh]e|[Ss]he|[Ww]e|[Yy]ou|[Tt]hey)(?: is| are|'s|'re) ([a-z])", "$1$2 $3", ("e is ", "e are ", "u is ", "u are ", "y is ", "y are ", "'s ", "'re ")),
    Rule("levelled_was", r"(^|[^A-Za-z])([Ww]e|[Yy]ou|[Tt]hey) were([^A-Za-z]|$)", "$1$2 was$3", (" were",)),
    Rule("remote_been", r"(^|[^A-Za-z])(?:has|have) been ([a-z]+ing)", "$1been $2", (" been ",)),
    Rule("completive_done", r"(^|[^A-Za-z])(?:has|have) already ([a-z]+)", "$1done $2", (" already ",)),
    Rule("uninflected_third_person", r"(^|[^A-Za-z])([Hh]e|[Ss]he|[Ii]t) (want|need|know|think|say|make|look|work|run|get|come)s([^A-Za-z]|$)", "$1$2 $3$4", tuple(f" {v}s" for v in "want need know think say make look work run get come".split())),
    Rule("demonstrative_them", r"(^|[^A-Za-z])those ([a-z]+s)([^A-Za-z]|$)", "$1them $2$3", ("those ",)),
    Rule("plural_you", r"(^|[^A-Za-z])(?:you all|you guys)([^A-Za-z]|$)", "$1y'all$2", ("you all", "you guys")),
    Rule("relative_what", r" that (he|she|we|you|they) ", " what $1 ", (" that ",)),
)


def rewritten(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(text, n_rules): the text after all rules in order, and how many of them changed it."""
    start = F.struct(text.alias("text"), F.lit(0).alias("n_rules"))
    if not rules:
        return start

    def step(so_far: Column, k: Column) -> Column:
        old, choice = so_far["text"], None
        for i, r in enumerate(rules):
            may = reduce(lambda a, b: a | b, (F.contains(old, F.lit(x)) for x in r.needs))
            new = F.when(may, F.regexp_replace(old, r.pattern, r.to)).otherwise(old)
            choice = F.when(k == i, new) if choice is None else choice.when(k == i, new)
        # an array of one, so that the replacement is named and made once
        fired = lambda t: F.struct(t.alias("text"), (so_far["n_rules"] + (t != so_far["text"]).cast("int")).alias("n_rules"))
        return F.element_at(F.transform(F.array(choice), fired), 1)

    return F.aggregate(F.array(*(F.lit(i) for i in range(len(rules)))), start, step)


def _core(piece: Column) -> Column:
    return F.rtrim(piece, F.lit(SPACE))


def _coin(seed: int, key: str, place: Column) -> Column:
    return F.substring(hashed(seed, F.col(key), place.cast("string")), 1, 8)


def _sentence(piece: Column, core: Column, to: Column, coin: Column) -> Column:
    """(piece, new, n_rules, coin): a sentence with the white space behind it, and what it becomes; null where nothing changes it."""
    other = to["text"] != core
    sep = F.substring(piece, F.length(core) + 1, F.length(piece))
    return F.struct(piece.alias("piece"), F.when(other, F.concat(to["text"], sep)).alias("new"), F.when(other, to["n_rules"]).alias("n_rules"), F.when(other, coin).alias("coin"))


def rewrite_sentences(prompts: DataFrame, rules: tuple[Rule, ...] = RULES, seed: int = 0, key: str = "prompt_id") -> DataFrame:
    """prompts with ``sentences``: array of (piece, new, n_rules, coin) in the text's order, see ``_sentence``. No exchange."""
    literals = sorted({x for r in rules for x in r.needs})
    held = F.filter(F.array(*map(F.lit, literals)).cast("array<string>"), lambda x: F.contains(F.col("text"), x))

    def one(piece: Column, i: Column, held: Column) -> Column:
        same = F.struct(_core(piece).alias("text"), F.lit(0).alias("n_rules"))
        # the first rule that changes a sentence needs a literal that the sentence itself holds
        to = F.when(F.exists(held, lambda x: F.contains(piece, x)), rewritten(_core(piece), rules)).otherwise(same)
        return F.element_at(F.transform(F.array(to), lambda t: _sentence(piece, _core(piece), t, _coin(seed, key, i))), 1)

    # named within the expression: as a column of its own it would be put into the inner function and made anew for each sentence
    return prompts.withColumn("sentences", F.element_at(F.transform(F.array(held), lambda h: F.transform(sentence_pieces(F.col("text")), lambda x, i: one(x, i, h))), 1))


class RewriteCache:
    """Rewritings by sentence, in a folder: a costly rewriter sees each distinct sentence once over all runs.

    ``rewrite`` takes rows of ``core`` and returns them with ``text`` and ``n_rules``; a sentence for which
    it gives none stays as it is. A delta is written whole and then named, so a run that dies leaves nothing
    that is read. Another seed or another rewriter needs another folder.
    """

    def __init__(self, spark: SparkSession, folder: str, rewrite: Callable[[DataFrame], DataFrame]) -> None:
        self.table, self.rewrite = DeltaTable(spark, folder, "sentence_id string, text string, n_rules int"), rewrite

    def sentences(self, prompts: DataFrame, seed: int = 0, key: str = "prompt_id") -> DataFrame:
        """As ``rewrite_sentences``: prompts (one row a key) with ``sentences``, through the cache."""
        stream = prompts.select(key, F.posexplode(sentence_pieces(F.col("text"))).alias("i", "piece")).withColumn("core", _core(F.col("piece")))
        stream = stream.withColumn("sentence_id", F.sha2("core", 256))
        one = stream.select("sentence_id", "core").dropDuplicates(["sentence_id"])
        new = one.join(self.table.read().select("sentence_id"), "sentence_id", "left_anti")
        answers = self.rewrite(new.select("core")).select(F.sha2("core", 256).alias("sentence_id"), "text", F.col("n_rules").cast("int").alias("n_rules"))
        kept = F.coalesce(F.col("a.text"), F.col("o.core")).alias("text"), F.coalesce(F.when(F.col("a.text").isNotNull(), F.col("a.n_rules")), F.lit(0)).alias("n_rules")
        self.table.append(new.alias("o").join(answers.dropDuplicates(["sentence_id"]).alias("a"), "sentence_id", "left").select("sentence_id", *kept))
        known = self.table.read().dropDuplicates(["sentence_id"])
        row = _sentence(F.col("piece"), F.col("core"), F.struct("text", "n_rules"), _coin(seed, key, F.col("i")))
        texts = stream.join(known, "sentence_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", row.alias("s")))).alias("s"))
        texts = texts.select(key, F.transform("s", lambda x: x["s"]).alias("_s"))
        return prompts.join(texts, key, "left").withColumn("sentences", F.coalesce("_s", F.array().cast(texts.schema["_s"].dataType))).drop("_s")


def at_density(sentences: Column, bound: Column) -> tuple[Column, Column]:
    """The text with the changed sentences whose coin lies below the bound, white space around it removed, and the rules in it."""
    text = F.array_join(F.transform(sentences, lambda x: F.when(x["coin"] < bound, x["new"]).otherwise(x["piece"])), "")
    n = F.aggregate(sentences, F.lit(0), lambda a, x: a + F.when(x["coin"] < bound, x["n_rules"]).otherwise(0))
    return F.trim(text, F.lit(SPACE)), n


def bound(p: float) -> str:
    """What a coin of density p lies below; "g" lies above every coin."""
    return "g" if p >= 1 else f"{int(p * 2**32):08x}"


def dialect_cohorts(rewritten_prompts: DataFrame, densities: dict[str, float] = DENSITIES) -> DataFrame:
    """A row for each prompt and density: cohort, text, n_rules, markedness (any rule), codedness (rules a word, at most 1).

    Takes the rows of ``rewrite_sentences`` or of a cache. Null texts are empty; an empty text stays empty at each density.
    """
    dial = F.explode(F.array(*(F.struct(F.lit(c).alias("cohort"), F.lit(bound(p)).alias("bound")) for c, p in densities.items())))
    rest = [c for c in rewritten_prompts.columns if c not in ("text", "sentences", "cohort", "n_rules", "markedness", "codedness")]
    text, n = at_density(F.col("sentences"), F.col("d.bound"))
    rows = rewritten_prompts.select(*rest, "sentences", dial.alias("d")).select(*rest, F.col("d.cohort").alias("cohort"), text.alias("text"), n.alias("n_rules"))
    words = F.greatest(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(1)).cast("long")
    # rounded half up to four places in whole numbers, so that every engine rounds alike
    share = F.least(F.floor((20000 * F.col("n_rules") + words) / (2 * words)), F.lit(10000)) / 10000
    return rows.withColumns({"markedness": (F.col("n_rules") > 0).cast("int"), "codedness": share})


def unmarked_cohorts(prompts: DataFrame, seed: int = 0) -> DataFrame:
    """The untouched texts: cohort ``baseline``, and its authors dealt in turn, in hash order, to ``null_split_a`` and ``null_split_b``."""
    authors = hash_rank(prompts.select("author_id").distinct(), f"{seed}:null", "author_id", "_k")
    sides = authors.select("author_id", F.when(F.col("_k") % 2 == 1, "null_split_a").otherwise("null_split_b").alias("_side"))
    rows = prompts.join(sides, "author_id").withColumn("cohort", F.explode(F.array(F.lit("baseline"), F.col("_side")))).drop("_side")
    return rows.withColumns({"n_rules": F.lit(0), "markedness": F.lit(0), "codedness": F.lit(0.0)})
