"""Topics proposed text by text, merged and pruned: a loop of calls over a bounded sample of texts on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EARLY_STOP, ROUNDS, PAIRS, RARE = 100, 10, 2, 0.01


@dataclass
class Topic:
    label: str
    description: str
    count: int = 0


@dataclass
class Taxonomy:
    """``merges``: (new label, what went into it); ``pruned``: labels dropped as rare; ``seen``: texts asked about."""

    topics: list[Topic]
    seeds: list[str]
    merges: list[tuple[str, list[str]]] = field(default_factory=list)
    pruned: list[str] = field(default_factory=list)
    seen: int = 0


def key(label: str) -> str:
    """Labels that differ in case and white space alone are one."""
    return " ".join(label.split()).casefold()


def generate(texts: Iterable[str], seeds: list[Topic], propose: Callable[[str, list[Topic]], tuple[str, str] | None], early_stop: int = EARLY_STOP) -> Taxonomy:
    """propose(text, topics) names a known or a new topic, or None; ends after ``early_stop`` texts in a row without a new one."""
    out = Taxonomy(list(seeds), [t.label for t in seeds])
    known, quiet = {key(t.label): t for t in out.topics}, 0
    for text in texts:
        if quiet >= early_stop:
            break
        out.seen += 1
        said = propose(text, out.topics)
        quiet += 1
        if said is None:
            continue
        topic = known.get(key(said[0]))
        if topic is None:
            known[key(said[0])] = topic = Topic(*said)
            out.topics.append(topic)
            quiet = 0
        topic.count += 1
    return out


def merge(taxonomy: Taxonomy, similar: Callable[[list[Topic]], list[tuple[float, int, int]]], decide: Callable[[list[tuple[Topic, Topic]]], list[tuple[str, str, list[str]]]]) -> set[str]:
    """In rounds, the most similar pairs not asked about yet are put to ``decide``, which names (label, description, labels to merge).

    similar(topics): (similarity, i, j) with i < j above the threshold. Counts add up. Returns
    the keys that pruning leaves alone: the seeds and what they were merged into.
    """
    protected, asked = {key(s) for s in taxonomy.seeds}, set()
    for _ in range(ROUNDS):
        found = sorted(similar(taxonomy.topics), key=lambda x: (-x[0], x[1], x[2]))
        pairs = [(taxonomy.topics[i], taxonomy.topics[j]) for _, i, j in found]
        pairs = [p for p in pairs if frozenset(key(t.label) for t in p) not in asked][:PAIRS]
        if not pairs:
            break
        asked |= {frozenset(key(t.label) for t in p) for p in pairs}
        for label, description, labels in decide(pairs):
            gone = {key(x) for x in labels}
            parts = [t for t in taxonomy.topics if key(t.label) in gone | {key(label)}]
            if not parts:
                continue
            if gone & protected:
                protected.add(key(label))
            at = taxonomy.topics.index(parts[0])
            taxonomy.topics[at] = Topic(label, description, sum(t.count for t in parts))
            taxonomy.topics = [t for t in taxonomy.topics if t is taxonomy.topics[at] or not any(t is p for p in parts)]
            taxonomy.merges.append((label, sorted(t.label for t in parts)))
    return protected


def prune(taxonomy: Taxonomy, protected: set[str], rare: float = RARE) -> None:
    """Drops topics with under ``rare`` of all counts that are neither seeds nor merged from one."""
    total = sum(t.count for t in taxonomy.topics)
    stays = [t for t in taxonomy.topics if key(t.label) in protected or t.count >= rare * total]
    taxonomy.pruned += [t.label for t in taxonomy.topics if t not in stays]
    taxonomy.topics = stays


def until_quiet(rows: DataFrame, by: list[str], place: str, is_new: str, early_stop: int) -> DataFrame:
    """The rows that an early stop lets through: up to the one that ends the first ``early_stop`` rows in a row without a new topic.

    by: one sequence each; place: 0, 1, ... within it.
    """
    w = Window.partitionBy(*by).orderBy(place)
    quiet = F.col(place) - F.coalesce(F.max(F.when(F.col(is_new), F.col(place))).over(w), F.lit(-1))
    out = rows.withColumn("_quiet", quiet)
    stop = F.min(F.when(F.col("_quiet") >= early_stop, F.col(place))).over(Window.partitionBy(*by))
    return out.withColumn("_stop", stop).filter(F.coalesce(F.col(place) <= F.col("_stop"), F.lit(True))).drop("_quiet", "_stop")
