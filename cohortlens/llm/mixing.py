"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hashed order, form blocks of about BLOCK_CHARS
characters. Block i of a source of weight w is released at slot floor(i / w) and
due at slot ceil((i + 1) / w); each slot runs the released block that is due
first. With weights in units of 1 / PERIOD the schedule repeats every PERIOD
slots, so one period is computed by earliest deadline first, and every block
finds its slot by arithmetic. A text longer than a block stands at the slot of its
first block, and its further blocks' slots count as taken by it. At any slot a source is less than one block away
from its share. When a source runs out, the weights of the others are shared
anew from that slot on.

Defined cases
- null source, or one without a target: the source "*".
- null or empty text: no characters; the document belongs to the block it falls in.
- null doc_id: ordered by its hash like any other. Equal rows are all kept.
- empty table: no rows. Extra columns are kept by ``mix``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Query, fresh, join_small, materialise, read
from .packing import REST, in_queues, starts

TARGETS = {"src0": 0.30, "src1": 0.15, "src2": 0.10, "src3": 0.05, REST: 0.40}
PERIOD = 1000
BLOCK_CHARS = 1 << 16


@dataclass
class Phase:
    """From ``slot`` on, with ``base`` blocks of each source done, block j of a period runs at order[source][j]."""

    slot: int
    weights: dict[str, int]
    base: dict[str, int]
    order: dict[str, list[int]]


def units(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights in units of 1 / period, by largest remainders, at least one each."""
    total = sum(weights.values())
    exact = {q: w / total * period for q, w in weights.items()}
    out = {q: max(1, int(x)) for q, x in exact.items()}
    order = sorted(exact, key=lambda q: (int(exact[q]) - exact[q], q))
    for i in range(period - sum(out.values())):
        out[order[i % len(order)]] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda q: (out[q], q))] -= 1
    return out


def release(i: int, w: int, period: int = PERIOD) -> int:
    return i * period // w


def deadline(i: int, w: int, period: int = PERIOD) -> int:
    return -(-(i + 1) * period // w)


def one_period(weights: dict[str, int], period: int = PERIOD) -> dict[str, list[int]]:
    """Earliest deadline first over one period: for each source the slots of its blocks."""
    waiting = [[] for _ in range(period)]
    for q, w in weights.items():
        for i in range(w):
            waiting[release(i, w, period)].append((deadline(i, w, period), q))
    ready: list[tuple[int, str]] = []
    out: dict[str, list[int]] = {q: [] for q in weights}
    for slot in range(period):
        for x in waiting[slot]:
            heapq.heappush(ready, x)
        due, q = heapq.heappop(ready)  # the weights fill the period, so a block is always released
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        out[q].append(slot)
    return out


def phases(blocks: dict[str, int], targets: dict[str, float], period: int = PERIOD) -> list[Phase]:
    """At most one phase for each source that has blocks."""
    left = {q: n for q, n in sorted(blocks.items()) if n}
    base = dict.fromkeys(left, 0)
    slot, out = 0, []
    while left:
        w = units({q: targets[q] for q in left}, period)
        order = one_period(w, period)
        out.append(Phase(slot, w, {q: base[q] for q in left}, order))
        end = min((n - 1) // w[q] * period + order[q][(n - 1) % w[q]] + 1 for q, n in left.items())
        for q in list(left):
            done = end // period * w[q] + sum(s < end % period for s in order[q])
            base[q] += done
            left[q] -= done
            if not left[q]:
                del left[q]
        slot += end
    return out


def in_blocks(docs: DataFrame, targets: dict[str, float], block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, dict[str, int]]:
    """(doc_id, _t, n_rows, _q, block, in_block) for every distinct (doc_id, text, source), and each source's number of blocks.

    in_block: characters of the queue since the block began. A text that runs on into further
    blocks (equal rows: all their texts) has a row of n_rows 0 for each of them.
    """
    slim = docs.select("doc_id", F.xxhash64("text").alias("_t"), "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_n"))
    slim = slim.groupBy("doc_id", "_t", "source").agg(F.count("*").alias("n_rows"), F.max("_n").alias("_n"))
    slim = materialise(slim, "mixing-docs")
    placed = in_queues(slim, targets, slim.count())
    placed = placed.withColumn("_n", F.col("_n") * F.col("n_rows"))
    sums = placed.groupBy("_q", "_b").agg(F.sum("_n").alias("_sum"))
    offsets = starts(sums, "_sum").select("_q", "_b", "_start")
    inside = Window.partitionBy("_q", "_b").orderBy("doc_id", "_t", "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, ["_q", "_b"])
    start = F.col("_start") + F.col("_at")
    first, last = F.floor(start / block_chars), F.floor((start + F.greatest(F.col("_n"), F.lit(1)) - 1) / block_chars)
    rows = rows.select("doc_id", "_t", "source", "n_rows", "_q", first.alias("block"), (start % block_chars).alias("in_block"), start.alias("_pos"), last.alias("_last"))
    rows = materialise(rows, "mixing-blocks")
    totals = {r["_q"]: r["k"] for r in rows.groupBy("_q").agg((F.max("_last") + 1).alias("k")).collect()}  # a row for each target
    # the blocks that a text runs on into take their slots too
    each = rows.select("doc_id", "_t", "source", "n_rows", "_q", "in_block", "_pos", F.posexplode(F.sequence("block", "_last")).alias("_i", "block"))
    begins = F.col("_i") == 0
    each = each.withColumns({"n_rows": F.when(begins, F.col("n_rows")).otherwise(F.lit(0).cast("long")), "in_block": F.when(begins, F.col("in_block")).otherwise(F.lit(0).cast("long")), "_pos": F.when(begins, F.col("_pos")).otherwise(F.col("block") * block_chars)})
    return each.drop("_i"), totals


def slots(docs: DataFrame, targets: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """doc_id, _t, source, n_rows, _q, block, in_block, slot, release and due of every distinct row of docs.

    Further rows, of n_rows 0, hold the slots of the blocks that a long text runs on into.
    """
    targets = TARGETS if targets is None else targets
    if REST not in targets:
        raise ValueError('targets need "*"')
    rows, totals = in_blocks(docs, targets, block_chars)
    plan = phases(totals, targets, period)
    spark = docs.sparkSession
    spans, table = [], []
    for i, p in enumerate(plan):
        for q, w in p.weights.items():
            upto = next((x.base[q] for x in plan[i + 1 :] if q in x.base), totals[q])
            spans.append((q, i, p.base[q], upto, w, p.slot))
            table += [(q, i, j, s) for j, s in enumerate(p.order[q])]
    # both tables grow with the targets alone: spans by their square, table by PERIOD
    spans_df = spark.createDataFrame(spans, "_q string, _phase int, _from long, _upto long, _w long, _slot long")
    table_df = spark.createDataFrame(table, "_q string, _phase int, _j long, _s long")
    rows = rows.join(F.broadcast(spans_df), (rows["_q"] == spans_df["_q"]) & (rows["block"] >= spans_df["_from"]) & (rows["block"] < spans_df["_upto"])).drop(spans_df["_q"])
    i = F.col("block") - F.col("_from")
    rows = rows.withColumns({"_j": i % F.col("_w"), "_h": F.floor(i / F.col("_w"))})
    rows = join_small(rows, table_df, ["_q", "_phase", "_j"], len(table))
    w = F.col("_w")
    return rows.select(
        "doc_id", "_t", "source", "n_rows", "_q", "block", "in_block", "_pos",
        (F.col("_slot") + F.col("_h") * period + F.col("_s")).alias("slot"),
        (F.col("_slot") + F.floor(i * period / w)).alias("release"),
        (F.col("_slot") + F.ceil((i + 1) * period / w)).alias("due"),
    )


def mix(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, all columns, in schedule order: files and the rows within them ascend by slot."""
    key, own, slot, place = fresh(docs, "_key", "_own", "_slot", "_place")
    found = slots(docs, targets).filter("n_rows > 0")
    order = found.select(F.xxhash64("doc_id", "_t", "source").alias(own), F.col("slot").alias(slot), F.col("_pos").alias(place))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.col("source")))
    joined = keyed.join(order, F.col(key) == F.col(own))
    return joined.repartitionByRange(slot, place).sortWithinPartitions(slot, place, key).select(*docs.columns)


def deviation(order: list[str], weights: dict[str, int], period: int = PERIOD) -> Fraction:
    """The largest distance, in blocks, of any source from its share in any prefix of a schedule."""
    done = dict.fromkeys(weights, 0)
    worst = Fraction(0)
    for t, q in enumerate(order, 1):
        done[q] += 1
        worst = max(worst, *(abs(Fraction(t * w, period) - done[s]) for s, w in weights.items()))
    return worst


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots(read(spark, sf_dir, "documents")).filter("n_rows > 0")
    rows = rows.withColumn("doc_id", F.explode(F.array_repeat("doc_id", F.col("n_rows").cast("int"))))
    return rows.select("doc_id", "source", F.col("_q").alias("queue"), "block", "in_block", "slot", "release", "due")


QUERIES: dict[str, Query] = {"op5_source_mixing": op5_source_mixing}
ORACLE: dict[str, str] = {}
