"""Exact top-k by inner product: MaxScore over the components of integer vectors.

A component is a query term. Its postings in a shard are the shard's rows by
value, best first for the query's sign; its score bound is the largest product.
A query comes with a threshold, its k-th best score over a bounded set of seed
rows. In each shard its terms are split by their bounds: non-essential ones
whose bounds are smallest, and essential ones, whose postings are traversed as
deep as it takes until a row seen in none of them cannot reach the threshold.
The rows found are scored by the essential terms, then the others are probed,
strongest first, while a row stays competitive with the threshold, which rises
with the scores found. Each shard gives its k best for every query; the best of
these are the result.

Vectors are packed into shards of SHARD rows and queries into blocks of BLOCK
rows; every block meets every shard once. Scores are exact integers.

Defined cases
- vectors null or with a null or non-finite component take no part, neither as
  queries nor as candidates.
- null vec_id: takes no part.
- equal vec_id, equal rows: each row is a candidate and, if asked for, a query of its own; only
  a query's own row is left out. Ties of both score and vec_id are alike.
- vectors of unequal length: absent components count as zero.
- scores beyond a signed 64-bit integer are held at its bounds.
- fewer than k candidates: all of them. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Query, materialise, read, shuffle_partitions

K = 5
EVERY = 50
SHARD, BLOCK = 4096, 2048
#: Rows, the first by hash, whose scores give every query its first threshold.
SEEDS = 1024
SCALE = 256
#: Terms that are probed before rows are looked at again, and depths at which postings may be left.
STEP, DEPTHS = 8, 32
INT64 = (-(2**63), 2**63 - 1)


def quantise(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(SCALE * x) as a matrix of int64, or of Python integers if some products could overflow."""
    width = max((len(v) for v in vectors), default=0)
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    big = np.floor(SCALE * x)
    if np.abs(big).max(initial=0) < 2**26:  # so far below 2**63 for any width under 2**11
        return big.astype(np.int64)
    out = np.empty(x.shape, object)
    out[:] = [[int(np.floor(c)) * SCALE if not np.isfinite(SCALE * c) else int(np.floor(SCALE * c)) for c in row] for row in x.tolist()]
    return out


@dataclass
class Shard:
    """Rows of a shard: weights by term, and each term's postings, rows in ascending order of weight."""

    by_term: np.ndarray
    order: np.ndarray
    sorted_: np.ndarray
    #: Places in the postings, counted from either end, at which a traversal may stop.
    depths: np.ndarray

    @classmethod
    def of(cls, m: np.ndarray) -> Shard:
        by_term = np.ascontiguousarray(m.T)
        order = np.argsort(by_term, axis=1, kind="stable")
        depths = np.unique(np.linspace(0, m.shape[0], DEPTHS + 1).astype(int)[1:])
        return cls(by_term, order, np.take_along_axis(by_term, order, 1), depths)

    def candidates(self, query: np.ndarray, threshold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(essential terms, non-essential terms by falling bounds, rows seen in essential postings)."""
        terms, n = self.by_term.shape
        high = np.maximum(query * self.sorted_[:, 0], query * self.sorted_[:, -1]) if n and terms else np.zeros(terms, self.by_term.dtype)
        low = np.minimum(query * self.sorted_[:, 0], query * self.sorted_[:, -1]) if n and terms else high
        rank = np.argsort(high - low, kind="stable")
        everything = (rank[::-1], rank[:0], np.arange(n))
        if threshold is None or not n or not terms:
            return everything
        # what a row still unseen at each depth can have of each term
        at = np.minimum(self.depths, n - 1)
        left = np.where((query > 0)[:, None], query[:, None] * self.sorted_[:, n - 1 - at], query[:, None] * self.sorted_[:, at])
        left[:, self.depths >= n] = low[:, None]
        best, choice = n * terms, None
        for apart in range(0, terms, max(1, terms // 8)):
            free, own = rank[:apart], rank[apart:]
            reach = high[free].sum() + left[own].sum(0)
            fits = np.flatnonzero((reach < threshold) & (self.depths < n))
            if len(fits) and self.depths[fits[0]] * len(own) < best:
                best, choice = self.depths[fits[0]] * len(own), (own[::-1], free[::-1], int(self.depths[fits[0]]))
        if choice is None:
            return everything
        own, free, depth = choice
        up, down = own[query[own] > 0], own[query[own] <= 0]
        seen = np.zeros(n, bool)
        seen[self.order[up, n - depth :]] = True
        seen[self.order[down, :depth]] = True
        return own, free, np.flatnonzero(seen)


def search(query: np.ndarray, own: int, shard: Shard, uids: np.ndarray, ids: np.ndarray, threshold: int | None, k: int = K) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard for one query, ties to the smaller id, of those at the threshold or above."""
    essential, others, rows = shard.candidates(query, threshold)
    rows = rows[uids[rows] != own]
    if not len(rows):
        return []
    by_term = shard.by_term
    bound = np.maximum(query * shard.sorted_[:, 0], query * shard.sorted_[:, -1])
    floor = np.minimum(query * shard.sorted_[:, 0], query * shard.sorted_[:, -1])
    add = lambda t, r: query[t] @ by_term[np.ix_(t, r)] if by_term.dtype != object else sum((query[i] * by_term[i, r] for i in t), np.zeros(len(r), object))
    score = np.zeros(len(rows), by_term.dtype)
    order = np.concatenate((essential, others))
    for at in range(0, len(order), STEP):
        terms, rest = order[at : at + STEP], order[at + STEP :]
        score = score + add(terms, rows)
        if len(rows) > k:
            # k rows surely reach the k-th best partial score plus the least the rest can add
            reached = np.partition(score, len(score) - k)[len(score) - k] + floor[rest].sum()
            threshold = reached if threshold is None else max(reached, threshold)
        if threshold is not None:
            alive = score + bound[rest].sum() >= threshold
            rows, score = rows[alive], score[alive]
    best = np.lexsort((ids[rows], -score))[:k]
    return [(int(score[i]), int(ids[rows[i]])) for i in best]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group to one packed row per group: uids, ids, thresholds, the vectors' lengths and their components as doubles."""
    key, uids, ids, least, vecs = None, [], [], [], []

    def out() -> pa.RecordBatch:
        flat = np.concatenate([np.zeros(0), *vecs])
        row = {"g": key, "uids": np.array(uids, "<i8").tobytes(), "ids": np.array(ids, "<i8").tobytes(), "least": least, "n": np.array([len(v) for v in vecs], "<i4").tobytes(), "x": flat.astype("<f8").tobytes()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("g", pa.int64()), ("uids", pa.binary()), ("ids", pa.binary()), ("least", pa.list_(pa.int64())), ("n", pa.binary()), ("x", pa.binary())]))

    for b in batches:
        for g, u, i, t, v in zip(*(b.column(c).to_pylist() for c in ("g", "uid", "vec_id", "least", "v"))):
            if g != key and ids:
                yield out()
                uids, ids, least, vecs = [], [], [], []
            key = g
            uids.append(u)
            ids.append(i)
            least.append(t)
            vecs.append(np.array(v, float))
    if ids:
        yield out()


PACKED = "g long, uids binary, ids binary, least array<long>, n binary, x binary"


def _load(n: bytes, x: bytes) -> np.ndarray:
    cuts = np.cumsum(np.frombuffer(n, "<i4"))[:-1]
    return quantise(np.split(np.frombuffer(x, "<f8"), cuts))


def _match(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m, q = _load(r["n"], r["x"]), _load(r["qn"], r["qx"])
                uids, ids, quids, qids = (np.frombuffer(r[c], "<i8") for c in ("uids", "ids", "quids", "qids"))
                width = max(m.shape[1], q.shape[1])
                kind = object if object in (m.dtype, q.dtype) else np.int64
                grow = lambda a: np.concatenate((a.astype(kind), np.zeros((len(a), width - a.shape[1]), kind)), 1)
                shard, q = Shard.of(grow(m)), grow(q)
                hold = lambda s: max(INT64[0], min(INT64[1], s))
                rows = [(int(u), int(i), j, hold(s)) for u, i, t, v in zip(quids, qids, r["qleast"], q) for s, j in search(v, int(u), shard, uids, ids, t, k)]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["quid", "query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row of ``vectors`` (vec_id, embedding) that is a query."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), bad.alias("bad"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL AND NOT bad").drop("bad").withColumns({"uid": F.monotonically_increasing_id(), "least": F.lit(None).cast("long")})
    rows = materialise(rows, "topk-vectors")

    def packed(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        groups = max(1, -(-df.count() // size))
        dealt = df.select(F.pmod(F.xxhash64("uid", "vec_id"), F.lit(groups)).alias("g"), "uid", "vec_id", "least", "v")
        return dealt.repartition("g").sortWithinPartitions("g", "vec_id", "uid").mapInArrow(_pack, PACKED), groups

    def met(shards: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
        # a stated query set against all rows, in blocks: each shard goes to each block of queries
        # and each block to as many lanes as there are partitions, so that its shards do not meet in one task
        lanes = shuffle_partitions(vectors.sparkSession)
        count = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
        dealt = shards.withColumn("block", count(n)).withColumn("lane", F.pmod("g", F.lit(lanes)))
        blocks = blocks.select(F.col("g").alias("block"), *(F.col(c).alias(f"q{c}") for c in ("uids", "ids", "least", "n", "x"))).withColumn("lane", count(lanes))
        # merged: what a side is thought to have does not count its copies, so by size it would be broadcast, lanes times over
        return dealt.join(blocks.hint("merge"), ["block", "lane"]).mapInArrow(_match(k), "quid long, query_id long, vec_id long, score long")

    queries = rows.filter("asks")
    blocks, n = packed(queries, BLOCK)
    seeds, _ = packed(rows.orderBy(F.xxhash64("vec_id"), "uid").limit(SEEDS), SHARD)
    # the k-th best score over the seeds, where there are k: what every shard starts from. A held score is a
    # bound as well, from below or (then of no use, but true) the largest there is.
    first = _best(met(seeds, blocks, n), k).filter(F.col("rank") == k).select(F.col("quid").alias("uid"), F.col("score").alias("first"))
    blocks, n = packed(queries.join(materialise(first, "topk-thresholds").hint("merge"), "uid", "left").withColumn("least", F.col("first")), BLOCK)
    shards, _ = packed(rows, SHARD)
    return _best(met(shards, blocks, n), k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES: dict[str, Query] = {"op9_exact_topk": op9_exact_topk}
ORACLE: dict[str, str] = {
    "op9_exact_topk": f"""
WITH one AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, vec_id, list_transform(v, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM one),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id,
         CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % {EVERY} = 0 AND a.r <> b.r),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM t WHERE n <= {K}"""
}
