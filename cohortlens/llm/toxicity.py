"""Toxicity: a factorization machine over hashed terms.

logit = b + sum of w_t + a^2 * sum over pairs of <v_s, v_t> (x_s - p_s) (x_t - p_t)

over the distinct terms of a text: x_t is 1 if it holds t, p_t the share of the
sample's texts that do, and a^2 = LENGTH / number of terms, at most 1, so that
the many pairs of a long text weigh no more than those of a short one. As pairs
are of centred terms, what a term says alone stays in w_t; an insult beside a
group mention, or two terms that are neutral apart, goes into v. All terms have
factors, trained together with the weights from the first step: w by AdaGrad
under an L1 threshold, v by plain descent under L2, which lets only pairs grow
that explain more than chance would.

Terms are lower-cased letter runs and their first letters (inflected words share
them), hashed to BUCKETS. The model is fitted on a bounded sample of labelled
rows (documented by MAX_POSITIVE and MAX_NEGATIVE; the labels' proportion is put
right by the bias) and is the one thing that goes to every executor: BUCKETS x
(3 + RANK) numbers.

Defined cases
- null, empty or blank text: no terms; the score is that of an empty set.
- terms the sample holds in fewer than LEAST documents weigh nothing.
- null doc_id: never labelled; held_out is false. Equal rows score alike.
- null label, or a label for no document: not used. A document with two labels is used twice.
- no usable labels, or of one kind only: the score is the share of label 1 (0.5 if none).
- empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Query, read

BUCKETS, RANK, LEAST = 1 << 18, 4, 3
#: Labelled rows of each kind that the model is fitted on: the first by hash of the id.
MAX_POSITIVE, MAX_NEGATIVE = 2500, 5000
EPOCHS, BATCH, RATE, L1 = 16, 128, 0.3, 0.03
#: Of the factors: their spread at the start, step and shrinkage; and the number of terms up to which pairs count in full.
SPREAD, PAIR_RATE, L2, LENGTH = 0.1, 1.0, 0.003, 32
#: Length of the word beginnings that are terms too.
PREFIX = 5
THRESHOLD = 0.3
#: Texts that are scored at once.
SCORED = 256
FOLDS, HELD_OUT = 4, 2
_TERM = re.compile(rb"[a-z\x80-\xff]+")


@lru_cache(maxsize=200_000)
def _buckets(word: bytes) -> tuple[int, ...]:
    own = zlib.crc32(word) % BUCKETS
    if len(word) <= PREFIX:
        return (own,)
    return own, zlib.crc32(b"^" + word.decode(errors="ignore")[:PREFIX].encode()) % BUCKETS


def terms(text: str | None) -> np.ndarray:
    """The sorted distinct buckets of a text's terms."""
    found = set(_TERM.findall(text.encode().lower())) if text else ()
    return np.array(sorted(set(chain.from_iterable(map(_buckets, found)))), np.int32)


@dataclass
class Model:
    """``known``: buckets of terms with a weight; ``u`` and ``k``: what centring adds to pairs."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    k: float = 0.0
    known: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, bool))

    def pairs(self, rows: list[np.ndarray]) -> np.ndarray:
        """What pairs add to the logit of each row."""
        return self._parts(rows)[1]

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        linear, pairs = self._parts(rows)
        return self.bias + linear + pairs

    def _parts(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([np.zeros(0, np.int32), *rows])
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = self.known[x]
        x, of, n = x[at], of[at], len(rows)
        sums = lambda weight: np.bincount(of, weight, n)
        scale = LENGTH / np.maximum(np.bincount(of, minlength=n), LENGTH)
        square = sum(sums(self.v[x, f]) ** 2 for f in range(self.v.shape[1]))
        return sums(self.w[x]), scale * (0.5 * square + sums(self.u[x]) + self.k)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -500, 500)))


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float, seed: int = 7, rank: int = RANK) -> Model:
    """Logistic loss over all terms' weights and factors; ``share``: label 1 among all labelled rows; rank 0 is the linear model."""
    n, ones = len(rows), int(labels.sum())
    if not n or ones in (0, n):
        p = min(1 - 1e-6, max(1e-6, share))
        return Model(float(np.log(p / (1 - p))), np.zeros(BUCKETS), np.zeros((BUCKETS, rank)), np.zeros(BUCKETS))
    df = np.bincount(np.concatenate(rows).astype(np.int64), minlength=BUCKETS)
    known = df >= LEAST
    place = np.cumsum(known) - 1
    rows = [place[x[known[x]]] for x in rows]
    size = np.array([len(x) for x in rows])
    begin, flat, t = np.concatenate(([0], np.cumsum(size))), np.concatenate(rows), int(known.sum())
    p = df[known] / n
    off, square, scale = 1 - 2 * p, p * p, LENGTH / np.maximum(size, LENGTH)
    rng = np.random.default_rng(seed)
    w, gw, gb, bias, v = np.zeros(t), np.full(t, 0.1), 1.0, float(np.log(ones / (n - ones))), rng.normal(0, SPREAD, (rank, t))
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            pick = order[at : at + BATCH]
            k = len(pick)
            x = np.concatenate([flat[begin[i] : begin[i + 1]] for i in pick])
            row = np.repeat(np.arange(k), size[pick])
            logit = bias + np.bincount(row, w[x], k)
            if rank:
                s = np.stack([np.bincount(row, f[x], k) for f in v]) - (v @ p)[:, None]
                norm = (v * v).sum(0)
                logit += 0.5 * scale[pick] * ((s * s).sum(0) - np.bincount(row, (norm * off)[x], k) - norm @ square)
            g = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]
            dw, count = np.bincount(x, g[row], t), np.bincount(x, minlength=t)
            gw += dw * dw
            step = RATE / np.sqrt(gw)
            moved = w - step * dw
            w = np.where(count > 0, np.sign(moved) * np.maximum(np.abs(moved) - step * L1 * count, 0), w)
            if rank:
                g2 = g * scale[pick]
                each, whole, total = np.bincount(x, g2[row], t), s @ g2, g2.sum()
                for f in range(rank):
                    dv = np.bincount(x, (g2 * s[f])[row], t) - p * whole[f] - v[f] * (each * off + total * square)
                    v[f] -= PAIR_RATE * (dv / k + L2 * v[f])
            gb += g.sum() ** 2
            bias -= RATE / np.sqrt(gb) * g.sum()
    centre, norm = v @ p, (v * v).sum(0)
    out_w, out_v, out_u = np.zeros(BUCKETS), np.zeros((BUCKETS, rank)), np.zeros(BUCKETS)
    out_w[known], out_v[known], out_u[known] = w, v.T, -(centre @ v) - 0.5 * norm * off
    true, seen = share / (1 - share), ones / (n - ones)
    bias += float(np.log(true / seen)) if 0 < share < 1 else 0.0
    return Model(bias, out_w, out_v, out_u, float(0.5 * (centre @ centre - norm @ square)), known)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fits the model on the training folds' labelled rows."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("y"))
    known = known.filter(~held_out())
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # taken from the least hash on: at most MAX_POSITIVE + MAX_NEGATIVE ids, so they may be broadcast
    pick = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(pick[0].union(pick[1])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([terms(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "y", "x"])

    found = sample.mapInArrow(run, "doc_id long, y int, x array<int>").toArrow()
    rows = [np.array(x, np.int32) for x in found.column("x").to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: (found.column("doc_id")[i].as_py(), found.column("y")[i].as_py(), rows[i].tolist()))
    total = sum(counts.values())
    return fit([rows[i] for i in order], np.array(found.column("y").to_pylist(), float)[order], counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, *(x.astype(np.float32) for x in (model.w, model.v, model.u)), model.k, model.known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            scores = [np.zeros(0)]
            for at in range(0, len(b), SCORED):
                scores.append(m.scores([terms(t) for t in b.column("text").slice(at, SCORED).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.concatenate(scores), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held_out().alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
