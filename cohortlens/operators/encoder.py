"""Vectors of texts without a model: hashed words and word pairs, weighted, projected at random, and a store that grows.

A text's terms fall into BUCKETS places by md5; a place weighs (1 + ln tf) * idf, with
idf = ln((1 + texts) / (1 + texts that have it)) + 1; each place adds its weight, with a
sign, to SPREAD of the DIMENSIONS, chosen by md5; vectors have length one. Equal texts
are one text. A text's terms are counted and projected in its own row, in Arrow batches; only the
frequencies of the places are added up over texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..sources.shared import create, mounted, written

BUCKETS, DIMENSIONS, SPREAD = 1 << 16, 64, 4


def text_id(text: Column) -> Column:
    """Equal texts are one; null is the empty text."""
    return F.md5(F.coalesce(text, F.lit("")))


def _places(words: list[str], known: dict[str, int]) -> dict[int, int]:
    """bucket -> how often, of the words and pairs of neighbouring words; ``known`` saves digests, bounded."""
    out: dict[int, int] = {}
    for t in chain(words, (f"{a} {b}" for a, b in zip(words, words[1:]))):
        at = known.get(t)
        if at is None:
            if len(known) >= 1 << 18:
                known.clear()
            known[t] = at = int.from_bytes(hashlib.md5(t.encode()).digest()[:2], "big")
        out[at] = out.get(at, 0) + 1
    return out


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # so that few long texts are held at a time
            part = batch.slice(start, 256)
            found = [_places(w.split(), known) for w in part.column("w").to_pylist()]
            lists = [pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("text_id"), *lists], ["text_id", "bucket", "tf"])


def term_weights(texts: DataFrame) -> DataFrame:
    """(text_id, bucket, tf) of the distinct texts of ``text``, both arrays: a row a text, so its terms are never exchanged."""
    one = texts.select(text_id(F.col("text")).alias("text_id"), "text").dropDuplicates(["text_id"])
    return one.select("text_id", F.array_join(word_tokens(F.col("text")), " ").alias("w")).mapInArrow(_weigh, "text_id string, bucket array<int>, tf array<int>")


def inverse_frequencies(weights: DataFrame, n: int) -> DataFrame:
    """(bucket, df, idf): at most BUCKETS rows, added up within tasks first. ``n``: how many texts there are."""
    df = weights.select(F.explode("bucket").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)


def projection(idf: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the SPREAD dimensions it adds to, and with which sign and weight; nothing for unknown ones."""
    dim, weight = np.zeros((BUCKETS, SPREAD), np.int64), np.zeros((BUCKETS, SPREAD))
    for b, w in idf:
        for k in range(SPREAD):
            h = int(hashlib.md5(f"{b}:{k}".encode()).hexdigest()[:3], 16)
            dim[b, k], weight[b, k] = h % DIMENSIONS, -w if h >= 2048 else w
    return dim, weight


def vectors(weights: DataFrame, idf: DataFrame) -> DataFrame:
    """(text_id, v) of texts with terms; a bucket that ``idf`` doesn't know weighs nothing."""
    dim, weight = projection([(r["bucket"], r["idf"]) for r in idf.select("bucket", "idf").collect()])  # at most BUCKETS rows

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tf = 1 + np.log(part.column("tf").flatten().to_numpy())
                at = part.column("bucket").flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), part.column("tf").value_lengths().to_numpy()) * DIMENSIONS
                raw = sum(np.bincount(row + dim[at, k], tf * weight[at, k], part.num_rows * DIMENSIONS) for k in range(SPREAD)).reshape(-1, DIMENSIONS)
                norm = np.sqrt((raw * raw).sum(1))
                some = norm > 0
                flat = pa.array((raw[some] / norm[some, None]).ravel())
                v = pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1) * DIMENSIONS, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("text_id").filter(pa.array(some)), v], ["text_id", "v"])

    return weights.mapInArrow(project, "text_id string, v array<double>")


def encode(texts: DataFrame) -> DataFrame:
    """(text_id, v) of the distinct texts, weighted by their own frequencies."""
    weights = written(term_weights(texts), "term-weights")
    n = weights.count()
    return vectors(weights, inverse_frequencies(weights, n))


class VectorStore:
    """Vectors by text, in a folder: each text is encoded once, with the frequencies of the texts that came first.

    A delta is written whole and then named by a record that is created exclusively, so
    a writer that dies leaves nothing that is read; if two add the same text, their
    vectors are equal. The folder must be mounted, see ``sources.shared``.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _records(self) -> list[dict]:
        path = f"{mounted(self.folder)}/records"
        names = sorted(n for n in os.listdir(path) if n.endswith(".json")) if os.path.isdir(path) else []
        out = []
        for n in names:
            with open(f"{path}/{n}", "rb") as f:
                out.append(json.load(f))
        return out

    def vectors(self) -> DataFrame:
        """(text_id, v); v is null for texts without terms."""
        parts = [f"{self.folder}/{r['delta']}" for r in self._records()]
        if not parts:
            return self.spark.createDataFrame([], "text_id string, v array<double>")
        return self.spark.read.schema("text_id string, v array<double>").parquet(*parts).dropDuplicates(["text_id"])

    def add(self, texts: DataFrame) -> int:
        """Encodes the texts that the store lacks; how many."""
        one = texts.select(text_id(F.col("text")).alias("text_id"), "text").dropDuplicates(["text_id"])
        new = one.join(self.vectors().select("text_id"), "text_id", "left_anti")
        weights, records = written(term_weights(new), "term-weights"), self._records()
        os.makedirs(f"{mounted(self.folder)}/records", exist_ok=True)
        if records:
            model = records[0]["model"]
        else:
            model = f"model-{uuid.uuid4().hex}"
            inverse_frequencies(weights, weights.count()).write.parquet(f"{self.folder}/{model}")
        idf = self.spark.read.parquet(f"{self.folder}/{model}")
        delta = f"delta-{uuid.uuid4().hex}"
        weights.select("text_id").join(vectors(weights, idf), "text_id", "left").write.parquet(f"{self.folder}/{delta}")
        n = len(records)
        while not create(f"{mounted(self.folder)}/records/{n:08d}.json", json.dumps({"delta": delta, "model": model}).encode()):
            n += 1
            if self._records()[0]["model"] != model:  # another writer's frequencies came first: its own are the store's
                return self.add(texts)
        return self.spark.read.parquet(f"{self.folder}/{delta}").count()

    def embed(self, texts: DataFrame) -> DataFrame:
        """texts with v, from the store, after adding what it lacks."""
        self.add(texts)
        return texts.withColumn("_id", text_id(F.col("text"))).join(self.vectors().withColumnRenamed("text_id", "_id"), "_id", "left").drop("_id")
