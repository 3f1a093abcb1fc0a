"""Substring dedup: remove words covered by a window that also starts in a document with a smaller id.

By recompression (recompression.py). One scan names the symbols of every text
and lists, for each document, the high-level symbols that stand for its windows.
Symbols that two documents share reveal where repeats can be; only the windows
they stand for are hashed and grouped, and those groups verify the repeat with
96 bits of the window's own words. Windows without such a symbol (within long
runs, say) are always candidates, so no repeat is missed.

A window's smallest document is found first within each task, so that a passage
in a third of all documents leaves one row a task, and then over all tasks.

Defined cases
- null, empty or blank text: no words, nothing removed, hash of the empty string.
- documents shorter than the window: nothing removed.
- null doc_id: never smaller than any id; removed where an id has the window.
- rows with equal doc_id do not remove each other's words; equal rows are
  returned as often as they occur.
- empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import recompression as R
from ._common import Query, fresh, gives_back, materialise, read, scratch, shuffle_partitions, words

WINDOW = 50
#: Bytes of text that one numpy pass takes, and windows after which a task hands over what it has.
CHUNK, FLUSH = 2_000_000, 1_000_000
NONE = np.iinfo(np.int64).max
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _keyed(docs: DataFrame) -> DataFrame:
    """_i: the id, the largest number for none; _t: the text's hash; _k: both in one."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("_i"), F.col("text"), F.xxhash64("text").alias("_t"), F.xxhash64("doc_id", "text").alias("_k"))


def _chunks(ids: list, texts: list[bytes], counts: list[int]) -> Iterator[tuple[list, list[bytes], list[int]]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield ids[start:i], texts[start:i], counts[start:i]
            start, size = i, 0
        size += len(t)
    if size:
        yield ids[start:], texts[start:], counts[start:]


def _scan(window: int):
    """Per document: _k, _i, _t, n_words, sha256 of its words, the names that stand for its windows, and whether a window has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, shas, long, texts, counts = [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                w = words(text)
                joined = b" ".join(w)
                n_words.append(len(w))
                shas.append(hashlib.sha256(joined).digest())
                if len(w) >= window:
                    long.append(row)
                    texts.append(joined)
                    counts.append(len(w))
            names: list = [None] * len(n_words)
            opened = [False] * len(n_words)
            for rows, part, n in _chunks(long, texts, counts):
                w = R.hash_words(part, n)
                rep, has = R.representatives(w, window)
                for row, first, count in zip(rows, w.first.tolist(), n):
                    own, known = rep[first : first + count - window + 1], has[first : first + count - window + 1]
                    names[row] = np.unique(own[known]).view(np.int64)
                    opened[row] = not known.all()
            yield pa.RecordBatch.from_arrays(
                [b.column("_k"), b.column("_i"), b.column("_t"), pa.array(n_words, pa.int64()), pa.array(shas, pa.binary()), pa.array(names, pa.list_(pa.int64())), pa.array(opened)],
                ["_k", "_i", "_t", "n_words", "sha", "names", "opened"],
            )

    return run


def _windows(window: int, buckets: int):
    """Candidate windows of the documents, of equal ones the smallest document's, as one packed row per bucket.

    kind 0: windows to be looked up among all tasks; kind 1: windows already known to be repeats.
    """

    def pack(bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray, h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((pos, doc, bucket))
        bucket, doc, pos, h, g = (x[order] for x in (bucket, doc, pos, h, g))
        cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, int)
        rows = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            rows.append((int(bucket[s]), ids[doc[s:e]].astype("<i8").tobytes(), pos[s:e].astype("<u4").tobytes(), h[s:e].astype("<u8").tobytes(), g[s:e].astype("<u4").tobytes()))
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "docs", "pos", "h", "g"])

    def local(parts: list[tuple], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, doc, pos, h, g = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((g, h))
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        heads = np.flatnonzero(np.concatenate(([True], ~same)))
        who = ids[doc[order], 0]
        least = np.repeat(np.minimum.reduceat(who, heads), np.diff(np.concatenate((heads, [len(who)]))))
        known = np.zeros(len(h), bool)
        known[order] = who > least
        ask = np.flatnonzero(~known)
        if len(ask):
            yield pack(bucket[ask], doc[ask], pos[ask], h[ask], g[ask], ids)
        told = np.flatnonzero(known)
        if len(told):
            # dealt out by document; -1 - bucket marks them as answered
            to = -1 - (ids[doc[told], 2].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            yield pack(to, doc[told], pos[told], h[told] * np.uint64(0), g[told] * np.uint32(0), ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, ids = [], 0, []
        for b in batches:
            texts, counts, rows = [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                w = words(text)
                if len(w) >= window:
                    rows.append(row)
                    texts.append(b" ".join(w))
                    counts.append(len(w))
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("_i", "_t", "_k")], 1) if len(b) else np.zeros((0, 3), np.int64)
            shared = b.column("names").to_pylist()
            for part_rows, part, n in _chunks(rows, texts, counts):
                w = R.hash_words(part, n)
                rep, has = R.representatives(w, window)
                h, g = R.window_hashes(w, window)
                for row, first, count in zip(part_rows, w.first.tolist(), n):
                    span = slice(first, first + count - window + 1)
                    known = has[span]
                    at = np.flatnonzero(~known | np.isin(rep[span].view(np.int64), np.array(shared[row], np.int64)))
                    if not len(at):
                        continue
                    hh = h[span][at]
                    to = (R.mix(np.where(known[at], rep[span][at], hh), 11) % np.uint64(buckets)).astype(np.int64)
                    parts.append((to, np.full(len(at), len(ids)), at, hh, g[span][at]))
                    ids.append(keys[row])
                    held += len(at)
                    if held >= FLUSH:
                        yield from local(parts, np.array(ids))
                        parts, held, ids = [], 0, []
        if parts:
            yield from local(parts, np.array(ids))

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed rows sorted by bucket: (_k, _i, _t, spans) with the starts of repeated windows as (start, length) pairs."""

    def spans(ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        if len(pos):
            order = np.lexsort((pos, ids[:, 1], ids[:, 0], ids[:, 2]))
            ids, pos = ids[order], pos[order]
            other = (ids[1:] != ids[:-1]).any(1)
            heads = np.concatenate(([True], other | (np.diff(pos) > 1)))
            at = np.flatnonzero(heads)
            stop = pos[np.concatenate((at[1:], [len(pos)])) - 1]
            runs = np.stack((pos[at], stop - pos[at] + 1), 1).astype("<u4")
            owner = ids[at]
            cuts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]).any(1))))
            blobs = [runs[s:e].tobytes() for s, e in zip(cuts, np.concatenate((cuts[1:], [len(runs)])))]
            ids = owner[cuts]
        else:
            blobs = []
        return pa.RecordBatch.from_arrays([pa.array(ids[:, 2]), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(blobs, pa.binary())], ["_k", "_i", "_t", "spans"])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(r[1] for r in rows), "<i8").reshape(-1, 3)
        pos, h, g = (np.frombuffer(b"".join(r[i] for r in rows), t).astype(u) for i, t, u in ((2, "<u4", np.int64), (3, "<u8", np.uint64), (4, "<u4", np.uint32)))
        if rows[0][0] < 0:
            return spans(ids, pos)
        order = np.lexsort((g, h))
        hh, gg, who = h[order], g[order], ids[order, 0]
        heads = np.flatnonzero(np.concatenate(([True], (hh[1:] != hh[:-1]) | (gg[1:] != gg[:-1]))))
        least = np.repeat(np.minimum.reduceat(who, heads), np.diff(np.concatenate((heads, [len(who)]))))
        hit = order[who > least]
        return spans(ids[hit], pos[hit])

    rows: list[tuple] = []
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "docs", "pos", "h", "g"))):
            if rows and rows[0][0] != r[0]:
                yield solve(rows)
                rows = []
            rows.append(r)
    if rows:
        yield solve(rows)


def removed_words(spans: list[bytes], n: int, window: int) -> np.ndarray:
    """Which of a document's n words are covered by repeated windows."""
    runs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] + window - 1, -1)
    return np.cumsum(edge[:n]) > 0


def _repeats(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """keyed documents; per document its figures and ``copy`` (all its words stand in an earlier document); spans of repeats."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    scan = keyed.mapInArrow(gives_back(_scan(window)), "_k long, _i long, _t long, n_words long, sha binary, names array<long>, opened boolean")
    scan = materialise(scan, "substring-scan")
    # whole copies: the smallest id stands for all of them, so only it is searched
    first = scan.filter(F.col("n_words") >= window).groupBy("sha").agg(F.min("_i").alias("_first"))
    facts = scan.join(first, "sha", "left").withColumn("copy", F.coalesce(F.col("_i") > F.col("_first"), F.lit(False)))
    live = facts.filter((F.col("n_words") >= window) & ~F.col("copy"))
    names = live.select("_k", F.explode("names").alias("name"))
    shared = names.groupBy("name").agg(F.min("_k").alias("a"), F.max("_k").alias("b")).filter("a != b").select("name")
    by_doc = names.join(shared, "name").select("_k", "name").union(live.filter("opened").select("_k", F.lit(None).cast("long")))
    by_doc = by_doc.groupBy("_k").agg(F.collect_set("name").alias("names"))
    buckets = 8 * shuffle_partitions(spark)
    sent = keyed.join(by_doc.hint("shuffle_hash"), "_k").mapInArrow(gives_back(_windows(window, buckets)), "bucket int, docs binary, pos binary, h binary, g binary")
    spans = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gives_back(_answers), "_k long, _i long, _t long, spans binary")
    spans = spans.groupBy("_k", "_i", "_t").agg(F.collect_list("spans").alias("spans"))
    return keyed, facts.select("_k", "_i", "_t", "n_words", "sha", "copy"), spans


def removal_figures(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) of every row."""
    keyed, facts, spans = _repeats(docs, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha = [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                w = words(text)
                gone = removed_words(found, len(w), window)
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w[i] for i in np.flatnonzero(~gone).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_i"), b.column("_t"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["_k", "_i", "_t", "n_removed", "kept_sha256"])

    spans = spans.select("_k", F.col("_i").alias("_i2"), F.col("_t").alias("_t2"), "spans")
    part = keyed.join(spans.hint("shuffle_hash"), "_k").filter("_i = _i2 AND _t = _t2").select("_k", "_i", "_t", "text", "spans")
    part = part.mapInArrow(gives_back(cut), "_k long, _i long, _t long, n_removed long, kept_sha256 string").distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    rows = facts.join(part, ["_k", "_i", "_t"], "left")
    whole: Column = F.col("copy")
    return rows.select(
        F.when(F.col("_i") != NONE, F.col("_i")).alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut out of their texts, and without documents of which nothing is left.

    Untouched texts stay as they are; in others the words go with the white space
    after them. n_chars follows the text.
    """
    names = docs.columns
    key, copy, own, found, stays, was_cut = fresh(docs, "_key", "_copy", "_own", "_found", "_stays", "_was_cut")
    with scratch() as keep:
        _, facts, spans = _repeats(docs, window)
        facts = keep(materialise(facts.filter("copy").select(F.col("_k").alias(copy)).distinct(), "substring-copies"))
        spans = keep(materialise(spans, "substring-spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, runs in zip(b.column("text").to_pylist(), b.column(found).to_pylist()):
                if not runs:
                    out.append((text, True))
                    continue
                raw = text.encode()
                head = re.match(rb"[\x20\x09-\x0D]*", raw).group()
                w = _WORD.findall(raw)
                gone = removed_words(runs, len(w), window)
                out.append(((head + b"".join([w[i] for i in np.flatnonzero(~gone).tolist()])).decode(), not gone.all()))
            cols = [pa.array([x[0] for x in out], pa.string()) if c == "text" else b.column(c) for c in names]
            cols.append(pa.array([x[1] for x in out], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*cols, b.column(was_cut)], [*names, stays, was_cut])

    tagged = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    spans = spans.select(F.col("_k").alias(own), F.col("spans").alias(found))
    rows = tagged.join(facts.hint("shuffle_hash"), F.col(key) == F.col(copy), "left_anti").join(spans.hint("shuffle_hash"), F.col(key) == F.col(own), "left")
    rows = rows.select(*names, found, F.col(found).isNotNull().alias(was_cut))
    schema = StructType([*docs.schema.fields, StructField(stays, BooleanType()), StructField(was_cut, BooleanType())])
    out = rows.mapInArrow(gives_back(cut), schema).filter(F.col(stays))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(was_cut), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_figures(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {"op4_substring_dedup": op4_substring_dedup}
ORACLE: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
own AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, i + k AS p FROM win JOIN own USING (h), range(50) AS x(k) WHERE m < coalesce(doc_id, 9223372036854775807)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)"""
}
