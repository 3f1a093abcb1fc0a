"""Mixture-controlled packing: deficit round-robin over source queues.

Each target source is a queue of tokens. In every window of ``size`` tokens queue
s is owed size * weight; what rounding withholds is its deficit, carried to the
next window. As a queue's takings up to window k are a function of k alone, the
deficits carry over partitions too: each document finds its pieces by arithmetic
from its place in its queue. When a queue runs out, one window takes what it has
left, the others fill it, and the weights are shared anew. The last tokens go
into sequences of powers of two, so nothing is padded.

Defined cases
- null, empty or blank text: the end id alone is packed.
- null source, or one without a target: the queue "*".
- null doc_id: the row is packed and returned with a null id.
- equal rows are packed each. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from ._common import Query, gives_back, materialise, read

SIZE = 2048
END_ID = 1
REST = "*"
#: Target shares of tokens; sources not named share what "*" gets.
TARGETS = {"src0": 0.30, "src1": 0.15, "src2": 0.10, "src3": 0.05, REST: 0.40}
#: Weights are multiples of 1 / 2**SHIFT.
SHIFT = 16
#: Documents of a queue are kept in order by hash buckets of about so many rows.
BUCKET_ROWS = 2048


@dataclass
class Segment:
    """A stretch of one queue: ids lo..hi-1 of it go to sequences from ``sequence`` on.

    In the k-th of them the queue's ids begin at offset (k+1)*before - k*before, and
    (k*after) - (k*before) of its ids are in earlier ones; all rounded down, in size >> SHIFT units.
    ``fixed``: a single sequence in which the ids begin at this offset.
    """

    lo: int
    hi: int
    sequence: int
    before: int = 0
    after: int = 0
    fixed: int = -1


def integer_weights(weights: dict[str, float]) -> dict[str, int]:
    """Weights as multiples of 2**-SHIFT that sum to one, by largest remainders, at least one unit each."""
    total, units = sum(weights.values()), 1 << SHIFT
    exact = {q: w / total * units for q, w in weights.items()}
    out = {q: max(1, int(x)) for q, x in exact.items()}
    order = sorted(exact, key=lambda q: (int(exact[q]) - exact[q], q))
    for i in range(units - sum(out.values())):
        out[order[i % len(order)]] += 1
    while sum(out.values()) > units:
        out[max(out, key=lambda q: (out[q], q))] -= 1
    return out


def schedule(totals: dict[str, int], targets: dict[str, float], size: int = SIZE) -> dict[str, list[Segment]]:
    """For each queue with ids, which of its ids go where. Work grows with the queues, not with the ids."""
    left = {q: n for q, n in sorted(totals.items()) if n}
    used = dict.fromkeys(left, 0)
    out: dict[str, list[Segment]] = {q: [] for q in left}
    sequence = 0

    def single(take: dict[str, int]) -> None:
        nonlocal sequence
        offset = 0
        for q, n in take.items():
            if n:
                out[q].append(Segment(used[q], used[q] + n, sequence, fixed=offset))
                used[q] += n
                left[q] -= n
                offset += n
        sequence += 1

    while sum(left.values()) >= size:
        active = integer_weights({q: targets[q] for q, n in left.items() if n})
        edges = np.concatenate(([0], np.cumsum(list(active.values())))).tolist()
        at = lambda k, e: k * size * e >> SHIFT
        taken = lambda i, k: at(k, edges[i + 1]) - at(k, edges[i])
        windows = min(((left[q] + 1) << SHIFT) // (size * w) + 1 for q, w in active.items())
        while any(taken(i, windows) > left[q] for i, q in enumerate(active)):
            windows -= 1
        if windows:
            for i, q in enumerate(active):
                n = taken(i, windows)
                out[q].append(Segment(used[q], used[q] + n, sequence, edges[i], edges[i + 1]))
                used[q] += n
                left[q] -= n
            sequence += windows
        if sum(left.values()) >= size:
            take = {q: min(left[q], size * w >> SHIFT) for q, w in active.items()}
            for q in sorted(take, key=lambda q: (-active[q], q)):  # the others make up for what one lacks
                take[q] += min(left[q] - take[q], size - sum(take.values()))
            single(take)
    rest = sum(left.values())
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            room, take = 1 << bit, {}
            for q, n in left.items():
                take[q] = min(n, room)
                room -= take[q]
            single(take)
    return out


def cut(segments: list[Segment], lo: np.ndarray, hi: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """Pieces of the ranges lo..hi-1 of a queue: (row, first id in the queue, length, sequence, offset)."""
    parts = []
    for s in segments:
        row = np.flatnonzero((np.minimum(hi, s.hi) > np.maximum(lo, s.lo)))
        if not len(row):
            continue
        a, b = np.maximum(lo[row], s.lo) - s.lo, np.minimum(hi[row], s.hi) - s.lo
        if s.fixed >= 0:
            parts.append((row, a + s.lo, b - a, np.full(len(row), s.sequence), s.fixed + a))
            continue
        at = lambda k, e: k * size * e >> SHIFT
        taken = lambda k: at(k, s.after) - at(k, s.before)

        def window(x: np.ndarray) -> np.ndarray:
            """The last window k with taken(k) <= x."""
            k = (x << SHIFT) // (size * (s.after - s.before))
            while (over := taken(k) > x).any():
                k = k - over
            while (more := taken(k + 1) <= x).any():
                k = k + more
            return k

        k0, k1 = window(a), window(b - 1)
        n = k1 - k0 + 1
        row, a, b = (np.repeat(x, n) for x in (row, a, b))
        k = np.repeat(k0, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        first, last = np.maximum(a, taken(k)), np.minimum(b, taken(k + 1))
        offset = at(k + 1, s.before) - at(k, s.before) + first - taken(k)
        full = last > first
        parts.append(tuple(x[full] for x in (row, first + s.lo, last - first, s.sequence + k, offset)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts))


def in_queues(docs: DataFrame, targets: dict[str, float], rows: int) -> DataFrame:
    """docs with _q (its queue) and _b (a hash bucket within it); every queue spreads over as many buckets."""
    named = [q for q in targets if q != REST]
    buckets = max(16, -(-rows // BUCKET_ROWS))
    queue = F.when(F.col("source").isin(named), F.col("source")).otherwise(REST)
    return docs.withColumns({"_q": queue, "_b": F.pmod(F.xxhash64("doc_id", "_t"), F.lit(buckets))})


def starts(groups: DataFrame, amount: str) -> DataFrame:
    """(_q, _b, amount) with _start: the amount in the queue's buckets before."""
    before = Window.partitionBy("_q").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("_start", F.coalesce(F.sum(amount).over(before), F.lit(0)))


def _tokenised(docs: DataFrame, targets: dict[str, float], end_id: int, tokenizer: str) -> DataFrame:
    """_q, _b, doc_id, _at (ids before it in its bucket), n_tokens and ids (little-endian uint16 or uint32) of every row."""
    wide = "<u4" if tokens.vocabulary_size(tokenizer) > 1 << 16 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0
        for b in batches:
            n, begin, data = [], [], []
            for key, text in zip(zip(b.column("_q").to_pylist(), b.column("_b").to_pylist()), b.column("text").to_pylist()):
                if key != bucket:
                    bucket, at = key, 0
                ids = np.frombuffer(tokens.encode(text, end_id, tokenizer), "<u4")
                n.append(len(ids))
                begin.append(at)
                data.append(ids.astype(wide).tobytes())
                at += len(ids)
            yield pa.RecordBatch.from_arrays([b.column("_q"), b.column("_b"), b.column("doc_id"), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["_q", "_b", "doc_id", "_at", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("source"), F.xxhash64("text").alias("_t"))
    rows = in_queues(rows, targets, docs.count()).drop("source")
    dealt = rows.repartition("_q", "_b").sortWithinPartitions("_q", "_b", "doc_id", "_t")
    return materialise(dealt.mapInArrow(gives_back(run), "_q string, _b long, doc_id long, _at long, n_tokens long, ids binary"), "packing-ids")


def _in_order(docs: DataFrame, end_id: int, tokenizer: str) -> DataFrame:
    """The columns of ``_tokenised`` for one queue of all rows in file and row order; nothing is exchanged.

    A bucket is a run of one file's rows that a task reads one after the other: its name sorts by file, then row.
    """
    wide = "<u4" if tokens.vocabulary_size(tokenizer) > 1 << 16 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, at = (None, -1), "", 0
        for b in batches:
            names, n, begin, data = [], [], [], []
            for file, row, text in zip(*(b.column(c).to_pylist() for c in ("_f", "_r", "text"))):
                if (file, row - 1) != now:
                    part = re.match(r"part-(\d+)", file)
                    name, at = f"{int(part[1]) if part else 0:010d} {file} {row:020d}", 0
                now = (file, row)
                ids = np.frombuffer(tokens.encode(text, end_id, tokenizer), "<u4")
                names.append(name)
                n.append(len(ids))
                begin.append(at)
                data.append(ids.astype(wide).tobytes())
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([REST] * len(n), pa.string()), pa.array(names, pa.string()), b.column("doc_id"), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["_q", "_b", "doc_id", "_at", "n_tokens", "ids"])

    place = [F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_r")]
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    try:
        rows = docs.select(*columns, *place)
    except AnalysisException:  # not read from files: written, the rows keep their order
        rows = materialise(docs.select(*columns), "packing-rows").select(*columns, *place)
    return materialise(rows.mapInArrow(gives_back(run), "_q string, _b string, doc_id long, _at long, n_tokens long, ids binary"), "packing-ids")


def pack(docs: DataFrame, targets: dict[str, float] | None = None, size: int = SIZE, end_id: int = END_ID, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids (uint32 bytes), ids_crc32, doc_tokens, sequence_id, offset."""
    targets = TARGETS if targets is None else targets
    if REST not in targets or min(targets.values()) * size < 4:
        raise ValueError('targets need "*", and at least four tokens a window for each')
    return _pieces(_tokenised(docs, targets, end_id, tokenizer), targets, size, tokenizer)


def pack_in_order(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """As ``pack``, but of one queue in the file and row order of docs, which an earlier stage decided."""
    return _pieces(_in_order(docs, end_id, tokenizer), {REST: 1.0}, size, tokenizer)


def _pieces(ids: DataFrame, targets: dict[str, float], size: int, tokenizer: str) -> DataFrame:
    buckets = starts(ids.groupBy("_q", "_b").agg(F.sum("n_tokens").alias("_n")), "_n")
    totals = {r["_q"]: r["n"] for r in ids.groupBy("_q").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each target
    plan = schedule(totals, targets, size)
    wide = "<u4" if tokens.vocabulary_size(tokenizer) > 1 << 16 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            queue = np.array(b.column("_q").to_pylist(), object)
            lo = b.column("_at").to_numpy(zero_copy_only=False)
            n = b.column("n_tokens").to_numpy(zero_copy_only=False)
            data = b.column("ids")
            for q in set(queue):
                own = np.flatnonzero(queue == q)
                row, first, length, sequence, offset = cut(plan[q], lo[own], lo[own] + n[own], size)
                start = first - lo[own][row]
                pieces = []
                for i, s, m in zip(own[row].tolist(), start.tolist(), length.tolist()):
                    pieces.append(np.frombuffer(data[i].as_buffer(), wide)[s : s + m].astype("<u4").tobytes())
                crc = [zlib.crc32(p) for p in pieces]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(own[row])), pa.array(start), pa.array(length), pa.array(pieces, pa.binary()), pa.array(crc, pa.int64()), pa.array(n[own][row]), pa.array(sequence), pa.array(offset)],
                    ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    placed = ids.join(buckets.select("_q", "_b", "_start"), ["_q", "_b"]).select("_q", "doc_id", (F.col("_start") + F.col("_at")).alias("_at"), "n_tokens", "ids")
    return placed.mapInArrow(gives_back(run), "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("ids")


QUERIES: dict[str, Query] = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
