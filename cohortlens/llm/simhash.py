"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits are three segments (23, 23 and 18 bits). Two that differ
in at most two bits have one segment in common (pigeonhole), and the next
segment, at most two bits away, shares a Golay codeword index (see golay.py).
So each distinct fingerprint gets the keys (segment, next segment's indices);
equal keys are candidates, which the bits themselves verify. A key with many
fingerprints is split by further pigeonholes over its free bits, until groups
are small; nothing is capped. Components then come from rounds of min-label
hooking on written tables.

Defined cases
- null or blank text: no shingle, fingerprint zero, linked like any other.
- one or two words: the whole sequence is the one shingle.
- equal rows: equal fingerprints, one component; each row is returned.
- null doc_id: the row is returned; it never names a component unless all of
  the component's ids are null, and then component_id is null.
- an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from ._common import Query, gives_back, materialise, read

ERRORS = 2
SHINGLE, SEED = 3, 42
#: Fingerprints of one key that one task compares; larger groups are split first.
GROUP = 2048
SEGMENTS = ((41, 23), (18, 23), (0, 18))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of each shingle of a text, repeats included."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.array([], np.uint64)
    joined = b" ".join(w)
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    cut = map(slice, starts.tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(SEED)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and _t (a hash of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], ["doc_id", "fp", "_t"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("_t"))
    return rows.mapInArrow(gives_back(run), "doc_id long, fp long, _t long")


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[-1]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h ^= p.astype(np.uint64)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, free): free has a 1 for each bit that the key does not hold exactly."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
        for i, (at, n) in enumerate(SEGMENTS):
            row, index = golay.indices(seg[(i + 1) % 3])
            key = _mix(np.full(len(row), i), seg[i][row], index)
            free = np.full(len(row), np.uint64(~(((1 << n) - 1) << at) & (2**64 - 1)), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(free)], ["key", "fp", "free"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a large group by a further pigeonhole: ERRORS + 1 parts of the free bits, one of them equal in both."""
    for b in batches:
        key, fp, free = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for mask in np.unique(free):
            at = free == mask
            bits = [i for i in range(64) if int(mask) >> i & 1]
            for j in range(ERRORS + 1):
                part = np.uint64(sum(1 << i for i in bits[j :: ERRORS + 1]))
                f = fp[at].view(np.uint64)
                left = np.full(len(f), np.uint64(int(mask) & (2**64 - 1)) & ~part, np.uint64)
                k = _mix(key[at].view(np.uint64), np.full(len(f), j), f & part)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[at]), pa.array(left.view(np.int64))], ["key", "fp", "free"])


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _spanning(fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Verified links of one group, of them a spanning forest."""
    u = np.unique(fp).view(np.uint64)
    parent = np.arange(len(u))
    for i in range(len(u) - 1):
        near = np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= ERRORS) + i + 1
        for j in near:
            a, b = _root(parent, i), _root(parent, int(j))
            if a != b:
                parent[b] = a
                yield int(u[i].view(np.int64)), int(u[j].view(np.int64))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows sorted by key; a group that spans batches is carried over."""
    key_left, fp_left = np.array([], np.int64), np.array([], np.int64)

    def groups(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        many = np.flatnonzero(ends - starts > 1) if len(key) else []
        links = [x for g in many for x in _spanning(fp[starts[g] : ends[g]])]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    for b in batches:
        key = np.concatenate((key_left, b.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp_left, b.column(1).to_numpy(zero_copy_only=False)))
        whole = np.searchsorted(key, key[-1])
        yield groups(key[:whole], fp[:whole])
        key_left, fp_left = key[whole:], fp[whole:]
    yield groups(key_left, fp_left)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that span every component of the fingerprints (column fp, distinct)."""
    keyed = distinct.select("fp").mapInArrow(gives_back(_keys), "key long, fp long, free long")
    found = []
    while True:
        # only keys that two fingerprints share need to be looked at; sizes by map-side combined counts
        keyed = materialise(keyed, "simhash-keys")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        large = materialise(sizes.filter(F.col("n") > GROUP), "simhash-large")
        small = keyed.join(large, "key", "left_anti")
        found.append(small.repartition("key").sortWithinPartitions("key").mapInArrow(gives_back(_verify), "a long, b long"))
        if large.isEmpty():
            break
        keyed = keyed.join(large.select("key"), "key", "left_semi").mapInArrow(gives_back(_split), "key long, fp long, free long")
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge, by alternating star contraction."""

    def star(e: DataFrame) -> DataFrame:
        """Large star, then small star: each node points to the smallest of its neighbours."""
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a != b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        return down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()

    e = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while True:
        # stable once every node hangs on one root that hangs on none
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, e = state, materialise(star(e), "components", instead_of=e)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id and _t of every row of docs."""
    fps = materialise(fingerprints(docs, shingle), "simhash-fp")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct))
    label = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    label = materialise(label, "simhash-roots")
    small = label.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = label.join(small, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id", "_t")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
ORACLE: dict[str, str] = {}
