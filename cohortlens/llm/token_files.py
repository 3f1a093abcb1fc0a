"""Token ids in files of fixed-width packed bits.

A file holds whole documents in order: a header, the documents' ids and token
counts, the byte offsets of its blocks, then the blocks. A block is BLOCK ids
(the last may hold fewer), each in the fewest bits that hold the vocabulary,
padded to a whole byte; so any range of ids is read from the blocks it touches
and unpacked with numpy alone.

Executors write each file under a name of the attempt and move it into place,
so a task that runs again leaves the same file. Files are numbered by range
partition and sequence; the manifest is a written table.

Defined cases
- null, empty or blank text: the end id alone.
- null doc_id: such documents stand first, and come back with a null id.
- rows with equal doc_id: in the order of their texts' hashes, each with ids of
  its own; equal rows are kept.
- empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from ._common import Query, materialise, read, shared_dir, shuffle_partitions

MAGIC = b"CLBITS01"
HEADER = struct.Struct("<8sIIQQQ")  # magic, bits, ids a block, documents, ids, blocks
BLOCK = 1 << 16
#: Ids after which a task begins another file.
FILE_IDS = 1 << 24
END_ID = 2


def bit_width(vocabulary: int) -> int:
    """Fewest bits for ids 0..vocabulary-1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids (uint32) in ``bits`` bits each, least significant first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The n ids of packed data, as little-endian uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as tasks open it; Hadoop's names of S3 are Arrow's one."""
    scheme, mark, rest = path.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        path = f"s3://{rest}"
    try:
        return pafs.FileSystem.from_uri(path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"token files can't be kept under {path}: {e}") from e


class Writer:
    """Writes one file; ``close`` moves it into place."""

    def __init__(self, bits: int) -> None:
        self.bits, self.ids, self.nulls, self.counts = bits, [], [], []
        self.blocks: list[bytes] = []
        self.rest = np.zeros(0, "<u4")
        self.n = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        ids = np.frombuffer(data, "<u4")
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.n += len(ids)
        self.rest = np.concatenate((self.rest, ids))
        while len(self.rest) >= BLOCK:
            self.blocks.append(pack(self.rest[:BLOCK], self.bits))
            self.rest = self.rest[BLOCK:]

    def close(self, path: str, attempt: str) -> None:
        if len(self.rest):
            self.blocks.append(pack(self.rest, self.bits))
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in self.blocks]))).astype("<u8")
        fs, place = _open(path)
        folder, _, name = place.rpartition("/")
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/_{attempt}-{name}") as out:
            out.write(HEADER.pack(MAGIC, self.bits, BLOCK, len(self.ids), self.n, len(self.blocks)))
            out.write(np.array(self.ids, "<i8").tobytes())
            out.write(np.array(self.nulls, np.uint8).tobytes())
            out.write(np.array(self.counts, "<u8").tobytes())
            out.write(offsets.tobytes())
            for b in self.blocks:
                out.write(b)
        fs.move(f"{folder}/_{attempt}-{name}", place)


class Reader:
    """Random access to one file."""

    def __init__(self, path: str) -> None:
        fs, place = _open(path)
        self.file = fs.open_input_file(place)
        magic, self.bits, self.block, docs, self.n, blocks = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a file of packed ids")
        self.ids = np.frombuffer(self.file.read(8 * docs), "<i8")
        self.nulls = np.frombuffer(self.file.read(docs), np.uint8).astype(bool)
        counts = np.frombuffer(self.file.read(8 * docs), "<u8").astype(np.int64)
        self.starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        self.offsets = np.frombuffer(self.file.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.base = HEADER.size + 17 * docs + 8 * (blocks + 1)
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.file.seek(self.base + int(self.offsets[k]))
            data = self.file.read(int(self.offsets[k + 1] - self.offsets[k]))
            self.held = (k, unpack(data, min(self.block, self.n - k * self.block), self.bits))
        return self.held[1]

    def pieces(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids start..stop-1, block by block."""
        while start < stop:
            k = start // self.block
            end = min(stop, (k + 1) * self.block)
            yield self._block(k)[start - k * self.block : end - k * self.block]
            start = end

    def document(self, i: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *self.pieces(int(self.starts[i]), int(self.starts[i + 1]))])

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, end_id: int = END_ID, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """Encodes docs in ascending doc_id order into files of ``folder``; returns the manifest.

    Manifest: part, seq, path, n_docs, n_tokens, start (ids in all files before).
    """
    spark = docs.sparkSession
    bits = bit_width(tokens.vocabulary_size(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt, seq = task.partitionId(), f"{task.taskAttemptId()}", 0
        writer, rows = Writer(bits), []

        def done() -> None:
            path = f"{folder}/part-{part:07d}-{seq:05d}.tok"
            writer.close(path, attempt)
            rows.append((part, seq, path, len(writer.ids), writer.n))

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                writer.add(doc_id, tokens.encode(text, end_id, tokenizer))
                if writer.n >= FILE_IDS:
                    done()
                    writer, seq = Writer(bits), seq + 1
        if writer.ids:
            done()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "path", "n_docs", "n_tokens"), r)) for r in rows], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("_t"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "_t").sortWithinPartitions("doc_id", "_t")
    files = materialise(dealt.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long"), "token-manifest")
    # one row a file: the running sum is over the manifest alone
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                r = Reader(path)
                for lo in range(0, len(r.ids), 20_000):
                    hi = min(lo + 20_000, len(r.ids))
                    crc = []
                    for i in range(lo, hi):
                        c = 0
                        for ids in r.pieces(int(r.starts[i]), int(r.starts[i + 1])):
                            c = zlib.crc32(ids.tobytes(), c)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.ids[lo:hi], pa.int64(), mask=r.nulls[lo:hi]), pa.array(start + r.starts[lo:hi]), pa.array(np.diff(r.starts[lo : hi + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                r.close()

    dealt = manifest.select("path", "start").repartition(shuffle_partitions(manifest.sparkSession))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write(read(spark, sf_dir, "documents"), shared_dir(spark, "tokens")))


QUERIES: dict[str, Query] = {"op3_token_files": op3_token_files}
ORACLE: dict[str, str] = {}
