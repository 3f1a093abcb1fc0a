"""What the training-data operators share: tables, the shared folder, words."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side made of small fixed-width rows may be broadcast.
BROADCAST_ROWS = 50_000

#: Removes the shuffle files of a query when it ends, where Spark has the setting; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes that a Python worker may hold after a task without giving freed ones back.
HELD = 80_000_000

ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_own_dirs: list[tempfile.TemporaryDirectory] = []
_scratch: ContextVar[list[DataFrame] | None] = ContextVar("_scratch", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Where that setting is unset in a local session a temporary folder takes its
    place; it is removed when the process ends. On a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dirs:
            _own_dirs.append(tempfile.TemporaryDirectory(prefix="cohortlens-"))
        root = _own_dirs[0].name
    return f"{root.rstrip('/')}/cohortlens/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """The rows as a written table: cuts lineage, computes once, survives lost executors.

    What the query has shuffled goes as soon as its rows are written.
    ``instead_of``: a table written before that nothing needs any more; it is removed.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if (tables := _scratch.get()) is not None:
        tables.append(out)
    if instead_of is not None:
        remove(instead_of)
    return out


def remove(table: DataFrame) -> None:
    """Removes the files of a table that ``materialise`` has written; others stay."""
    if path := getattr(table, "_written", None):
        file_system(table.sparkSession, path).delete(hadoop_path(table.sparkSession, path), True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are removed at its end, but for those given to the function it yields."""
    tables: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = _scratch.set(tables)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _scratch.reset(token)
        outer = _scratch.get()
        for t in tables:
            if any(t is k for k in kept):
                if outer is not None:
                    outer.append(t)
            else:
                remove(t)


def give_back() -> None:
    """Returns the freed memory of a process that holds over HELD bytes to the system; the allocators would keep it."""
    with open("/proc/self/statm") as f:
        if int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") <= HELD:
            return
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def gives_back(run: ArrowMap) -> ArrowMap:
    """``run`` for mapInArrow, after whose tasks the worker, which stays for the next stages, holds no more than it uses."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            with suppress(OSError):  # no /proc here
                give_back()

    return whole


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that a path is in."""
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def join_small(df: DataFrame, small: DataFrame, on: list[str] | str, rows: int, how: str = "inner") -> DataFrame:
    """Join with a side of which ``rows`` is the known row count: broadcast only below BROADCAST_ROWS."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before them until df has no such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def words(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; bytes.split() cuts at exactly these six bytes."""
    return text.encode().split() if text else []


def segments(data: bytes, mark: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """The data in parts of about ``size`` bytes, each but the last ending with ``mark``, so that nothing between marks is cut."""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= size else data.rfind(mark, at, at + size) + 1 or data.find(mark, at + size) + 1 or len(data)
        yield data[at:end]
        at = end


Query = Callable[[SparkSession, str], DataFrame]
