"""Delimited text inside zip files, read as a stream: whole lines, also of an archive that was cut off."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mounted

#: The local file header of a zip archive, its mark, and the flag for sizes that follow the data.
HEADER, MARK, SIZES_FOLLOW = struct.Struct("<4sHHHHHIIIHH"), b"PK\x03\x04", 8
STORED, DEFLATED = 0, 8
STEP, ROWS = 1 << 18, 4096


def members(f: BinaryIO) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(name, parts of its content) of each member in the order of the file; each is read to its end before the next.

    Ends without an error where the file ends or its compressed data breaks off. Nothing
    but a part is held, and the directory at the archive's end is not needed.
    """
    held = b""

    def need(n: int) -> bool:
        nonlocal held
        while len(held) < n and (more := f.read(STEP)):
            held += more
        return len(held) >= n

    while need(HEADER.size) and held[:4] == MARK:
        _, _, flags, method, _, _, _, size, _, n_name, n_extra = HEADER.unpack(held[: HEADER.size])
        if not need(HEADER.size + n_name + n_extra):
            return
        name = held[HEADER.size : HEADER.size + n_name].decode("utf-8", errors="replace")
        held = held[HEADER.size + n_name + n_extra :]
        if method not in (STORED, DEFLATED) or (method == STORED and flags & SIZES_FOLLOW):
            raise ValueError(f"member {name!r} is neither stored nor deflated")

        def content(method=method, size=size) -> Iterator[bytes]:
            nonlocal held
            if method == STORED:
                while size > 0 and need(1):
                    part, held = held[:size], held[size:]
                    size -= len(part)
                    yield part
                return
            inflate = zlib.decompressobj(-15)
            while not inflate.eof and need(1):
                given, held = held, b""
                while given and not inflate.eof:
                    try:
                        part = inflate.decompress(given, STEP)
                    except zlib.error:
                        return
                    given = inflate.unconsumed_tail
                    if part:
                        yield part
                held = inflate.unused_data

        parts = content()
        yield name, parts
        for _ in parts:  # what its reader left
            pass
        if flags & SIZES_FOLLOW and need(16):
            held = held[16 if held[:4] == b"PK\x07\x08" else 12 :]


def lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole lines without their ends; what follows the last line end is left out, as it may be cut."""
    rest = b""
    for p in parts:
        *whole, rest = (rest + p).split(b"\n")
        yield from whole


def read_tsv_in_zip(spark: SparkSession, path: str, columns: list[str], member: str = ".*", separator: str = "\t") -> DataFrame:
    """(file, member, line, columns...) of all archives below ``path`` whose members' names match the pattern ``member``.

    Lines of another number of fields are left out, as are those that an archive's cut
    end leaves unfinished; bytes that are no UTF-8 are replaced; ``line`` counts from 0. A
    column that holds JSON is parsed by ``from_json`` after. Archives are dealt over the
    tasks, each read as a stream from a mounted file system.
    """
    import re

    fits, mark, n = re.compile(member), separator.encode(), len(columns)
    names = ["file", "member", "line", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for file in b.column("path").to_pylist():
                with open(mounted(file), "rb") as f:
                    for name, parts in members(f):
                        if not fits.fullmatch(name):
                            continue
                        rows = []
                        for at, line in enumerate(lines(parts)):
                            fields = line.removesuffix(b"\r").split(mark)
                            if len(fields) == n:
                                rows.append((file, name, at, *(x.decode("utf-8", errors="replace") for x in fields)))
                            if len(rows) == ROWS:
                                yield batch(rows)
                                rows = []
                        if rows:
                            yield batch(rows)

    # the names alone are read here, not the contents
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")
    spread = files.repartition(F.col("path"))
    return spread.mapInArrow(run, "file string, member string, line long, " + ", ".join(f"`{c}` string" for c in columns))
