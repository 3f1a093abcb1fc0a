"""A sink for people to read: pretty JSON with texts as lists of lines, archives of what it replaces, quarantine of failed rows.

``df.write.format("pretty_json").mode("overwrite").save(path)`` writes one JSON list a
task, below ``path``. Tasks write into a hidden folder; only when all have ended are the
files moved in place, so a failing job leaves what was there before. Files that are
replaced go to ``path/_archive/<time>`` first.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import mounted

#: Fields whose texts of several lines are written as lists of lines.
LINE_FIELDS = ("text", "raw_text", "trace", "prompt_text", "response_text")


def readable(value: object) -> object:
    """Rows and maps as objects; the line fields among them as lists of lines where they have several."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): v.split("\n") if k in LINE_FIELDS and isinstance(v, str) and "\n" in v else readable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [readable(v) for v in value]
    if isinstance(value, (date, datetime, Decimal)):
        return str(value)
    return value.decode("utf-8", errors="replace") if isinstance(value, (bytes, bytearray)) else value


def joined(value: object) -> object:
    """Undoes ``readable``: lists of lines become texts again."""
    if isinstance(value, dict):
        return {k: "\n".join(v) if k in LINE_FIELDS and isinstance(v, list) and all(isinstance(x, str) for x in v) else joined(v) for k, v in value.items()}
    return [joined(v) for v in value] if isinstance(value, list) else value


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = mounted(path), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        hidden = f"{self.path}/_job-{self.job}"
        os.makedirs(hidden, exist_ok=True)
        context = TaskContext.get()
        # an attempt writes a file of its own; the one that ends is the one that counts
        path, n = f"{hidden}/part-{context.partitionId():05d}-{context.taskAttemptId()}.json", 0
        with open(path, "w", encoding="utf-8") as f:
            for row in iterator:
                text = json.dumps(readable(row), indent=4, ensure_ascii=False)
                f.write(("[\n" if n == 0 else ",\n") + "\n".join("    " + line for line in text.split("\n")))
                n += 1
            f.write("\n]\n" if n else "[]\n")
        return Part(path, n)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.path)
        old = _parts(self.path)
        if self.overwrite and old:
            archive(self.path)
        name = "" if self.overwrite else f"{self.job}-"
        for i, m in enumerate(parts):
            os.replace(m.path, f"{self.path}/part-{name}{i:05d}.json")
        self.abort([])

    def abort(self, messages: list[Part | None]) -> None:
        hidden = f"{self.path}/_job-{self.job}"
        if os.path.isdir(hidden):
            for f in os.listdir(hidden):
                os.unlink(f"{hidden}/{f}")
            os.rmdir(hidden)


class PrettyJson(DataSource):
    """Registered by ``register``; option path, modes overwrite and append."""

    @classmethod
    def name(cls) -> str:
        return "pretty_json"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PrettyJson)


def write_pretty(df: DataFrame, path: str, append: bool = False) -> None:
    register(df.sparkSession)
    df.write.format("pretty_json").mode("append" if append else "overwrite").option("path", path).save()


def read_pretty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder that ``write_pretty`` wrote, a file a task, with their texts whole again."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.json").load(path)
    whole = F.udf(lambda raw: json.dumps(joined(json.loads(bytes(raw).decode()))), "string")
    return files.select(F.explode(F.from_json(whole("content"), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _parts(path: str) -> list[str]:
    return sorted(f for f in os.listdir(path) if f.startswith("part-")) if os.path.isdir(path) else []


def archive(path: str) -> str | None:
    """Moves the files of a folder into a dated folder below it; where they went. Nothing there: None."""
    path = mounted(path)
    files = _parts(path)
    if not files:
        return None
    to = f"{path}/_archive/{time.strftime('%Y%m%d_%H%M%S')}-{uuid.uuid4().hex[:6]}"
    os.makedirs(to)
    for f in files:
        os.replace(f"{path}/{f}", f"{to}/{f}")
    return to


def quarantine(rows: DataFrame, failed: str, path: str) -> DataFrame:
    """Writes the rows of which ``failed`` (SQL) holds to the quarantine folder and returns the others.

    The folder shows the last run alone: a run without failures removes it, one with
    failures replaces it. Rows of which nothing is known (null) count as failed.
    """
    bad = F.coalesce(F.expr(failed), F.lit(True))
    if rows.filter(bad).limit(1).count():
        write_pretty(rows.filter(bad), path)
    elif _parts(mounted(path)):
        archive(path)
    return rows.filter(~bad)
