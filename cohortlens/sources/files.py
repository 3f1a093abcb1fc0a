"""Sources and sinks: JSON, JSON lines, CSV, XML, caches, configuration."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import loads


def load_json(path: str | Path, default: object = None) -> object:
    """One JSON file: UTF-8, else Latin-1; a byte-order mark goes; empty or absent gives the default; mended only if strict reading fails."""
    p = Path(path)
    if not p.exists():
        return default
    raw = p.read_bytes()
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    return loads(text) if text.strip() else default


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents that may span lines; damaged fields are null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank and damaged lines are left out, never fatal."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).filter("trim(value) <> ''").select(parsed.alias("r"))
    return rows.filter("r IS NOT NULL AND r._corrupt IS NULL").select("r.*").drop("_corrupt")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def readable_lines(df: DataFrame, column: str) -> DataFrame:
    """A text column as an array of its lines, for files that people read; ``joined_lines`` undoes it."""
    return df.withColumn(column, F.split(column, "\n"))


def joined_lines(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(column, "\n"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("rowTag", row_tag).format("xml").load(path)


def read_truth(spark: SparkSession, path: str, names: list[str], separator: str = ":::") -> DataFrame:
    """Lines of fields between separators."""
    parts = F.split("value", separator)
    return spark.read.text(path).filter("trim(value) <> ''").select(*(F.trim(parts[i]).alias(n) for i, n in enumerate(names)))


def misses(requests: DataFrame, cache: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests whose answer is not yet stored."""
    return requests.join(cache.select(key), key, "left_anti")


def with_answers(requests: DataFrame, cache: DataFrame, key: str = "request_id") -> DataFrame:
    return requests.join(cache, key, "left").withColumn("cached", F.col("answer").isNotNull())


def patched(config: object, patch: dict, where: str = "") -> object:
    """A dataclass with a nested patch over it; keys that begin with _ are comments, unknown keys an error."""
    changes = {}
    known = {f.name for f in dataclasses.fields(config)}
    for k, v in patch.items():
        if k.startswith("_"):
            continue
        if k not in known:
            raise KeyError(f"unknown setting {where}{k}")
        now = getattr(config, k)
        changes[k] = patched(now, v, f"{where}{k}.") if dataclasses.is_dataclass(now) else v
    return dataclasses.replace(config, **changes)


def layered(config: object, *paths: str | Path) -> object:
    """Defaults, patched by each file in turn."""
    for p in paths:
        config = patched(config, load_json(p, {}))
    return config


def snapshot(config: object, path: str | Path) -> None:
    Path(path).write_text(json.dumps(dataclasses.asdict(config), indent=1, sort_keys=True))


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A report table; results are small, and ``most`` guards against one that is not."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are not a report")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])
