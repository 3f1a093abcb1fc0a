"""A table in a folder that grows by deltas, each of which appears whole or not at all."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shared import create, mounted


class DeltaTable:
    """Rows of a fixed schema. A delta is written as Parquet, then named by a record that is created exclusively.

    A writer that dies before the record leaves nothing that is read; writers at the same
    time take different numbers, so none is lost. The folder must be mounted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _deltas(self) -> list[str]:
        path = f"{mounted(self.folder)}/records"
        out = []
        for n in sorted(os.listdir(path)) if os.path.isdir(path) else []:
            if n.endswith(".json") and not n.startswith("_"):
                with open(f"{path}/{n}", "rb") as f:
                    out.append(json.load(f)["delta"])
        return out

    def read(self) -> DataFrame:
        """The rows of all deltas that are named by now."""
        parts = [f"{self.folder}/{d}" for d in self._deltas()]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> str:
        """Adds the rows; the delta's name."""
        path = f"{mounted(self.folder)}/records"
        os.makedirs(path, exist_ok=True)
        delta, n = f"delta-{uuid.uuid4().hex}", len(self._deltas())
        rows.write.parquet(f"{self.folder}/{delta}")
        while not create(f"{path}/{n:08d}.json", json.dumps({"delta": delta}).encode()):
            n += 1
        return delta
