"""Every query of the engine and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "bh_fdr"
MODULES = ("treatment", "relational", "inputs", "models", "reports", "studies", "nulls", "texts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"cohortlens.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"cohortlens.plans.{m}").ORACLE.items()}
