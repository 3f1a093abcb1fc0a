"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

from ._common import Query

MODULES = ("token_counts", "language_id", "token_files", "substring_dedup", "mixing", "toxicity", "simhash", "packing", "topk", "quality", "private_data", "source_divergence", "collocations")


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in import_module(f"cohortlens.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"cohortlens.llm.{m}").ORACLE.items()}
