"""Queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("rule_ensemble", "slack_packing", "mil_toxicity", "boosted_rules", "guess_cost", "byte_bpe", "shards", "licenses", "jaccard_groups", "hilbert_search",
           "turn_repair", "substring_trees", "filter_audit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"compovec.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"compovec.llm.{name}"), "ORACLE_SQL", {})
    return out
