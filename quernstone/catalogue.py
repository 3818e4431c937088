"""All registered queries over the given tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ["contest", "bands", "history", "stats", "dedup", "text", "stream", "model", "rule", "join", "source", "version", "audit", "fit", "geometry", "tree"]


def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for family in FAMILIES:
        out.update(import_module(f"quernstone.plans.{family}_queries").QUERIES)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
