"""Named queries over the TPC-H-like tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["readings", "features", "labels", "evaluation", "training", "learning", "layers"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"wattloom.catalog.{name}"), attribute))
    return out


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
