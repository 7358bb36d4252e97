"""All queries outside the subpackage for training text."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("upkeep", "search", "wording", "state", "quality", "streams", "serving", "exchange")


def _merged(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"lexspark.plans.{name}"), what)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def sql() -> dict[str, str]:
    return _merged("SQL")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["hybrid_search"](spark, folder)
