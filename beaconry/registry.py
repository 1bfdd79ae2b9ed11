"""All registered queries of the library and the SQL they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLES.
PLANS = [
    "scoring", "feed", "precision", "resolve", "ingest", "text", "classify", "reports", "worklists", "rules", "obligations", "licences", "displays",
    "tables", "streams", "upkeep", "details",
]


def _plans():
    return [importlib.import_module(f"beaconry.plans.{name}") for name in PLANS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in _plans() for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _plans() for name, sql in plan.ORACLES.items()}
