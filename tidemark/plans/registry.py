"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import history, measurements, oracles, sources_plans, static, survival

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for module in (history, static, sources_plans, survival, measurements):
    QUERIES.update(module.QUERIES)
    SQL.update(module.SQL)

# where a plan's meaning is written down apart from it, that is its check
SQL.update({name: text for name, text in oracles.SQL.items() if name in QUERIES})
