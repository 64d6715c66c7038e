"""All registered queries of the core and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import changes, context, links, records, references, retrieval, search, streams

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (references, search, retrieval, links, records, changes, context, streams)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
