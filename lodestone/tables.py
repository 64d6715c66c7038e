"""Loading of the given tables.

A re-delivered record equals the first one except for ``received_at``: operators select the columns
they need without it and take them distinct, so each record counts once and nulls count as equal.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class TableNotFound(LookupError):
    """A folder doesn't hold a table that a query reads."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise TableNotFound(f"no table {name} in {folder}: write it there as {name}.parquet first") from error
        raise
