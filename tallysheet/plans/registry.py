"""The queries by name and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Doubles to six places, or as many as are named for a column, without negative zeros."""
    return df.select(*[(F.round(c, places.get(c, 6)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
