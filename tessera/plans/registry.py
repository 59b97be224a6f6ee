"""Registration of queries by survey id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Bank, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WHOLE = ("int", "smallint", "tinyint")


def widened(df: DataFrame) -> DataFrame:
    """Every integer column as BIGINT, since engines differ in the width of small results."""
    return df.select([F.col(f"`{c}`").cast("bigint").alias(c) if t in _WHOLE else F.col(f"`{c}`") for c, t in df.dtypes])


def query(key: str, sql: str | None = None) -> Callable:
    """Register ``f(bank)`` under a survey id, with the SQL that gives the same rows."""

    def put(f: Callable[[Bank], DataFrame]) -> Callable[[Bank], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = lambda spark, sf_dir: widened(f(Bank(spark, sf_dir)))
        if sql:
            ORACLE_SQL[key] = with_views(sql.strip())
        return f

    return put
