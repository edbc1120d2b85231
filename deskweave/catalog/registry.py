"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable:
    """Register ``build(tables) -> DataFrame`` under ``key``, with its SQL twin if there is one."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")
        _QUERIES[key] = build
        if sql is not None:
            _SQL[key] = sql
        return build

    return add


def _wide_numbers(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats as double, like the SQL side."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[F.col(n).cast(wide[t]).alias(n) if t in wide else F.col(n) for n, t in df.dtypes])


def _runner(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _wide_numbers(build(Tables(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _runner(build) for key, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
