"""Common output form of the catalog queries, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wattloom.session import configure

# Added before rounding: an exact half-way value then rounds the same way after any order of summation.
NUDGE = 0.00137


def shaped(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as bigint, measures as rounded double, naive timestamps, dates as text."""
    columns = []
    for field in df.schema:
        text = f"`{field.name}`"
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            text = f"CAST({text} AS BIGINT)"
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            text = f"round(CAST({text} AS DOUBLE) + {NUDGE * 10**-digits!r}D, {digits})"
        elif isinstance(field.dataType, T.TimestampType):
            text = f"CAST({text} AS TIMESTAMP_NTZ)"
        elif isinstance(field.dataType, T.DateType):
            text = f"CAST({text} AS STRING)"
        columns.append(f"{text} AS `{field.name}`")
    return df.selectExpr(*columns)


def r(expression: str, digits: int = 6) -> str:
    """SQL counterpart of the rounding in `shaped`."""
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE * 10**-digits:.17f}, {digits})"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def registry() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator) of one catalog module."""
    found: dict = {}
    sql: dict = {}

    def query(name: str, oracle: str | None = None, digits: int = 6):
        def register(build: Callable[[SparkSession, str], DataFrame]):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return shaped(build(configure(spark), folder), digits)

            run.__doc__ = build.__doc__
            found[name] = run
            if oracle is not None:
                sql[name] = oracle
            return build

        return register

    return found, sql, query
