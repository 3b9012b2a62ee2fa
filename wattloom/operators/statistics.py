"""Feature statistics: standardisation and class means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: mean and sample deviation of every feature."""
    return df.agg(
        *[F.avg(name).alias(f"{name}_mean") for name in features],
        *[F.stddev_samp(name).alias(f"{name}_std") for name in features],
    )


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / std with the statistics of the whole table; they are one row, read on the driver."""
    moments = feature_moments(df, features).first()
    return df.withColumns(
        {
            name: (F.col(name) - F.lit(moments[f"{name}_mean"])) / F.nullif(F.lit(moments[f"{name}_std"]), F.lit(0.0))
            for name in features
        }
    )


def class_means(df: DataFrame, by: str, features: Sequence[str]) -> DataFrame:
    """Mean of every feature per class."""
    return df.groupBy(by).agg(*[F.avg(name).alias(name) for name in features])


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values, a null counting as one value."""
    return df.agg(
        (F.count_distinct(column) + F.coalesce(F.bool_or(F.col(column).isNull()).cast("long"), F.lit(0))).alias("n")
    )


def feature_columns(df: DataFrame, leave_out: Sequence[str]) -> list[str]:
    """All columns but ids, fold columns and targets."""
    return [name for name in df.columns if name not in set(leave_out)]


def columns_containing(df: DataFrame, parts: Sequence[str]) -> list[str]:
    """Columns whose name contains any of the parts."""
    return [name for name in df.columns if any(part in name for part in parts)]
