"""Interval readings to hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(
    readings: DataFrame,
    keys: Sequence[str] = ("bldg_id", "state"),
    ts: str = "timestamp",
    value: str = "energy_consumption",
    lag_minutes: int = 15,
) -> DataFrame:
    """Sum end-labelled interval readings per key and hour.

    The partial sums before the shuffle leave at most one row per task, key and hour, so an entity
    that holds a large part of the raw readings sends no more than its number of hours.
    """
    begin = F.col(ts) - F.expr(f"INTERVAL {lag_minutes} MINUTES")
    hour = F.date_trunc("hour", begin.cast("timestamp"))
    return readings.groupBy(*keys, hour.alias(ts)).agg(
        F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias(value)
    )


def clustered(hours: DataFrame, key: str = "bldg_id", partitions: int | None = None, keep: bool = True) -> DataFrame:
    """Hash the hours by entity once; every later group or window by entity reuses that order.

    An entity has one row per hour of the calendar, so no partition grows with the raw readings.
    `keep` stores the result for several readers, in the (entity, day, time) order that all their windows
    need, so each sorts nothing again; the caller unpersists. A table bucketed by entity
    (`sources.write.bucketed_table`) needs neither step.
    """
    count = partitions or int(hours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = hours.repartition(count, key)
    return spread.sortWithinPartitions(key, "day", "timestamp").persist() if keep else spread
