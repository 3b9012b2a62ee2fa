"""Window columns on hourly rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAST_ROWS = (-3, 0)
FUTURE_ROWS = (2, 5)


def with_daily_total(hours: DataFrame) -> DataFrame:
    """`daily_consumption`: the entity's total of the day, repeated on each hour row."""
    day = Window.partitionBy("bldg_id", "day")
    return hours.withColumn("daily_consumption", F.coalesce(F.sum("energy_consumption").over(day), F.lit(0.0)))


def with_jump(hours: DataFrame) -> DataFrame:
    """Mean of the four rows up to now, mean of the four rows from the second next on, and the difference.

    Frames count rows in time order; a frame that is not full gives null. Sorting by (day, timestamp)
    is the time order and also the order that a following group by (bldg_id, day) needs.
    """
    in_time = Window.partitionBy("bldg_id").orderBy("day", "timestamp")
    value = F.col("energy_consumption")

    def full_mean(frame: tuple[int, int]):
        rows = in_time.rowsBetween(*frame)
        return F.when(F.count(value).over(rows) == 4, F.avg(value).over(rows))

    return hours.withColumns(
        {"past_mean": full_mean(PAST_ROWS), "future_mean": full_mean(FUTURE_ROWS)}
    ).withColumn("jump", F.col("future_mean") - F.col("past_mean"))


def with_daily_deviation(hours: DataFrame) -> DataFrame:
    """Reading minus the mean, min and max of its day."""
    day = Window.partitionBy("bldg_id", "day")
    value = F.col("energy_consumption")
    return hours.withColumns(
        {
            "energy_vs_mean": value - F.avg(value).over(day),
            "energy_vs_min": value - F.min(value).over(day),
            "energy_vs_max": value - F.max(value).over(day),
        }
    )


def with_weekly_deviation(hours: DataFrame) -> DataFrame:
    """Daily total minus the (hour-weighted) mean, min and max of its ISO week."""
    week = Window.partitionBy("bldg_id", "weeknum")
    value = F.col("daily_consumption")
    return hours.withColumns(
        {
            "daily_energy_vs_mean": value - F.avg(value).over(week),
            "daily_energy_vs_min": value - F.min(value).over(week),
            "daily_energy_vs_max": value - F.max(value).over(week),
        }
    )
