"""Opening and closing jumps of the load curve: range of work and robust changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.bands import BUILDING_KINDS, DAY_KINDS, begin_bands, end_bands
from wattloom.functions.fixed_values import HOURS, MONTHS, WEEKDAYS
from wattloom.operators.enrich import with_jump
from wattloom.operators.packing import column, packed

RANGES = [f"{kind}_range_work_{day_kind}" for kind in BUILDING_KINDS for day_kind in DAY_KINDS]
BEGIN_TIMES = [f"time_{kind}_begin_{day_kind}" for kind in BUILDING_KINDS for day_kind in DAY_KINDS]
END_TIMES = [f"time_{kind}_end_{day_kind}" for kind in BUILDING_KINDS for day_kind in DAY_KINDS]


AT = "unix_seconds(timestamp)"


def _first_highest(band: str) -> str:
    """Greatest jump in the band, the earliest on a tie, as (negative jump, epoch seconds)."""
    return f"min(CASE WHEN {band} AND jump IS NOT NULL THEN struct(-jump AS fall, {AT} AS at) END)"


def _last_lowest(band: str) -> str:
    """Lowest jump in the band, the latest on a tie, as (negative jump, epoch seconds)."""
    return f"max(CASE WHEN {band} AND jump IS NOT NULL THEN struct(-jump AS fall, {AT} AS at) END)"


def daily_spikes(hours: DataFrame) -> DataFrame:
    """Begin and end time per band and day, and the whole hours between them."""
    days = (
        with_jump(hours)
        .groupBy("bldg_id", "day")
        .agg(
            F.first("month").alias("month"),
            F.first("weeknum").alias("weeknum"),
            *[F.expr(f"{_first_highest(band)}.at AS time_{name}") for name, band in begin_bands().items()],
            *[F.expr(f"{_last_lowest(band)}.at AS time_{name}") for name, band in end_bands().items()],
        )
    )
    return days.withColumns(
        {
            f"{kind}_range_work_{day_kind}": F.expr(
                f"(time_{kind}_end_{day_kind} - time_{kind}_begin_{day_kind}) div 3600"
            )
            for kind in BUILDING_KINDS
            for day_kind in DAY_KINDS
        }
    )


def range_of_work_packed(hours: DataFrame) -> DataFrame:
    """Means over the months as columns and the ranges per month in the map `month_ranges`.

    Week: longest range, earliest begin, latest end. Month: the most careful week. Year: mean of the
    months, and the range per month. Times are epoch seconds.
    """
    weekly = daily_spikes(hours).groupBy("bldg_id", "month", "weeknum").agg(
        *[F.expr(f"max({name}) AS {name}") for name in RANGES + END_TIMES],
        *[F.expr(f"min({name}) AS {name}") for name in BEGIN_TIMES],
    )
    monthly = weekly.groupBy("bldg_id", "month").agg(
        *[F.expr(f"min({name}) AS {name}") for name in RANGES + END_TIMES],
        *[F.expr(f"max({name}) AS {name}") for name in BEGIN_TIMES],
    )
    by_month = F.struct("month", F.struct(*RANGES))
    return monthly.groupBy("bldg_id").agg(
        *[F.expr(f"avg({name}) AS {name}") for name in WORK_MEANS],
        F.map_from_entries(F.collect_list(by_month)).alias("month_ranges"),
    )


WORK_MEANS = RANGES + BEGIN_TIMES + END_TIMES
WORK_COLUMNS = [
    *WORK_MEANS,
    *[
        f"CAST(month_ranges[{month}].{name} AS DOUBLE) AS {name}_month_{month}" for name in RANGES for month in MONTHS
    ],
]


def range_of_work(hours: DataFrame) -> DataFrame:
    """The 60 range-of-work columns."""
    return range_of_work_packed(hours).selectExpr("bldg_id", *WORK_COLUMNS)


def robust_change(hours: DataFrame, by: str) -> DataFrame:
    """Greatest rise and deepest fall per week, the most careful week per month, the mean over months.

    `by` is "hour" (192 columns) or "weekday" (56 columns).
    """
    values = {"hour": HOURS, "weekday": WEEKDAYS}[by]
    rises = {f"increment_{name}": band for name, band in begin_bands().items()}
    falls = {f"decrement_{name}": band for name, band in end_bands().items()}
    weekly = with_jump(hours).groupBy("bldg_id", "month", "weeknum", by).agg(
        *[F.expr(f"max(jump) FILTER (WHERE {band}) AS {name}") for name, band in rises.items()],
        *[F.expr(f"min(jump) FILTER (WHERE {band}) AS {name}") for name, band in falls.items()],
    )
    monthly = weekly.groupBy("bldg_id", "month", by).agg(
        *[F.min(name).alias(name) for name in rises],
        *[F.max(name).alias(name) for name in falls],
    )
    changes = [*rises, *falls]
    mean = monthly.groupBy("bldg_id", by).agg(*[F.avg(name).alias(name) for name in changes])
    return packed(mean, by, changes, "changes").selectExpr(
        "bldg_id",
        *[
            column("changes", value, name, f"average_robust_{name}_{by}_{value}")
            for name in changes
            for value in values
        ],
    )


def open_close_drop(hours: DataFrame) -> DataFrame:
    """Mean opening rise, closing fall and minutes between them, by month and weekend (72 columns)."""
    daily = (
        with_jump(hours)
        .groupBy("bldg_id", "day")
        .agg(
            F.first("month").alias("month"),
            F.first("is_weekend").alias("is_weekend"),
            F.expr(f"{_first_highest('hour BETWEEN 3 AND 13')} AS begin"),
            F.expr(f"{_last_lowest('hour >= 6')} AS end"),
        )
        .withColumn("minutes", F.expr("(end.at - begin.at) div 60"))
    )
    monthly = daily.groupBy("bldg_id", "month", "is_weekend").agg(
        F.avg(-F.col("end.fall")).alias("drop_time_end"),
        F.avg(-F.col("begin.fall")).alias("drop_time_begin"),
        F.avg("minutes").alias("range_work"),
    )
    measures = ["drop_time_end", "drop_time_begin", "range_work"]
    slots = monthly.withColumn("slot", F.concat_ws("_", "month", "is_weekend"))
    return packed(slots, "slot", measures, "drops").selectExpr(
        "bldg_id",
        *[
            column("drops", f"{month}_{flag}", measure, f"average_{measure}_{month}_is_weekend_{flag}")
            for measure in measures
            for month in MONTHS
            for flag in (0, 1)
        ],
    )


def month_hour_difference(hours: DataFrame) -> DataFrame:
    """Mean jump on workdays by month and hour (288 columns)."""
    means = (
        with_jump(hours)
        .filter(F.col("weekday") <= 5)
        .groupBy("bldg_id", "month", "hour")
        .agg(F.avg("jump").alias("jump"))
        .withColumn("slot", F.col("month") * 100 + F.col("hour"))
    )
    return packed(means, "slot", ["jump"], "jumps").selectExpr(
        "bldg_id",
        *[
            column("jumps", month * 100 + hour, "jump", f"average_difference_energy_consumption_{month}_{hour}")
            for month in MONTHS
            for hour in HOURS
        ],
    )
