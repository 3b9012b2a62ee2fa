"""Load profiles: which hour and weekday carries the extreme, and how far each lies from the usual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import DAYS_PER_YEAR, HOURS, WEEKDAYS, WEEKS_PER_YEAR
from wattloom.operators.packing import column, packed

KINDS = ["mean", "min", "max"]


def _share(hits: str, denominator: int) -> Column:
    """Number of periods with a hit over a fixed denominator; no hit at all is null."""
    return F.nullif(F.sum(hits), F.lit(0)) / denominator


def _columns(result: str, by: str, values: list[int], measures: dict[str, str]) -> list[str]:
    """Column expressions; `measures` maps a packed measure to its column-name prefix."""
    return [
        column(result, value, measure, f"{prefix}_{by}_{value}") for measure, prefix in measures.items() for value in values
    ]


HOUR_MEASURES = {
    "share_max": "profile_max",
    "share_min": "profile_min",
    **{f"energy_vs_{kind}": f"profile_energy_vs_{kind}" for kind in KINDS},
}
WEEKDAY_MEASURES = {
    "share_max": "profile_max",
    "share_min": "profile_min",
    **{f"daily_energy_vs_{kind}": f"profile_daily_energy_vs_{kind}" for kind in KINDS},
}
HOUR_COLUMNS = _columns("hour_profile", "hour", HOURS, HOUR_MEASURES)
WEEKDAY_COLUMNS = _columns("weekday_profile", "weekday", WEEKDAYS, WEEKDAY_MEASURES)


def hour_profile_long(hours: DataFrame, days_per_year: int = DAYS_PER_YEAR) -> DataFrame:
    """Per entity and hour: share of days on which it is the maximum / minimum, and mean deviations.

    Every hour tied with the extreme counts, once per day.
    """
    day = Window.partitionBy("bldg_id", "day")
    value = F.col("energy_consumption")
    marked = hours.withColumns(
        {"day_mean": F.avg(value).over(day), "day_min": F.min(value).over(day), "day_max": F.max(value).over(day)}
    )
    per_day = marked.groupBy("bldg_id", "day", "hour").agg(
        F.max((value == F.col("day_max")).cast("int")).alias("is_max"),
        F.max((value == F.col("day_min")).cast("int")).alias("is_min"),
        F.count(value).alias("n"),
        *[F.sum(value - F.col(f"day_{kind}")).alias(f"above_{kind}") for kind in KINDS],
    )
    return per_day.groupBy("bldg_id", "hour").agg(
        _share("is_max", days_per_year).alias("share_max"),
        _share("is_min", days_per_year).alias("share_min"),
        *[
            (F.sum(f"above_{kind}") / F.nullif(F.sum("n"), F.lit(0))).alias(f"energy_vs_{kind}")
            for kind in KINDS
        ],
    )


def hour_profile_packed(hours: DataFrame, days_per_year: int = DAYS_PER_YEAR) -> DataFrame:
    return packed(hour_profile_long(hours, days_per_year), "hour", list(HOUR_MEASURES), "hour_profile")


def hour_profile(hours: DataFrame, days_per_year: int = DAYS_PER_YEAR) -> DataFrame:
    """The 120 hour-profile columns."""
    return hour_profile_packed(hours, days_per_year).selectExpr("bldg_id", *HOUR_COLUMNS)


def daily_rows(hours: DataFrame, by_iso_year: bool = False) -> DataFrame:
    """One row per entity and day: total and number of hour rows.

    Weeks are told apart by ISO week number alone, as for data of one year; with `by_iso_year`
    several years do not share a week.
    """
    week = F.first("weeknum")
    if by_iso_year:
        week = F.first(F.extract(F.lit("YEAROFWEEK"), F.col("timestamp")) * 100 + F.col("weeknum"))
    return hours.groupBy("bldg_id", "day").agg(
        week.alias("week"),
        F.first("weekday").alias("weekday"),
        F.coalesce(F.sum("energy_consumption"), F.lit(0.0)).alias("total"),
        F.count(F.lit(1)).alias("n"),
    )


def weekday_profile_long(
    hours: DataFrame, weeks_per_year: int = WEEKS_PER_YEAR, by_iso_year: bool = False
) -> DataFrame:
    """As the hour profile, on daily totals within ISO weeks; means weigh a day by its hour rows."""
    week = Window.partitionBy("bldg_id", "week")
    total = F.col("total")
    weighted_mean = F.sum(total * F.col("n")).over(week) / F.sum("n").over(week)
    marked = daily_rows(hours, by_iso_year).withColumns(
        {"week_mean": weighted_mean, "week_min": F.min(total).over(week), "week_max": F.max(total).over(week)}
    )
    per_week = marked.groupBy("bldg_id", "week", "weekday").agg(
        F.max((total == F.col("week_max")).cast("int")).alias("is_max"),
        F.max((total == F.col("week_min")).cast("int")).alias("is_min"),
        F.sum("n").alias("n"),
        *[F.sum((total - F.col(f"week_{kind}")) * F.col("n")).alias(f"above_{kind}") for kind in KINDS],
    )
    return per_week.groupBy("bldg_id", "weekday").agg(
        _share("is_max", weeks_per_year).alias("share_max"),
        _share("is_min", weeks_per_year).alias("share_min"),
        *[(F.sum(f"above_{kind}") / F.sum("n")).alias(f"daily_energy_vs_{kind}") for kind in KINDS],
    )


def weekday_profile_packed(
    hours: DataFrame, weeks_per_year: int = WEEKS_PER_YEAR, by_iso_year: bool = False
) -> DataFrame:
    long = weekday_profile_long(hours, weeks_per_year, by_iso_year)
    return packed(long, "weekday", list(WEEKDAY_MEASURES), "weekday_profile")


def weekday_profile(
    hours: DataFrame, weeks_per_year: int = WEEKS_PER_YEAR, by_iso_year: bool = False
) -> DataFrame:
    """The 35 weekday-profile columns."""
    return weekday_profile_packed(hours, weeks_per_year, by_iso_year).selectExpr("bldg_id", *WEEKDAY_COLUMNS)
