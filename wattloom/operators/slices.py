"""Sliced averages, totals and monthly peaks: the aggregate family of the feature row.

Every mean and total is built from sums and counts that are merged in two steps: hours to two-way
tables such as month x weekday, and two-way tables to the slices. A table holds at most some hundred
rows of an entity, whatever its hours; cells of (month, weekday, hour, holiday flags) in between would
be nearly as many as the hours of an entity with few of them. Both steps group
by the entity first, so hours that are hashed by entity are never shuffled again. The slices of an
entity end up in one map (see `packing`) that a projection turns into columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.calendar import season_of, tou_of
from wattloom.functions.fixed_values import HOURS, MONTHS, SEASONS, TOU, WEEKDAYS
from wattloom.operators.packing import column, packed

DOMAINS = {
    "season": SEASONS,
    "month": MONTHS,
    "weekday": WEEKDAYS,
    "hour": HOURS,
    "tou": TOU,
    "is_weekend": [0, 1],
    "weeknum": list(range(1, 54)),
    "is_national_holiday": [1],
    "is_state_holiday": [1],
}


@dataclass(frozen=True)
class Slice:
    """One family of columns: `name` is a template over `dims`, `measure` one of the measures."""

    name: str
    dims: tuple[str, ...]
    measure: str

    def columns(self) -> list[str]:
        values = product(*[DOMAINS[dim] for dim in self.dims])
        return [self.name.format(**dict(zip(self.dims, value))) for value in values]


DAILY_BY_SEASON_MONTH = [
    Slice("average_daily_consumption_season_{season}", ("season",), "daily_mean"),
    Slice("average_daily_consumption_month_{month}", ("month",), "daily_mean"),
]
TOTALS = [
    Slice("total_consumption_season_{season}", ("season",), "total"),
    Slice("total_consumption_month_{month}", ("month",), "total"),
    Slice("total_consumption_weekday_{weekday}", ("weekday",), "total"),
    Slice("total_consumption_hour_{hour}", ("hour",), "total"),
    Slice("total_consumption_ever", (), "total"),
]
HOLIDAYS = [
    Slice("average_daily_consumption_national_holiday", ("is_national_holiday",), "daily_mean"),
    Slice("average_daily_consumption_state_holiday", ("is_state_holiday",), "daily_mean"),
    Slice("average_hour_consumption_national_holiday_tou_{tou}", ("is_national_holiday", "tou"), "mean"),
    Slice("average_hour_consumption_state_holiday_tou_{tou}", ("is_state_holiday", "tou"), "mean"),
]
TOU_SLICES = [
    Slice("average_hour_consumption_season_{season}_tou_{tou}", ("season", "tou"), "mean"),
    Slice("average_hour_consumption_month_{month}_tou_{tou}", ("month", "tou"), "mean"),
]
WEEKEND_SLICES = [
    Slice("average_hour_consumption_season_{season}_is_weekend_{is_weekend}", ("season", "is_weekend"), "mean"),
    Slice("average_hour_consumption_month_{month}_is_weekend_{is_weekend}", ("month", "is_weekend"), "mean"),
]
HOUR_SEASON = [Slice("average_consumption_hour_{hour}_over_season_{season}", ("hour", "season"), "mean")]
WEEKDAY_SLICES = [
    Slice("average_hour_consumption_season_{season}_weekday_{weekday}", ("season", "weekday"), "mean"),
    Slice("average_hour_consumption_month_{month}_weekday_{weekday}", ("month", "weekday"), "mean"),
]
MONTH_PEAKS = [
    Slice("average_hour_consumption_month_{month}", ("month",), "mean"),
    Slice("max_hour_consumption_month_{month}", ("month",), "peak"),
    Slice("min_hour_consumption_month_{month}", ("month",), "trough"),
]
WEEK_SLICES = [
    Slice("average_daily_consumption_week_{weeknum}", ("weeknum",), "daily_mean"),
    Slice("average_hour_consumption_week_{weeknum}_tou_{tou}", ("weeknum", "tou"), "mean"),
    Slice("average_hour_consumption_week_{weeknum}_is_weekend_{is_weekend}", ("weeknum", "is_weekend"), "mean"),
]
LOAD_SLICES = [
    *DAILY_BY_SEASON_MONTH,
    *TOTALS,
    *HOLIDAYS,
    *TOU_SLICES,
    *WEEKEND_SLICES,
    *HOUR_SEASON,
    *WEEKDAY_SLICES,
    *MONTH_PEAKS,
]

CELL_KEYS = ["month", "weekday", "hour"]
FLAGS = ["is_national_holiday", "is_state_holiday"]


def cells(hours: DataFrame, extra_keys: Sequence[str] = FLAGS) -> DataFrame:
    """Sums, counts and extremes per entity and calendar cell; needs daily_consumption and the calendar columns."""
    value = F.col("energy_consumption")
    daily = F.col("daily_consumption")
    return hours.groupBy("bldg_id", *CELL_KEYS, *extra_keys).agg(
        F.sum(value).alias("sum_e"),
        F.count(value).alias("n_e"),
        F.sum(daily).alias("sum_d"),
        F.count(daily).alias("n_d"),
        F.max(value).alias("max_e"),
        F.min(value).alias("min_e"),
    )


def measured(hours: DataFrame, extra_keys: Sequence[str] = FLAGS) -> DataFrame:
    """Each hour as the sums, counts and extremes of its own value; needs daily_consumption and the calendar columns."""
    value, daily = "energy_consumption", "daily_consumption"
    return hours.selectExpr(
        "bldg_id",
        *CELL_KEYS,
        *extra_keys,
        f"{value} AS sum_e",
        f"CAST({value} IS NOT NULL AS BIGINT) AS n_e",
        f"{daily} AS sum_d",
        f"CAST({daily} IS NOT NULL AS BIGINT) AS n_d",
        f"{value} AS max_e",
        f"{value} AS min_e",
    )


MERGE = {"sum_e": "sum", "n_e": "sum", "sum_d": "sum", "n_d": "sum", "max_e": "max", "min_e": "min"}
MEASURES = {
    "mean": "sum_e / nullif(n_e, 0)",
    "total": "coalesce(sum_e, 0D)",
    "daily_mean": "sum_d / nullif(n_d, 0)",
    "peak": "max_e",
    "trough": "min_e",
}


@dataclass(frozen=True)
class TwoWay:
    """A table of hours by two keys `a` and `b`, and the dimensions that are functions of them.

    `on` is the flag an hour must carry to take part. Dimensions are SQL over `a` and `b`.
    """

    a: str
    b: str
    dims: dict[str, str]
    on: str = "true"


WEEKEND = "CAST(b >= 6 AS INT)"
TWO_WAY = [
    TwoWay("month", "weekday", {"season": season_of("a"), "month": "a", "weekday": "b", "is_weekend": WEEKEND}),
    TwoWay("month", "hour", {"season": season_of("a"), "month": "a", "hour": "b", "tou": tou_of("b")}),
    TwoWay("month", "tou", {"is_national_holiday": "1", "tou": "b"}, "is_national_holiday"),
    TwoWay("month", "tou", {"is_state_holiday": "1", "tou": "b"}, "is_state_holiday"),
    TwoWay("weeknum", "weekday", {"weeknum": "a", "weekday": "b", "is_weekend": WEEKEND}),
    TwoWay("weeknum", "tou", {"weeknum": "a", "tou": "b"}),
]


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("bldg_id", *keys).agg(*[F.expr(f"{how}({name}) AS {name}") for name, how in MERGE.items()])


def sliced_packed(hours: DataFrame, slices: list[Slice]) -> DataFrame:
    """One row per entity with all slices in the map `slices`, keyed by the place of the column."""
    # The empty slice keeps one row per entity even when none of its hours falls in another.
    wanted = sorted({(), *(one.dims for one in slices)})
    by_table: dict[int, list[tuple[str, ...]]] = {}
    for dim_set in wanted:
        source = next(place for place, one in enumerate(TWO_WAY) if set(dim_set) <= set(one.dims))
        by_table.setdefault(source, []).append(dim_set)

    # Hours to two-way tables.
    extra_keys = [key for key in (*FLAGS, "weeknum") if any(key in one.dims for one in slices)]
    targets = ", ".join(
        f"CASE WHEN {TWO_WAY[place].on} THEN struct({place} AS table, {TWO_WAY[place].a} AS a, {TWO_WAY[place].b} AS b) END"
        for place in by_table
    )
    spread = (
        measured(hours, extra_keys)
        .selectExpr("*", f"{tou_of('hour')} AS tou")
        .selectExpr("bldg_id", *MERGE, f"explode(array({targets})) AS to")
        .filter("to IS NOT NULL")
    )
    level = _merged(spread.select("bldg_id", *MERGE, "to.*"), "table", "a", "b")

    # Two-way tables to slices; a slice is numbered by its set of dimensions and its place in it.
    starts, size = {}, 0
    for dim_set in wanted:
        starts[dim_set] = size
        size += math.prod(len(DOMAINS[dim]) for dim in dim_set)

    def number(dim_set: tuple[str, ...], dims: dict[str, str]) -> str:
        place = "0"
        for dim in dim_set:
            place = f"({place} * {len(DOMAINS[dim])} + {dims[dim]} - {DOMAINS[dim][0]})"
        return f"{place} + {starts[dim_set]}"

    numbers = " ".join(
        f"WHEN {place} THEN array({', '.join(number(dim_set, TWO_WAY[place].dims) for dim_set in dim_sets)})"
        for place, dim_sets in by_table.items()
    )
    level = _merged(level.selectExpr("bldg_id", *MERGE, f"explode(CASE table {numbers} END) AS slice"), "slice")

    # Slices to columns; the column number is its place in the list of names.
    first_column, position = {}, 0
    for one in slices:
        first_column[one] = position
        position += len(one.columns())
    entries = []
    for dim_set in wanted:
        cases = [
            f"struct(slice - {starts[dim_set]} + {first_column[one]} AS column, CAST({MEASURES[one.measure]} AS DOUBLE) AS value)"
            for one in slices
            if one.dims == dim_set
        ] or ["struct(CAST(NULL AS INT) AS column, CAST(NULL AS DOUBLE) AS value)"]
        end = starts[dim_set] + math.prod(len(DOMAINS[dim]) for dim in dim_set)
        entries.append(f"WHEN slice < {end} THEN array({', '.join(cases)})")
    spread = level.selectExpr("bldg_id", f"inline(CASE {' '.join(entries)} END)")
    return packed(spread, "column", ["value"], "slices")


def slice_columns(slices: list[Slice]) -> list[str]:
    """Column expressions over `sliced_packed`; totals of empty slices are 0, means are null."""
    named = [(name, "0D" if one.measure == "total" else None) for one in slices for name in one.columns()]
    return [column("slices", place, "value", name, default) for place, (name, default) in enumerate(named)]


def sliced(hours: DataFrame, slices: list[Slice]) -> DataFrame:
    """One row per entity with the columns of all `slices`."""
    return sliced_packed(hours, slices).selectExpr("bldg_id", *slice_columns(slices))


def median_packed(hours: DataFrame) -> DataFrame:
    """Exact median per entity and month (at most 744 hourly values per group and year)."""
    # A list is cheaper to pass on than the counted values of `median`.
    values = hours.groupBy("bldg_id", "month").agg(F.sort_array(F.collect_list(F.col("energy_consumption").cast("double"))).alias("values"))
    medians = values.selectExpr(
        "bldg_id", "month", "0.5D * get(values, CAST((size(values) - 1) div 2 AS INT)) + 0.5D * get(values, CAST(size(values) div 2 AS INT)) AS median"
    )
    return packed(medians, "month", ["median"], "medians")


MEDIAN_COLUMNS = [column("medians", month, "median", f"median_hour_consumption_month_{month}") for month in MONTHS]


def monthly_median(hours: DataFrame) -> DataFrame:
    """One median column per month."""
    return median_packed(hours).selectExpr("bldg_id", *MEDIAN_COLUMNS)


def aggregation_packed(hours: DataFrame) -> DataFrame:
    return sliced_packed(hours, LOAD_SLICES).join(median_packed(hours), "bldg_id", "left")


AGGREGATION_COLUMNS = [*slice_columns(LOAD_SLICES), *MEDIAN_COLUMNS]


def hour_aggregation(hours: DataFrame) -> DataFrame:
    """The 370 aggregate columns."""
    return aggregation_packed(hours).selectExpr("bldg_id", *AGGREGATION_COLUMNS)
