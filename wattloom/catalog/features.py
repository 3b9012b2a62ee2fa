"""Feature queries: slices, profiles, spikes, the whole feature row."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from wattloom.catalog.shape import r, registry, table
from wattloom.catalog.standins import (
    EVENT_BASE,
    JUMPS,
    SHIPMENT_BASE,
    event_base,
    event_hours,
    shipment_base,
    shipment_hours,
    state_holidays,
)
from wattloom.functions.fixed_values import HOURS, MONTHS, SEASONS, TOU, WEEKDAYS
from wattloom.operators import enrich, gold, profiles, slices, spikes

QUERIES, SQL, query = registry()

BANDS = {
    "com_begin_workday": "hour BETWEEN 3 AND 13 AND weekday <= 5",
    "com_begin_weekend": "hour BETWEEN 3 AND 13 AND weekday > 5",
    "res_begin_workday": "weekday <= 5",
    "res_begin_weekend": "weekday > 5",
    "com_end_workday": "hour >= 3 AND weekday <= 5",
    "com_end_weekend": "hour >= 3 AND weekday > 5",
    "res_end_workday": "weekday <= 5",
    "res_end_weekend": "weekday > 5",
}
BEGIN = [name for name in BANDS if "begin" in name]
END = [name for name in BANDS if "end_" in name]
RANGES = {
    f"{kind}_range_work_{day}": (f"{kind}_begin_{day}", f"{kind}_end_{day}")
    for kind in ("com", "res")
    for day in ("workday", "weekend")
}


# --- masked aggregates, written out one by one as the independent check of cells and grouping sets


def masked(function: str, value: str, condition: str, name: str, zero: bool = False) -> str:
    expression = f"{function}({value}) FILTER (WHERE {condition})"
    if zero:
        expression = f"coalesce({expression}, 0)"
    return f"{r(expression)} AS {name}"


DAILY = [masked("avg", "daily", f"season = {s}", f"average_daily_consumption_season_{s}") for s in SEASONS] + [
    masked("avg", "daily", f"month = {m}", f"average_daily_consumption_month_{m}") for m in MONTHS
]
TOTALS = (
    [masked("sum", "e", f"season = {s}", f"total_consumption_season_{s}", True) for s in SEASONS]
    + [masked("sum", "e", f"month = {m}", f"total_consumption_month_{m}", True) for m in MONTHS]
    + [masked("sum", "e", f"weekday = {w}", f"total_consumption_weekday_{w}", True) for w in WEEKDAYS]
    + [masked("sum", "e", f"hour = {h}", f"total_consumption_hour_{h}", True) for h in HOURS]
    + [masked("sum", "e", "true", "total_consumption_ever", True)]
)
HOLIDAYS = (
    [masked("avg", "daily", "nat", "average_daily_consumption_national_holiday")]
    + [masked("avg", "daily", "sth", "average_daily_consumption_state_holiday")]
    + [masked("avg", "e", f"nat AND tou = {t}", f"average_hour_consumption_national_holiday_tou_{t}") for t in TOU]
    + [masked("avg", "e", f"sth AND tou = {t}", f"average_hour_consumption_state_holiday_tou_{t}") for t in TOU]
)
TOU_SQL = [
    masked("avg", "e", f"season = {s} AND tou = {t}", f"average_hour_consumption_season_{s}_tou_{t}")
    for s, t in product(SEASONS, TOU)
] + [
    masked("avg", "e", f"month = {m} AND tou = {t}", f"average_hour_consumption_month_{m}_tou_{t}")
    for m, t in product(MONTHS, TOU)
]
WEEKEND_SQL = [
    masked("avg", "e", f"season = {s} AND is_weekend = {w}", f"average_hour_consumption_season_{s}_is_weekend_{w}")
    for s, w in product(SEASONS, (0, 1))
] + [
    masked("avg", "e", f"month = {m} AND is_weekend = {w}", f"average_hour_consumption_month_{m}_is_weekend_{w}")
    for m, w in product(MONTHS, (0, 1))
]
HOUR_SEASON_SQL = [
    masked("avg", "e", f"season = {s} AND hour = {h}", f"average_consumption_hour_{h}_over_season_{s}")
    for h, s in product(HOURS, SEASONS)
]
WEEKDAY_SQL = [
    masked("avg", "e", f"season = {s} AND weekday = {w}", f"average_hour_consumption_season_{s}_weekday_{w}")
    for s, w in product(SEASONS, WEEKDAYS)
] + [
    masked("avg", "e", f"month = {m} AND weekday = {w}", f"average_hour_consumption_month_{m}_weekday_{w}")
    for m, w in product(MONTHS, WEEKDAYS)
]
PEAK_SQL = [
    masked(function, "e", f"month = {m}", f"{name}_hour_consumption_month_{m}")
    for function, name in (("avg", "average"), ("max", "max"), ("min", "min"), ("median", "median"))
    for m in MONTHS
]
WEEKS = list(range(1, 54))
WEEK_SQL = (
    [masked("avg", "daily", f"weeknum = {w}", f"average_daily_consumption_week_{w}") for w in WEEKS]
    + [
        masked("avg", "e", f"weeknum = {w} AND tou = {t}", f"average_hour_consumption_week_{w}_tou_{t}")
        for w, t in product(WEEKS, TOU)
    ]
    + [
        masked("avg", "e", f"weeknum = {w} AND is_weekend = {d}", f"average_hour_consumption_week_{w}_is_weekend_{d}")
        for w, d in product(WEEKS, (0, 1))
    ]
)


def grouped(base: str, columns: list[str]) -> str:
    return f"{base} SELECT bldg_id, {', '.join(columns)} FROM base GROUP BY bldg_id"


def slice_query(name: str, families: list, columns: list[str]) -> None:
    @query(name, grouped(SHIPMENT_BASE, columns))
    def build(spark, folder):
        return slices.sliced(shipment_base(spark, folder), families)


slice_query("avg_daily_by_season_month", slices.DAILY_BY_SEASON_MONTH, DAILY)
slice_query("total_by_slice", slices.TOTALS, TOTALS)
slice_query("holiday_features", slices.HOLIDAYS, HOLIDAYS)
slice_query("season_tou_month_tou", slices.TOU_SLICES, TOU_SQL)
slice_query("weekend_slices", slices.WEEKEND_SLICES, WEEKEND_SQL)
slice_query("load_profile_by_season_hour", slices.HOUR_SEASON, HOUR_SEASON_SQL)
slice_query("weekday_slices", slices.WEEKDAY_SLICES, WEEKDAY_SQL)
slice_query("week_slices", slices.WEEK_SLICES, WEEK_SQL)

AGGREGATION_SQL = [
    *DAILY, *TOTALS, *HOLIDAYS, *TOU_SQL, *WEEKEND_SQL, *HOUR_SEASON_SQL, *WEEKDAY_SQL, *PEAK_SQL,
]


@query("monthly_peak_stats", grouped(SHIPMENT_BASE, PEAK_SQL))
def monthly_peak_stats(spark, folder):
    """Mean, max, min and exact median per month."""
    base = shipment_base(spark, folder)
    return slices.sliced(base, slices.MONTH_PEAKS).join(slices.monthly_median(base), "bldg_id", "left")


@query("hour_aggregation", grouped(SHIPMENT_BASE, AGGREGATION_SQL))
def hour_aggregation(spark, folder):
    """All 370 aggregate columns."""
    return slices.hour_aggregation(shipment_base(spark, folder))


@query(
    "load_profile_by_hour",
    grouped(EVENT_BASE, [masked("avg", "e", f"hour = {h}", f"average_consumption_hour_{h}") for h in HOURS]),
)
def load_profile_by_hour(spark, folder):
    """Mean use per hour of the day, one row per building."""
    shape = slices.Slice("average_consumption_hour_{hour}", ("hour",), "mean")
    return slices.sliced(event_base(spark, folder), [shape])


# --- profiles

HOUR_PROFILE = """
marked AS (
  SELECT *, avg(e) OVER d AS day_mean, min(e) OVER d AS day_min, max(e) OVER d AS day_max
  FROM base WINDOW d AS (PARTITION BY bldg_id, day)
)"""
WEEK_PROFILE = """
marked AS (
  SELECT *, avg(daily) OVER w AS week_mean, min(daily) OVER w AS week_min, max(daily) OVER w AS week_max
  FROM base WINDOW w AS (PARTITION BY bldg_id, weeknum)
)"""


def share_columns(kind: str, by: str, values: list[int], period: str, value: str, denominator: int) -> list[str]:
    return [
        r(
            f"nullif(count(DISTINCT {period}) FILTER (WHERE {by} = {v} AND {value}), 0) / {denominator}"
        )
        + f" AS profile_{kind}_{by}_{v}"
        for v in values
    ]


HOUR_SHARES = {
    kind: share_columns(kind, "hour", HOURS, "day", f"e = day_{kind}", 365) for kind in ("max", "min")
}
WEEKDAY_SHARES = {
    kind: share_columns(kind, "weekday", WEEKDAYS, "weeknum", f"daily = week_{kind}", 53) for kind in ("max", "min")
}
HOUR_DEVIATION = [
    masked("avg", f"e - day_{kind}", f"hour = {h}", f"profile_energy_vs_{kind}_hour_{h}")
    for kind in ("mean", "min", "max")
    for h in HOURS
]
WEEKDAY_DEVIATION = [
    masked("avg", f"daily - week_{kind}", f"weekday = {w}", f"profile_daily_energy_vs_{kind}_weekday_{w}")
    for kind in ("mean", "min", "max")
    for w in WEEKDAYS
]


def profile_sql(base: str, marked: str, columns: list[str]) -> str:
    return f"{base}, {marked} SELECT bldg_id, {', '.join(columns)} FROM marked GROUP BY bldg_id"


def pick(df, prefix: str):
    return df.select("bldg_id", *[name for name in df.columns if name.startswith(prefix)])


def profile_query(name: str, sql: str, family, prefix: str, base) -> None:
    @query(name, sql)
    def build(spark, folder):
        return pick(family(base(spark, folder)), prefix)


for kind in ("max", "min"):
    profile_query(
        f"hour_of_{kind}_share", profile_sql(EVENT_BASE, HOUR_PROFILE, HOUR_SHARES[kind]),
        profiles.hour_profile, f"profile_{kind}_hour", event_base,
    )
    profile_query(
        f"weekday_of_{kind}_share", profile_sql(SHIPMENT_BASE, WEEK_PROFILE, WEEKDAY_SHARES[kind]),
        profiles.weekday_profile, f"profile_{kind}_weekday", shipment_base,
    )
profile_query(
    "hour_deviation", profile_sql(EVENT_BASE, HOUR_PROFILE, HOUR_DEVIATION),
    profiles.hour_profile, "profile_energy", event_base,
)
profile_query(
    "weekday_deviation", profile_sql(SHIPMENT_BASE, WEEK_PROFILE, WEEKDAY_DEVIATION),
    profiles.weekday_profile, "profile_daily_energy", shipment_base,
)
profile_query(
    "hour_profile", profile_sql(SHIPMENT_BASE, HOUR_PROFILE, HOUR_SHARES["max"] + HOUR_SHARES["min"] + HOUR_DEVIATION),
    profiles.hour_profile, "profile", shipment_base,
)


@query(
    "deviation_windows",
    f"""{EVENT_BASE}
SELECT bldg_id, ts, {r("e - avg(e) OVER d")} AS energy_vs_mean, {r("e - min(e) OVER d")} AS energy_vs_min,
       {r("e - max(e) OVER d")} AS energy_vs_max, {r("daily - avg(daily) OVER w")} AS daily_energy_vs_mean,
       {r("daily - min(daily) OVER w")} AS daily_energy_vs_min, {r("daily - max(daily) OVER w")} AS daily_energy_vs_max
FROM base WINDOW d AS (PARTITION BY bldg_id, day), w AS (PARTITION BY bldg_id, weeknum)""",
)
def deviation_windows(spark, folder):
    """Hour rows with their distance from the day's and the week's mean, min and max."""
    out = enrich.with_weekly_deviation(enrich.with_daily_deviation(event_base(spark, folder)))
    return out.select(
        "bldg_id", F.col("timestamp").alias("ts"), "energy_vs_mean", "energy_vs_min", "energy_vs_max",
        "daily_energy_vs_mean", "daily_energy_vs_min", "daily_energy_vs_max",
    )


# --- jumps


@query(
    "rolling_past_future",
    f"{EVENT_BASE}, {JUMPS} SELECT bldg_id, ts, {r('past')} AS past_mean, {r('future')} AS future_mean, {r('jump')} AS jump FROM jumps",
)
def rolling_past_future(spark, folder):
    """Trailing and leading four-row means in time order."""
    return enrich.with_jump(event_base(spark, folder)).select(
        "bldg_id", F.col("timestamp").alias("ts"), "past_mean", "future_mean", "jump"
    )


def band_extremes(bands: dict[str, str], partition: str) -> str:
    best = [f"max(jump) FILTER (WHERE {bands[name]}) OVER k AS best_{name}" for name in BEGIN]
    worst = [f"min(jump) FILTER (WHERE {bands[name]}) OVER k AS best_{name}" for name in END]
    return f"SELECT *, {', '.join(best + worst)} FROM jumps WINDOW k AS (PARTITION BY {partition})"


SPIKES = f"""
extremes AS ({band_extremes(BANDS, "bldg_id, month, weeknum, day")}),
spikes AS (
  SELECT bldg_id, month, weeknum, day,
         {", ".join(f"CAST(epoch(min(ts) FILTER (WHERE {BANDS[n]} AND jump = best_{n})) AS BIGINT) AS time_{n}" for n in BEGIN)},
         {", ".join(f"CAST(epoch(max(ts) FILTER (WHERE {BANDS[n]} AND jump = best_{n})) AS BIGINT) AS time_{n}" for n in END)}
  FROM extremes GROUP BY bldg_id, month, weeknum, day
),
ranges AS (
  SELECT *, {", ".join(f"CAST(trunc((time_{e} - time_{b}) / 3600) AS BIGINT) AS {name}" for name, (b, e) in RANGES.items())}
  FROM spikes
)"""
TIMES_BEGIN = [f"time_{name}" for name in BEGIN]
TIMES_END = [f"time_{name}" for name in END]


@query(
    "spike_times",
    f"""{EVENT_BASE}, {JUMPS}, {SPIKES}
SELECT bldg_id, CAST(month AS BIGINT) AS month, CAST(weeknum AS BIGINT) AS weeknum, CAST(day AS VARCHAR) AS day,
       {", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in [*TIMES_BEGIN, *TIMES_END, *RANGES])} FROM ranges""",
    digits=0,
)
def spike_times(spark, folder):
    """Begin and end of work per band and day."""
    times = [*TIMES_BEGIN, *TIMES_END, *RANGES]
    return spikes.daily_spikes(event_base(spark, folder)).select(
        "bldg_id", "month", "weeknum", "day", *[F.col(name).cast("double") for name in times]
    )


def chain(function: dict[str, str], source: str, keys: str) -> str:
    columns = [f"{function[group]}({name}) AS {name}" for group, names in (
        ("range", list(RANGES)), ("begin", TIMES_BEGIN), ("end", TIMES_END)
    ) for name in names]
    return f"SELECT {keys}, {', '.join(columns)} FROM {source} GROUP BY {keys}"


RANGE_CHAIN = f"""
weekly AS ({chain({"range": "max", "begin": "min", "end": "max"}, "ranges", "bldg_id, month, weeknum")}),
monthly AS ({chain({"range": "min", "begin": "max", "end": "min"}, "weekly", "bldg_id, month")})"""
RANGE_COLUMNS = [f"{r(f'avg({name})', 3)} AS {name}" for name in [*RANGES, *TIMES_BEGIN, *TIMES_END]] + [
    f"{r(f'avg({name}) FILTER (WHERE month = {m})', 3)} AS {name}_month_{m}" for name in RANGES for m in MONTHS
]


@query(
    "range_of_work",
    f"{SHIPMENT_BASE}, {JUMPS}, {SPIKES}, {RANGE_CHAIN} SELECT bldg_id, {', '.join(RANGE_COLUMNS)} FROM monthly GROUP BY bldg_id",
    digits=3,
)
def range_of_work(spark, folder):
    """The 60 range-of-work columns."""
    return spikes.range_of_work(shipment_base(spark, folder))


def robust_sql(base: str, by: str, values: list[int]) -> str:
    week = ", ".join(
        [f"max(jump) FILTER (WHERE {BANDS[n]}) AS increment_{n}" for n in BEGIN]
        + [f"min(jump) FILTER (WHERE {BANDS[n]}) AS decrement_{n}" for n in END]
    )
    month = ", ".join([f"min(increment_{n}) AS increment_{n}" for n in BEGIN] + [f"max(decrement_{n}) AS decrement_{n}" for n in END])
    names = [f"increment_{n}" for n in BEGIN] + [f"decrement_{n}" for n in END]
    columns = [
        f"{r(f'avg({n}) FILTER (WHERE {by} = {v})')} AS average_robust_{n}_{by}_{v}" for n in names for v in values
    ]
    return f"""{base}, {JUMPS},
weekly AS (SELECT bldg_id, month, weeknum, {by}, {week} FROM jumps GROUP BY ALL),
monthly AS (SELECT bldg_id, month, {by}, {month} FROM weekly GROUP BY ALL)
SELECT bldg_id, {", ".join(columns)} FROM monthly GROUP BY bldg_id"""


@query("robust_change_by_hour", robust_sql(SHIPMENT_BASE, "hour", HOURS))
def robust_change_by_hour(spark, folder):
    return spikes.robust_change(shipment_base(spark, folder), "hour")


@query("robust_change_by_weekday", robust_sql(SHIPMENT_BASE, "weekday", WEEKDAYS))
def robust_change_by_weekday(spark, folder):
    return spikes.robust_change(shipment_base(spark, folder), "weekday")


OPEN_CLOSE_COLUMNS = [
    f"{r(f'avg({m}) FILTER (WHERE month = {month} AND is_weekend = {flag})')} AS average_{m}_{month}_is_weekend_{flag}"
    for m in ("drop_time_end", "drop_time_begin", "range_work")
    for month in MONTHS
    for flag in (0, 1)
]


@query(
    "open_close_drop",
    f"""{SHIPMENT_BASE}, {JUMPS},
best AS (
  SELECT *, max(jump) FILTER (WHERE hour BETWEEN 3 AND 13) OVER k AS top, min(jump) FILTER (WHERE hour >= 6) OVER k AS low
  FROM jumps WINDOW k AS (PARTITION BY bldg_id, day)
),
daily_drop AS (
  SELECT bldg_id, month, is_weekend, day, any_value(top) AS drop_time_begin, any_value(low) AS drop_time_end,
         trunc((epoch(max(ts) FILTER (WHERE hour >= 6 AND jump = low))
                - epoch(min(ts) FILTER (WHERE hour BETWEEN 3 AND 13 AND jump = top))) / 60) AS range_work
  FROM best GROUP BY bldg_id, month, is_weekend, day
)
SELECT bldg_id, {", ".join(OPEN_CLOSE_COLUMNS)} FROM daily_drop GROUP BY bldg_id""",
)
def open_close_drop(spark, folder):
    return spikes.open_close_drop(shipment_base(spark, folder))


MONTH_HOUR = [
    f"{r(f'avg(jump) FILTER (WHERE month = {m} AND hour = {h})')} AS average_difference_energy_consumption_{m}_{h}"
    for m, h in product(MONTHS, HOURS)
]


@query(
    "month_hour_difference",
    f"{SHIPMENT_BASE}, {JUMPS} SELECT bldg_id, {', '.join(MONTH_HOUR)} FROM jumps WHERE weekday <= 5 GROUP BY bldg_id",
)
def month_hour_difference(spark, folder):
    return spikes.month_hour_difference(shipment_base(spark, folder))


# --- the whole row


def nation_facts(spark, folder):
    """Customer statistics per nation as the economics table of the feature row."""
    return (
        table(spark, folder, "customer")
        .groupBy(F.col("c_nationkey").alias("state"))
        .agg(F.avg("c_acctbal").alias("mean_balance"), F.count(F.lit(1)).alias("households"))
    )


def feature_row_sql(base: str) -> str:
    return f"""{base}, {JUMPS}, {SPIKES}, {RANGE_CHAIN},
aggregates AS (SELECT bldg_id, {", ".join(AGGREGATION_SQL)} FROM base GROUP BY bldg_id),
work AS (SELECT bldg_id, {", ".join(RANGE_COLUMNS)} FROM monthly GROUP BY bldg_id),
{HOUR_PROFILE.replace("marked AS", "marked_day AS")},
hour_part AS (SELECT bldg_id, {", ".join(HOUR_SHARES["max"] + HOUR_SHARES["min"] + HOUR_DEVIATION)} FROM marked_day GROUP BY bldg_id),
{WEEK_PROFILE.replace("marked AS", "marked_week AS")},
week_part AS (SELECT bldg_id, {", ".join(WEEKDAY_SHARES["max"] + WEEKDAY_SHARES["min"] + WEEKDAY_DEVIATION)} FROM marked_week GROUP BY bldg_id),
economics AS (SELECT c_nationkey AS state, {r("avg(c_acctbal)")} AS mean_balance, CAST(count(*) AS BIGINT) AS households FROM customer GROUP BY 1),
entities AS (SELECT DISTINCT bldg_id, state FROM base)
SELECT * REPLACE (CAST(state AS BIGINT) AS state)
FROM entities LEFT JOIN aggregates USING (bldg_id) LEFT JOIN work USING (bldg_id)
     LEFT JOIN hour_part USING (bldg_id) LEFT JOIN week_part USING (bldg_id) LEFT JOIN economics USING (state)"""


def rounded_times(df):
    """Epoch seconds have ten digits before the point; three after it are what a double can compare."""
    return df.selectExpr(
        *[
            f"round(`{name}` + 1.37e-6D, 3) - 1.37e-9D AS `{name}`" if name.startswith("time_") or "range_work" in name else f"`{name}`"
            for name in df.columns
        ]
    )


def whole_row(spark, folder, hours):
    return rounded_times(gold.feature_row(hours(spark, folder), nation_facts(spark, folder), state_holidays(spark, folder)))


@query("feature_row", feature_row_sql(SHIPMENT_BASE))
def feature_row(spark, folder):
    """585 load features, the economics of the state and the state, one row per building."""
    return whole_row(spark, folder, shipment_hours)


@query("feature_row_events", feature_row_sql(EVENT_BASE))
def feature_row_events(spark, folder):
    return whole_row(spark, folder, event_hours)
