"""Calendar attributes of a reading, all as built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import COLD_MONTHS, HOT_MONTHS, MID_PEAK_HOURS, ON_PEAK_HOURS, STATE_HOLIDAYS


def _any_of(values: list[int]) -> str:
    return ", ".join(map(str, values))


def season_of(month: str) -> str:
    """SQL: 0 cold, 1 hot, 2 mild."""
    return f"CASE WHEN {month} IN ({_any_of(COLD_MONTHS)}) THEN 0 WHEN {month} IN ({_any_of(HOT_MONTHS)}) THEN 1 ELSE 2 END"


def tou_of(hour: str) -> str:
    """SQL: time of use, 0 off peak, 1 mid peak, 2 on peak."""
    return f"CASE WHEN {hour} IN ({_any_of(MID_PEAK_HOURS)}) THEN 1 WHEN {hour} IN ({_any_of(ON_PEAK_HOURS)}) THEN 2 ELSE 0 END"


def _fixed_date(day: str) -> str:
    month_day = f"(month({day}) * 100 + dayofmonth({day}))"
    return f"({month_day} IN (101, 704, 1111, 1225) OR ({month_day} = 619 AND year({day}) >= 2021))"


def is_federal_holiday(day: str) -> Column:
    """US federal holidays with their observed days, from the name of a date column.

    A pure function of the date: no calendar table has to be joined or broadcast, and it holds for any year.
    """
    month_day = f"month({day}) * 100 + dayofmonth({day})"
    # Third Monday of January and February, last of May, first of September, second of October.
    mondays = [(115, 121), (215, 221), (525, 531), (901, 907), (1008, 1014)]
    monday = " OR ".join(f"{month_day} BETWEEN {first} AND {last}" for first, last in mondays)
    return F.expr(
        f"""CASE weekday({day})
              WHEN 0 THEN {monday} OR {_fixed_date(day)} OR {_fixed_date(f"date_sub({day}, 1)")}
              WHEN 3 THEN {month_day} BETWEEN 1122 AND 1128 OR {_fixed_date(day)}
              WHEN 4 THEN {_fixed_date(day)} OR {_fixed_date(f"date_add({day}, 1)")}
              ELSE {_fixed_date(day)} END"""
    )


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year: the Sunday after the first ecclesiastical full moon of spring."""
    century = F.floor(year / 100)
    # Days from 21 March to the full moon, with the corrections for leap days and the moon; the latest two moons move up.
    epact = F.pmod(11 * F.pmod(year, F.lit(19)) + 8 - century + F.floor(century / 4) + F.floor((8 * century + 13) / 25), F.lit(30))
    moon = F.pmod(F.lit(53) - epact, F.lit(30))
    late = (moon == 29) | ((moon == 28) & (F.pmod(year, F.lit(19)) > 10))
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), (moon - late.cast("int")).cast("int"))
    return F.next_day(full, "Sun")


_RULE = re.compile(r"(?:(?P<easter>easter)|(?P<month>\d+)-(?P<day>\d+)|(?P<of>\d+)/(?P<which>-?\d+)/(?P<weekday>\d))(?P<plus>[+-]\d+)?")


def holiday_rules(spark: SparkSession, rules: Sequence[tuple] = STATE_HOLIDAYS) -> DataFrame:
    """The rules as a table, one row each: kind, month, day, which, weekday, plus, shift, years."""
    rows = []
    for state, name, rule, shift, first, last in rules:
        part = _RULE.fullmatch(rule)
        if part is None:
            raise ValueError(f"unknown rule {rule}")
        number = {key: int(value) for key, value in part.groupdict().items() if value and key != "easter"}
        kind = "easter" if part["easter"] else "date" if "month" in number else "weekday"
        month = number.get("month", number.get("of"))
        rows.append(
            (state, name, kind, month, number.get("day"), number.get("which"), number.get("weekday"), number.get("plus", 0), shift, abs(first), last or 9999, first < 0)
        )
    return spark.createDataFrame(
        rows,
        "state string, name string, kind string, month int, day int, which int, weekday int, plus int, shift string, first int, last int, even boolean",
    )


def state_holidays(spark: SparkSession, years: Sequence[int], rules: DataFrame | None = None) -> DataFrame:
    """(state, day, name): every rule in every year it is valid in, as columns of the rule and the year.

    The result is bounded by rules x years. Days that are federal holidays as well stay in; `with_holidays` leaves them out.
    """
    rules = holiday_rules(spark) if rules is None else rules
    each = rules.withColumn("year", F.explode(F.array(*[F.lit(int(year)) for year in years])))
    each = each.filter(F.col("year").between(F.col("first"), F.col("last")) & (~F.col("even") | (F.col("year") % 2 == 0)))
    start = F.make_date("year", F.coalesce("month", F.lit(1)), F.lit(1))
    end = F.last_day(start)
    forward = F.date_add(start, (F.pmod(F.col("weekday") - F.weekday(start), F.lit(7)) + 7 * (F.col("which") - 1)).cast("int"))
    backward = F.date_sub(end, F.pmod(F.weekday(end) - F.col("weekday"), F.lit(7)).cast("int"))
    plain = (
        F.when(F.col("kind") == "date", F.make_date("year", "month", "day"))
        .when(F.col("kind") == "easter", easter(F.col("year")))
        .when(F.col("which") < 0, backward)
        .otherwise(forward)
    )
    day = F.date_add(plain, F.col("plus"))
    moved = (
        F.when((F.weekday(day) == 5) & (F.col("shift") == "near"), F.date_sub(day, 1))
        .when((F.weekday(day) == 6) & F.col("shift").isin("near", "monday"), F.date_add(day, 1))
        .otherwise(day)
    )
    return each.select("state", moved.alias("day"), "name")


def with_calendar(hours: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add hour, month, weeknum (ISO), day, weekday (1-7), is_weekend, tou and season.

    A column that is there already is kept: `day`, and with it the order of rows sorted by it.
    """
    attributes = {
        "hour": f"hour({ts})",
        "month": f"month({ts})",
        "weeknum": f"weekofyear({ts})",
        "day": f"to_date({ts})",
        "weekday": f"weekday({ts}) + 1",
        "is_weekend": f"CAST(weekday({ts}) >= 5 AS INT)",
        "tou": tou_of(f"hour({ts})"),
        "season": season_of(f"month({ts})"),
    }
    kept = ["*", *[f"{expression} AS {name}" for name, expression in attributes.items() if name not in hours.columns]]
    return hours.selectExpr(*kept)


def with_holidays(hours: DataFrame, state_holidays: DataFrame | None = None) -> DataFrame:
    """Add `is_national_holiday` and `is_state_holiday`; needs `day` and, for the latter, `state`.

    `state_holidays` has (state, day). Days that are national holidays do not count as state holidays.
    It is bounded by states x days and broadcast: a shuffle by so few keys would make hot tasks.
    """
    out = hours.withColumn("is_national_holiday", is_federal_holiday("day"))
    if state_holidays is None:
        return out.withColumn("is_state_holiday", F.lit(False))
    dates = (
        state_holidays.select("state", F.to_date("day").alias("day"))
        .dropna()
        .filter(~is_federal_holiday("day"))
        .distinct()
        .withColumn("is_state_holiday", F.lit(True))
    )
    return out.join(F.broadcast(dates), ["state", "day"], "left").withColumn(
        "is_state_holiday", F.coalesce("is_state_holiday", F.lit(False))
    )
