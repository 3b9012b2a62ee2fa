"""Published statistics per state: from text cells to one numeric row per state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import CENSUS_FACTS, STATE_CODES, STATES
from wattloom.functions.text import amount_to_number, percent_to_share
from wattloom.operators.encode import lookup_or_keep
from wattloom.operators.joins import join_bounded


def unpivot_states(sheet: DataFrame, fact: str = "Fact") -> DataFrame:
    """One sheet (fact x state columns) to long (fact, state, value); note columns are left out."""
    states = [name for name in sheet.columns if name != fact and "note" not in name.lower() and "value" not in name.lower()]
    return sheet.select(fact, *[F.col(f"`{name}`") for name in states]).unpivot([fact], states, "state", "value").withColumnRenamed(fact, "fact")


def percent_facts(long: DataFrame) -> DataFrame:
    """Per fact: does any of its cells carry a percent sign?"""
    return long.groupBy("fact").agg(F.bool_or(F.coalesce(F.col("value").contains("%"), F.lit(False))).alias("is_percent"))


def clean_facts(long: DataFrame) -> DataFrame:
    """Long facts with a numeric value; a fact with a percent sign anywhere is read as a share."""
    number = F.when(F.col("is_percent"), percent_to_share(F.col("value"))).otherwise(amount_to_number(F.col("value")))
    return long.join(percent_facts(long), "fact").withColumn("value", number).drop("is_percent")


def pivot_facts(long: DataFrame, facts: Sequence[str]) -> DataFrame:
    """One row per state, one column per fact."""
    return long.groupBy("state").pivot("fact", list(facts)).agg(F.first("value", ignorenulls=True))


def economics(long: DataFrame, names: dict[str, str] = CENSUS_FACTS, state_codes: DataFrame | None = None) -> DataFrame:
    """The economics table: state code and the renamed numeric facts.

    `state_codes` has (value, code), one row per state; without it the fixed codes of all states are taken.
    """
    if state_codes is None:
        state_codes = long.sparkSession.createDataFrame(list(STATE_CODES.items()), "value string, code int")
    by_name = {name.upper(): code for code, name in STATES.items()}
    abbreviation = lookup_or_keep(by_name, F.upper(F.col("state")))
    wide = pivot_facts(clean_facts(long.filter(F.col("fact").isin(list(names)))), names)
    coded = join_bounded(wide.withColumn("value", abbreviation), state_codes.select("value", "code"), ["value"])
    return coded.select(
        F.col("code").cast("int").alias("state"),
        *[F.col(f"`{fact}`").alias(short) for fact, short in names.items()],
    )
