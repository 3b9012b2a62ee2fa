"""The feature row: every load feature, the economics of the state, the state itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.calendar import is_federal_holiday, with_calendar, with_holidays
from wattloom.operators.joins import join_bounded
from wattloom.operators.enrich import with_daily_total
from wattloom.operators.profiles import HOUR_COLUMNS, WEEKDAY_COLUMNS, hour_profile_packed, weekday_profile_packed
from wattloom.operators.rollup import clustered
from wattloom.operators.slices import AGGREGATION_COLUMNS, aggregation_packed
from wattloom.operators.spikes import WORK_COLUMNS, range_of_work_packed
from wattloom.session import cut_lineage_in_order

LOAD_FEATURES = 585


def narrow_hours(
    hours: DataFrame, state_holidays: DataFrame | None = None, cluster: bool = True, keep: bool = True
) -> DataFrame:
    """Hours with their day and state holiday.

    With `cluster` they are hashed by entity, and persisted with `keep` when several families read them; the caller
    unpersists the result. Pass cluster=False for a table that is already bucketed by entity.
    """
    flagged = with_holidays(hours.withColumn("day", F.to_date("timestamp")), state_holidays).drop("is_national_holiday")
    return clustered(flagged, keep=keep) if cluster else flagged


def dated_hours(narrow: DataFrame) -> DataFrame:
    """`narrow_hours` with calendar, national holidays and daily total: cheap, derived again by each reader."""
    dated = with_calendar(narrow).withColumn("is_national_holiday", is_federal_holiday("day"))
    return with_daily_total(dated)


def base_hours(hours: DataFrame, state_holidays: DataFrame | None = None, cluster: bool = True) -> DataFrame:
    """Hours with calendar, holidays and daily total. Nothing is kept; for several readers take the two steps apart."""
    return dated_hours(narrow_hours(hours, state_holidays, cluster, keep=False))


def load_features(base: DataFrame) -> DataFrame:
    """One row per entity with the 585 load features; `base` comes from `base_hours`."""
    rows = base.select("bldg_id", "state").distinct()
    for family in (aggregation_packed(base), range_of_work_packed(base), hour_profile_packed(base), weekday_profile_packed(base)):
        rows = rows.join(family, "bldg_id", "left")
    return rows.selectExpr("bldg_id", "state", *AGGREGATION_COLUMNS, *WORK_COLUMNS, *HOUR_COLUMNS, *WEEKDAY_COLUMNS)


def with_economics(features: DataFrame, economics: DataFrame) -> DataFrame:
    """Feature rows with the economics of their state."""
    return join_bounded(features, economics, ["state"])


def feature_row(
    hours: DataFrame, economics: DataFrame, state_holidays: DataFrame | None = None, cluster: bool = True
) -> DataFrame:
    """`load_features` with the economics columns of the state.

    Several families read the hours, so they are stored in their order in the checkpoint folder: no cache is left behind.
    """
    narrow = narrow_hours(hours, state_holidays, cluster, keep=False)
    if cluster:
        narrow = cut_lineage_in_order(narrow.sortWithinPartitions("bldg_id", "day", "timestamp"))
    return with_economics(load_features(dated_hours(narrow)), economics)
