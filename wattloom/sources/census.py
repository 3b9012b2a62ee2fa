"""Published fact sheets in CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import CENSUS_FACTS
from wattloom.operators.facts import economics, unpivot_states


def read_sheet(spark: SparkSession, path: str, facts: Sequence[str] = tuple(CENSUS_FACTS)) -> DataFrame:
    """One sheet as text; the known facts are kept, so footnotes below the table fall away."""
    sheet = spark.read.csv(path, header=True, quote='"', escape='"')
    return sheet.drop("Fact Note").filter(F.col("Fact").isin(list(facts)))


def read_sheets(spark: SparkSession, paths: Sequence[str], facts: Sequence[str] = tuple(CENSUS_FACTS)) -> DataFrame:
    """Several sheets with different states as long (fact, state, value)."""
    long = [unpivot_states(read_sheet(spark, path, facts)) for path in paths]
    out = long[0]
    for other in long[1:]:
        out = out.unionByName(other)
    return out


def read_economics(spark: SparkSession, paths: Sequence[str], state_codes: DataFrame | None = None) -> DataFrame:
    """The 63 facts per state code; the code is null for states that `state_codes` lacks."""
    return economics(read_sheets(spark, paths), state_codes=state_codes)
