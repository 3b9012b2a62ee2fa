"""Many values of an entity in one map column until the very end.

A row of several hundred columns makes every operator that touches it expensive to plan and to compile.
Families therefore travel as one map per entity (bounded by the number of feature columns) and are turned
into columns by a single projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(long: DataFrame, by: str, measures: Sequence[str], result: str) -> DataFrame:
    """One row per entity: map from `by` to a struct of the measures. Rows without `by` only keep the entity."""
    entry = F.when(F.col(by).isNotNull(), F.struct(F.col(by), F.struct(*measures)))
    return long.groupBy("bldg_id").agg(F.map_from_entries(F.collect_list(entry)).alias(result))


def column(result: str, key: int | str, measure: str, name: str, default: str | None = None) -> str:
    """SQL of one feature column out of a packed map."""
    literal = f"'{key}'" if isinstance(key, str) else str(key)
    value = f"{result}[{literal}].{measure}"
    return f"{value} AS `{name}`" if default is None else f"coalesce({value}, {default}) AS `{name}`"
