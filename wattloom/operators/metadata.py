"""Metadata of two building kinds: suffixes, unions, selection by id, new ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators.ranking import dense_ids


def with_suffix(metadata: DataFrame, suffix: str, build_type: str, entity: str = "bldg_id") -> DataFrame:
    """`in_x` -> `in_x_<suffix>` and the building type as a literal column."""
    renamed = {name: f"{name}_{suffix}" for name in metadata.columns if name != entity}
    return metadata.withColumnsRenamed(renamed).withColumn("build_type", F.lit(build_type))


def diagonal_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name; a column that a table lacks is null there."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def aligned_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union with the others cut to the columns of the first."""
    out = first
    for other in others:
        out = out.unionByName(other.select(*first.columns))
    return out


def of_sampled(metadata: DataFrame, ids: DataFrame, keys: Sequence[str] = ("bldg_id", "build_type")) -> DataFrame:
    """Rows of the sampled entities; repeated ids do not multiply rows."""
    return metadata.join(ids.select(*keys).distinct(), list(keys), "inner")


def of_ids(rows: DataFrame, ids: DataFrame, entity: str = "bldg_id") -> DataFrame:
    """Semi join: rows whose id is in the set, whatever its size."""
    return rows.join(ids.select(entity), entity, "left_semi")


def renumbered(metadata: DataFrame, start: int = 30_000, keys: Sequence[str] = ("build_type", "bldg_id")) -> tuple[DataFrame, DataFrame]:
    """(metadata with new ids, map from old to new): ids of the two kinds no longer collide."""
    ids = dense_ids(metadata, keys, "new_id", start)
    renamed = metadata.join(ids, list(keys)).withColumn("bldg_id", F.col("new_id")).drop("new_id")
    return renamed, ids
