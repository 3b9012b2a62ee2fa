"""Category dictionaries: fit, apply, invert."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.functions.fixed_values import ORDINAL_LEVELS, safe_name
from wattloom.operators.ranking import running_total

CODES_SCHEMA = "column string, value string, code int"


def string_columns(df: DataFrame, entity: str = "bldg_id") -> list[str]:
    return [
        field.name for field in df.schema if isinstance(field.dataType, T.StringType) and field.name != entity
    ]


def fit_codes(df: DataFrame, columns: Sequence[str] | None = None, entity: str = "bldg_id") -> DataFrame:
    """(column, value, code) with the sorted distinct values of each string column numbered from 0.

    One pass over all columns; only distinct (column, value) pairs are shuffled. They are numbered by range, so a
    column with very many values is not sorted in one task.
    """
    columns = list(columns or string_columns(df, entity))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("value")) for name in columns])
    ).alias("pair")
    values = df.select(pairs).select("pair.column", "pair.value").filter(F.col("value").isNotNull()).distinct()
    numbered = running_total(values.withColumn("_one", F.lit(1)), ["column", "value"], {"_one": "_place"})
    starts = numbered.groupBy("column").agg(F.min("_place").alias("_start"))
    # One row per column of the schema.
    return numbered.join(F.broadcast(starts), "column").select(
        "column", "value", (F.col("_place") - F.col("_start")).cast("int").alias("code")
    )


def extended_codes(known: DataFrame, df: DataFrame, columns: Sequence[str] | None = None, entity: str = "bldg_id") -> DataFrame:
    """A new version of a dictionary (column, value, code, version): it keeps every code and appends the values it lacks.

    An anti join finds new values; they are sorted and numbered behind the largest code of their column. A value's version is
    the first that knows it, so `codes_of_version` gives any earlier dictionary back. Without new values nothing changes.
    """
    fitted = fit_codes(df, columns, entity).drop("code")
    fresh = fitted.join(known.select("column", "value"), ["column", "value"], "left_anti")
    numbered = running_total(fresh.withColumn("_one", F.lit(1)), ["column", "value"], {"_one": "_place"})
    starts = numbered.groupBy("column").agg(F.min("_place").alias("_start"))
    largest = known.groupBy("column").agg((F.max("code") + 1).alias("_next"))
    version = known.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int")).scalar()
    # One row per column of the schema.
    added = numbered.join(F.broadcast(starts.join(largest, "column", "left")), "column").select(
        "column", "value", (F.col("_place") - F.col("_start") + F.coalesce("_next", F.lit(0))).cast("int").alias("code"), version.alias("version")
    )
    return known.select("column", "value", "code", "version").unionByName(added)


def codes_of_version(codes: DataFrame, version: int) -> DataFrame:
    """The dictionary (column, value, code) as it was in `version`."""
    return codes.filter(F.col("version") <= version).select("column", "value", "code")


def ordinal_codes(spark: SparkSession, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """The fixed order of the ordinal targets in dictionary form."""
    levels = levels if levels is not None else {safe_name(name): values for name, values in ORDINAL_LEVELS.items()}
    rows = [(name, value, code) for name, values in levels.items() for code, value in enumerate(values)]
    return spark.createDataFrame(rows, CODES_SCHEMA)


def with_ordinal_order(codes: DataFrame, ordinal: DataFrame) -> DataFrame:
    """Replace the alphabetical codes of ordinal columns; done before anything is encoded."""
    fixed = ordinal.join(codes.select("column").distinct(), "column", "left_semi")
    return codes.join(ordinal.select("column").distinct(), "column", "left_anti").unionByName(fixed)


def as_maps(codes: DataFrame) -> dict[str, dict[str, int]]:
    """The dictionary on the driver, for dictionaries of a fixed list of values. Jobs encode by join."""
    maps: dict[str, dict[str, int]] = {}
    for row in codes.collect():
        maps.setdefault(row["column"], {})[row["value"]] = row["code"]
    return maps


def lookup(mapping: dict, key: Column) -> Column:
    """The mapped value, null for an unknown key."""
    literal = F.create_map(*[F.lit(item) for item in chain.from_iterable(mapping.items())])
    return F.try_element_at(literal, key)


def lookup_or_keep(mapping: dict, key: Column) -> Column:
    """The mapped value, the key itself where it is unknown."""
    return F.coalesce(lookup(mapping, key), key)


def encode(df: DataFrame, maps: dict[str, dict[str, int]]) -> DataFrame:
    """Replace values by codes, unknown values by null: literal maps, no join."""
    return df.withColumns(
        {name: lookup(maps[name], F.col(name)).cast("int") for name in maps if name in df.columns}
    )


def _replaced(df: DataFrame, codes: DataFrame, columns: Sequence[str], key: str, value: str) -> DataFrame:
    out = df
    for name in columns:
        side = codes.filter(F.col("column") == name).select(F.col(key).alias(name), F.col(value).alias("_new"))
        out = out.join(side, [name], "left").withColumn(name, F.col("_new")).drop("_new")
    return out.select(*df.columns)


def encode_by_join(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As `encode` for dictionaries of any size: one equi-join per column."""
    return _replaced(df, codes, columns, "value", "code")


def decode_by_join(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As `decode` for dictionaries of any size: one equi-join per column."""
    return _replaced(df, codes, columns, "code", "value")


def decode_long(predictions: DataFrame, codes: DataFrame) -> DataFrame:
    """(…, target, code) -> (…, target, code, value) with the inverse dictionary."""
    return predictions.join(codes.select(F.col("column").alias("target"), "code", "value"), ["target", "code"], "left")


def decode(df: DataFrame, maps: dict[str, dict[str, int]]) -> DataFrame:
    """Replace codes by values, one column per target."""
    inverse = {name: {code: value for value, code in entries.items()} for name, entries in maps.items()}
    return df.withColumns(
        {name: lookup(inverse[name], F.col(name).cast("int")) for name in inverse if name in df.columns}
    )
