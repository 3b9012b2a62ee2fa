"""Writers. Partitioned outputs are rebalanced first: one hot partition value is written by several tasks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """`column=value` folders with few, evenly sized files.

    The rebalance hint lets adaptive execution split a partition value that is too large for one task
    and join those that are too small for one file.
    """
    df.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def bucketed_table(
    df: DataFrame, table: str, buckets: int, key: str = "bldg_id", order: Sequence[str] = ("timestamp",)
) -> None:
    """A table bucketed by entity: groups, windows and joins by entity read it without a shuffle."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(
        key, *order
    ).saveAsTable(table)


def bucketed_folder(df: DataFrame, path: str, buckets: int, key: str = "bldg_id", order: Sequence[str] = ()) -> None:
    """As `bucketed_table`, but a folder that any session can read with `sources.tables.scan_bucketed`.

    The number of buckets, the key and the order are written beside the data, last: without them the folder is not read as
    bucketed, so a job that is lost in between leaves nothing that is taken for whole.
    """
    spark = df.sparkSession
    note = f"{path}.buckets"
    spark.range(0).write.mode("overwrite").parquet(note)
    spread = df.repartition(buckets, key)
    table = f"bucketed_{uuid.uuid4().hex}"
    spread.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
    # The table is external: its files stay.
    spark.sql(f"DROP TABLE {table}")
    known = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(key).alias("key"), F.array(*map(F.lit, [key, *order])).alias("sorted"))
    known.write.mode("overwrite").parquet(note)


def codes_json(codes: DataFrame, path: str) -> None:
    """(dataset, column, value, code) as the nested mapper `{dataset: {column: {value: code}}}`.

    The format is one JSON document, so one line of text holds the dictionary; it is as large as the distinct labels.
    """
    columns = codes.groupBy("dataset", "column").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "code")))).alias("codes")
    )
    datasets = columns.groupBy("dataset").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", F.to_json("codes").alias("codes"))))).alias("columns")
    )
    nested = datasets.select(
        "dataset", F.transform_values("columns", lambda _, text: F.from_json(text, "map<string, int>")).alias("columns")
    )
    line = nested.agg(F.map_from_entries(F.collect_list(F.struct("dataset", F.to_json("columns").alias("columns")))).alias("all"))
    line.select(
        F.to_json(F.transform_values("all", lambda _, text: F.from_json(text, "map<string, map<string, int>>")))
    ).write.mode("overwrite").text(path)


def submission(predictions: DataFrame, path: str, entity: str = "bldg_id") -> None:
    """Predictions in the order of the entity."""
    predictions.orderBy(entity).write.mode("overwrite").parquet(path)


def report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Score and importance tables as parquet or CSV with a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
