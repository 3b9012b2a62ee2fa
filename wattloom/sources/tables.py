"""Readers of readings, labels, metadata and mappers."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.functions.fixed_values import ALL_TARGETS, ENTITY, READING, STATE_CODES, safe_name

READING_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField(READING, T.DoubleType()),
        T.StructField("in.state", T.StringType()),
        T.StructField(ENTITY, T.LongType()),
    ]
)


def scan(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One scan over a file, a folder, a glob or a list of them; dots in column names become underscores."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    df = df.withColumnsRenamed({name: safe_name(name) for name in df.columns if "." in name})
    return df.select(*columns) if columns else df


def scan_partitioned(
    spark: SparkSession, folder: str, states: Sequence[str] = tuple(STATE_CODES), column: str = "state"
) -> DataFrame:
    """A `state=XX` folder tree, limited to an allow-list that prunes folders before any file is opened."""
    return spark.read.option("basePath", folder).parquet(folder).filter(F.col(column).isin(list(states)))


def typed_readings(raw: DataFrame, state: str = "in_state", value: str = safe_name(READING)) -> DataFrame:
    """Readings with the types and short names used everywhere else."""
    return raw.select(
        F.col(ENTITY).cast("bigint").alias("bldg_id"),
        F.col(state).alias("state"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.col(value).cast("double").alias("energy_consumption"),
    )


def typed_labels(raw: DataFrame, targets: Sequence[str] = tuple(map(safe_name, ALL_TARGETS))) -> DataFrame:
    """Labels as integers; what is none is null."""
    return raw.select(
        F.col(ENTITY).cast("bigint").alias("bldg_id"),
        *[F.col(target).cast("int").alias(target) for target in targets],
    )


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """The nested mapper JSON `{dataset: {column: {value: code}}}` as (dataset, column, value, code)."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "map<string, map<string, map<string, int>>>")
    return (
        text.select(F.explode(nested).alias("dataset", "columns"))
        .select("dataset", F.explode("columns").alias("column", "codes"))
        .select("dataset", F.regexp_replace("column", r"\.", "_").alias("column"), F.explode("codes").alias("value", "code"))
    )


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: the table's name, its columns, their number and the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), F.lit(",".join(df.columns)).alias("columns"),
        F.lit(len(df.columns)).alias("n_columns"), "n_rows",
    )


FOOTER_SETTINGS = {
    "spark.sql.sources.useV1SourceList": "",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.adaptive.enabled": "true",
}


def footer_profile(spark: SparkSession, path: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row: the table's name, its number of rows, and least and largest value of whole-number or date columns.

    They come from the Parquet footers: no column is read, so the cost follows the number of files. A session of its own holds
    the settings this needs; the caller's stay as they are. Files whose footers lack statistics are read instead.
    """
    session = spark.newSession()
    for key, value in FOOTER_SETTINGS.items():
        session.conf.set(key, value)
    ends = [F.expr(f"{end}({column})").alias(f"{end}_{column}") for column in columns for end in ("min", "max")]
    counted = [F.count(F.lit(1)).alias("n_rows"), *ends]
    try:
        one = session.read.parquet(path).agg(*counted)
        # One row; a missing statistic shows only when footers are read.
        found = spark.createDataFrame(one.collect(), T.StructType([T.StructField(x.name, x.dataType) for x in one.schema]))
    except Py4JJavaError:
        found = spark.read.parquet(path).agg(*counted)
    # Without any row group there is nothing to sum.
    rows = F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    return found.select(F.lit(name).alias("table_name"), rows, *found.columns[1:])


def scan_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A folder of `sources.write.bucketed_folder`: groups, windows and joins by its key need no shuffle.

    The session's catalog gets an external table over the files; a second reader of the same files takes that one.
    """
    note = spark.read.parquet(f"{path}.buckets").collect()
    if not note:
        raise ValueError(f"{path} was not written to its end")
    buckets, key, order = note[0]
    files = spark.read.parquet(path)
    # Rewritten files have other names, so a table over earlier ones is not taken again.
    table = "bucketed_" + hashlib.md5("\n".join([path, *sorted(files.inputFiles())]).encode()).hexdigest()
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in files.schema)
        place = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({', '.join(f'`{x}`' for x in order)})"
            f" INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(table)
