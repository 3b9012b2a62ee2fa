"""Roll up reading files as they arrive in a folder, each file once.

Every run takes the files that are new since the last one and stores their hourly partial sums. Sums of
partial sums are the sums, so a building whose readings arrive in several runs comes out right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.functions.fixed_values import safe_name
from wattloom.operators.rollup import hourly
from wattloom.sources.tables import READING_SCHEMA, typed_readings


def absorb_new_files(
    spark: SparkSession, incoming: str, hours: str, progress: str, schema: T.StructType = READING_SCHEMA
) -> None:
    """Read the new files below `incoming`, append their hours, remember them in `progress`, and stop."""

    def store(batch: DataFrame, number: int) -> None:
        # A repeated batch overwrites its own folder, so a restart does not count readings twice.
        hourly(typed_readings(batch)).write.mode("overwrite").parquet(f"{hours}/batch={number}")

    arriving = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(incoming)
    plain = arriving.withColumnsRenamed({name: safe_name(name) for name in schema.names if "." in name})
    plain.writeStream.foreachBatch(store).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def read_hours(spark: SparkSession, hours: str) -> DataFrame:
    """Hours over all runs."""
    parts = spark.read.parquet(hours)
    return parts.groupBy("bldg_id", "state", "timestamp").agg(F.sum("energy_consumption").alias("energy_consumption"))
