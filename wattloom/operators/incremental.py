"""Hours that take up arrivals: only the parts of buildings that an arrival touches are read, summed and written anew.

Hours lie in as many runs as there are parts, a part being a range of the building's hash; the manifest of `sources.runs` says
which run holds a part. An arrival is rolled up once, its parts are united with the hours they had, and one commit puts the
new runs in the place of the old. An arrival that was taken up already changes nothing, and one whose job is lost changes
nothing either until its commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators.rollup import hourly
from wattloom.sources import runs

PARTS = 64


def part_of(entity: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(parts)).cast("int")


def _held(spark: SparkSession, folder: str, known: list) -> DataFrame | None:
    """The hours of some runs, each with its part: one scan per run, so untouched runs are not opened."""
    out = None
    for run in known:
        one = spark.read.parquet(f"{folder}/runs/{run['name']}/part={run['part']}").withColumn("part", F.lit(run["part"]))
        out = one if out is None else out.unionByName(one)
    return out


def absorb(readings: DataFrame, folder: str, arrival: str, parts: int = PARTS) -> list[int]:
    """Take up an arrival of readings; the parts it touched, none if it was taken up before.

    The rows of all touched parts are written by one job, in a folder per part, dealt evenly.
    """
    spark = readings.sparkSession
    version, known = runs.manifest(spark, folder)
    if any(arrival in run["arrivals"] for run in known):
        return []
    arrived = hourly(readings).withColumn("part", part_of("bldg_id", parts))
    # At most `parts` numbers.
    touched = sorted(row["part"] for row in readings.select(part_of("bldg_id", parts).alias("part")).distinct().collect())
    old = _held(spark, folder, [run for run in known if run["part"] in touched])
    both = arrived if old is None else arrived.unionByName(old)
    united = both.groupBy("part", "bldg_id", "state", "timestamp").agg(F.sum("energy_consumption").alias("energy_consumption"))
    united.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/runs/{arrival}")
    before = {run["part"]: run["arrivals"] for run in known}
    rows = [tuple(run) for run in known if run["part"] not in touched]
    rows += [(arrival, 0, part, [*before.get(part, []), arrival]) for part in touched]
    runs.commit(spark, folder, version, rows)
    return touched


def hours(spark: SparkSession, folder: str, parts: list[int] | None = None) -> DataFrame:
    """The hours of all buildings, or of some parts."""
    _, known = runs.manifest(spark, folder)
    chosen = [run for run in known if parts is None or run["part"] in parts]
    if not chosen:
        raise ValueError(f"no hours in {folder}")
    return _held(spark, folder, chosen).drop("part")
