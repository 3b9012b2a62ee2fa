"""The given tables read as meter readings, states, holidays and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.catalog.shape import table
from wattloom.operators.gold import base_hours
from wattloom.operators.rollup import hourly


def event_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as readings: the user is the building, the customer's nation its state."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, folder, "events")
        .join(customers, F.col("user_id") == F.col("c_custkey"))
        .select(
            F.col("user_id").alias("bldg_id"),
            F.col("c_nationkey").alias("state"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.col("value").alias("energy_consumption"),
        )
    )


def shipment_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as 15-minute readings of one year: the supplier is the building, the quantity its use.

    The ship date is folded into 2018 and the part key gives the quarter hour.
    """
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    day = F.pmod(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")), F.lit(365))
    begin = F.date_add(F.lit("2018-01-01").cast("date"), day).cast("timestamp")
    return (
        table(spark, folder, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_suppkey").alias("bldg_id"),
            F.col("s_nationkey").alias("state"),
            F.timestamp_seconds(F.unix_seconds(begin) + F.pmod("l_partkey", F.lit(96)) * 900).alias("timestamp"),
            F.col("l_quantity").alias("energy_consumption"),
        )
    )


def state_holidays(spark: SparkSession, folder: str) -> DataFrame:
    """Two holidays per nation in 2018; one of them is a national holiday for every third nation."""
    key = F.col("n_nationkey")
    first = F.date_add(F.lit("2018-03-01").cast("date"), F.pmod(key * 3, F.lit(60)))
    second = F.when(F.pmod(key, F.lit(3)) == 0, F.lit("2018-07-04").cast("date")).otherwise(
        F.date_add(F.lit("2018-10-01").cast("date"), key)
    )
    return table(spark, folder, "nation").select(key.alias("state"), F.explode(F.array(first, second)).alias("day"))


def event_hours(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(event_readings(spark, folder))


def shipment_hours(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(shipment_readings(spark, folder))


def event_base(spark: SparkSession, folder: str) -> DataFrame:
    return base_hours(event_hours(spark, folder), state_holidays(spark, folder))


def shipment_base(spark: SparkSession, folder: str) -> DataFrame:
    return base_hours(shipment_hours(spark, folder), state_holidays(spark, folder))


EVENT_READINGS = """
readings AS (
  SELECT user_id AS bldg_id, c_nationkey AS state, ts, value AS e
  FROM events JOIN customer ON user_id = c_custkey
)"""

SHIPMENT_READINGS = """
readings AS (
  SELECT l_suppkey AS bldg_id, s_nationkey AS state,
         CAST(DATE '2018-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 365 AS INTEGER) AS TIMESTAMP)
           + to_minutes(CAST(l_partkey % 96 * 15 AS BIGINT)) AS ts,
         l_quantity AS e
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""

# Federal holidays as lists, independent of the rule-based expression that is being checked.
NATIONAL = [
    "2018-01-01", "2018-01-15", "2018-02-19", "2018-05-28", "2018-07-04", "2018-09-03",
    "2018-10-08", "2018-11-11", "2018-11-12", "2018-11-22", "2018-12-25",
    "2023-12-25", "2024-01-01", "2024-01-15", "2024-02-19",
]
NATIONAL_LIST = ", ".join(f"DATE '{day}'" for day in NATIONAL)

HOURS_AND_CALENDAR = f"""
hours AS (
  SELECT bldg_id, state, CAST(date_trunc('hour', ts - INTERVAL 15 MINUTE) AS TIMESTAMP) AS ts, sum(e) AS e
  FROM readings GROUP BY ALL
),
state_days AS (
  SELECT DISTINCT state, day FROM (
    SELECT n_nationkey AS state, DATE '2018-03-01' + CAST(n_nationkey * 3 % 60 AS INTEGER) AS day FROM nation
    UNION ALL
    SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN DATE '2018-07-04' ELSE DATE '2018-10-01' + n_nationkey END FROM nation
  ) WHERE day NOT IN ({NATIONAL_LIST})
),
dated AS (
  SELECT h.*, CAST(hour(ts) AS INTEGER) AS hour, CAST(month(ts) AS INTEGER) AS month, CAST(week(ts) AS INTEGER) AS weeknum,
         CAST(ts AS DATE) AS day, CAST(isodow(ts) AS INTEGER) AS weekday,
         CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN hour(ts) IN (13, 14, 15) THEN 1 WHEN hour(ts) IN (16, 17, 18, 19) THEN 2 ELSE 0 END AS tou,
         CASE WHEN month(ts) IN (12, 1, 2) THEN 0 WHEN month(ts) IN (6, 7, 8) THEN 1 ELSE 2 END AS season
  FROM hours h
),
base AS (
  SELECT d.*, d.day IN ({NATIONAL_LIST}) AS nat, s.day IS NOT NULL AS sth,
         sum(e) OVER (PARTITION BY bldg_id, d.day) AS daily
  FROM dated d LEFT JOIN state_days s ON d.state = s.state AND d.day = s.day
)"""

EVENT_BASE = f"WITH {EVENT_READINGS}, {HOURS_AND_CALENDAR}"
SHIPMENT_BASE = f"WITH {SHIPMENT_READINGS}, {HOURS_AND_CALENDAR}"

JUMPS = """
rolled AS (
  SELECT *, CASE WHEN count(e) OVER p = 4 THEN avg(e) OVER p END AS past,
            CASE WHEN count(e) OVER f = 4 THEN avg(e) OVER f END AS future
  FROM base
  WINDOW p AS (PARTITION BY bldg_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY bldg_id ORDER BY ts ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING)
),
jumps AS (SELECT *, future - past AS jump FROM rolled)"""
