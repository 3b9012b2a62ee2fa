"""Layers that grow: dictionaries by version, runs under a manifest, hours by arrival, footers, holiday rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.catalog.shape import registry, table
from wattloom.catalog.standins import SHIPMENT_READINGS, shipment_readings
from wattloom.functions.calendar import state_holidays
from wattloom.functions.fixed_values import STATE_CODES, STATE_HOLIDAYS
from wattloom.operators import encode as enc
from wattloom.operators import incremental
from wattloom.session import scratch_path
from wattloom.sources import runs
from wattloom.sources.tables import footer_profile as profile_of

QUERIES, SQL, query = registry()


@query(
    "dictionary_versions",
    """
WITH nations AS (SELECT n_nationkey, n_name FROM nation),
first AS (
  SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS code, CAST(1 AS BIGINT) AS version
  FROM (SELECT DISTINCT n_name AS value FROM supplier JOIN nations ON s_nationkey = n_nationkey)
),
second AS (
  SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 + (SELECT count(*) FROM first) AS BIGINT) AS code, CAST(2 AS BIGINT) AS version
  FROM (SELECT DISTINCT n_name AS value FROM customer JOIN nations ON c_nationkey = n_nationkey) WHERE value NOT IN (SELECT value FROM first)
),
words AS (
  SELECT 'kind' AS "column", value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS code, CAST(2 AS BIGINT) AS version
  FROM (SELECT DISTINCT c_mktsegment AS value FROM customer)
)
SELECT 'nation' AS "column", * FROM first UNION ALL SELECT 'nation', * FROM second UNION ALL SELECT * FROM words""",
)
def dictionary_versions(spark, folder):
    """A dictionary fitted on suppliers, then extended by customers, who have more nations and one more column."""
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    suppliers = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("nation")
    customers = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    first = enc.fit_codes(suppliers, ["nation"]).withColumn("version", F.lit(1))
    return enc.extended_codes(first, customers.select("nation", F.col("c_mktsegment").alias("kind")), ["nation", "kind"])


@query(
    "merged_runs",
    """
SELECT CAST(l_suppkey % 7 AS BIGINT) AS lane, count(*) AS rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(min(year(l_shipdate)) AS BIGINT) AS first_year,
       true AS few_runs, true AS repeated_once
FROM lineitem GROUP BY ALL""",
)
def merged_runs(spark, folder):
    """Line items arrive by ship year, each year twice over; runs are merged by three and read by the manifest."""
    rows = table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("year"), "l_quantity", F.pmod("l_suppkey", F.lit(7)).cast("int").alias("lane")
    )
    path = scratch_path(spark, "runs")
    years = sorted(row["year"] for row in rows.select("year").distinct().collect())
    again = 0
    for year in years:
        for _ in range(2):
            again += not runs.append(rows.filter(F.col("year") == year), path, f"year-{year}", ["lane"])
        runs.merge(spark, path, 3, ["lane"])
    few = len(runs.manifest(spark, path)[1]) <= 2 * len(years)
    return runs.read(spark, path).groupBy("lane").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"), F.min("year").alias("first_year"),
        F.lit(few and len(runs.manifest(spark, path)[1]) < max(4, len(years))).alias("few_runs"), F.lit(again == len(years)).alias("repeated_once"),
    )


@query(
    "incremental_rollup",
    f"""
WITH {SHIPMENT_READINGS}
SELECT bldg_id, CAST(state AS BIGINT) AS state, CAST(date_trunc('hour', ts - INTERVAL 15 MINUTE) AS TIMESTAMP) AS timestamp, sum(e) AS energy_consumption
FROM readings GROUP BY ALL""",
)
def incremental_rollup(spark, folder):
    """Readings arrive in two halves of the year and once more; the hours equal those of one full rollup."""
    readings = shipment_readings(spark, folder)
    path = scratch_path(spark, "hours")
    late = F.month("timestamp") > 6
    for arrival, rows in (("spring", readings.filter(~late)), ("autumn", readings.filter(late)), ("spring", readings.filter(~late))):
        incremental.absorb(rows, path, arrival, parts=8)
    return incremental.hours(spark, path)


@query(
    "footer_profile",
    """
SELECT 'orders' AS table_name, count(*) AS n_rows, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders
UNION ALL SELECT 'lineitem', count(*), min(l_orderkey), max(l_orderkey) FROM lineitem
UNION ALL SELECT 'documents', count(*), min(doc_id), max(doc_id) FROM documents""",
)
def footer_profile(spark, folder):
    """Rows and extremes of three tables, read from their footers."""
    out = None
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("documents", "doc_id")):
        one = profile_of(spark, f"{folder}/{name}.parquet", name, [key])
        one = one.withColumnsRenamed({f"min_{key}": "min_key", f"max_{key}": "max_key"})
        out = one if out is None else out.unionByName(one)
    return out


YEARS = range(2015, 2025)
EASTERS = ["2015-04-05", "2016-03-27", "2017-04-16", "2018-04-01", "2019-04-21", "2020-04-12", "2021-04-04", "2022-04-17", "2023-04-09", "2024-03-31"]


def _rule_sql(state: str, name: str, rule: str, shift: str, first: int, last: int) -> str:
    """The days of one rule as a test of each day of the calendar, independent of the rule's own arithmetic."""
    base, plus = rule, 0
    for sign in ("+", "-"):
        head, mark, tail = rule.rpartition(sign)
        if mark and head and (head.count("/") == 2 or head == "easter"):
            base, plus = head, int(sign + tail)
    day = f"(d - {plus})"
    if base == "easter":
        test = f"{day} IN ({', '.join(f'DATE {chr(39)}{e}{chr(39)}' for e in EASTERS)})"
    elif "/" in base:
        month, which, weekday = base.split("/")
        place = f"(dayofmonth({day}) - 1) // 7 + 1 = {which}" if int(which) > 0 else f"month({day} + 7) <> month({day})"
        test = f"month({day}) = {month} AND isodow({day}) = {int(weekday) + 1} AND {place}"
    else:
        month, number = base.split("-")
        test = f"month(d) = {month} AND dayofmonth(d) = {number}"
    moved = {"near": "CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END", "monday": "CASE isodow(d) WHEN 7 THEN d + 1 ELSE d END"}.get(shift, "d")
    even = " AND year(d) % 2 = 0" if first < 0 else ""
    text = name.replace("'", "''")
    return f"SELECT '{state}' AS state, CAST(CAST({moved} AS DATE) AS VARCHAR) AS day, '{text}' AS name FROM days WHERE {test} AND year(d) BETWEEN {abs(first)} AND {last or 9999}{even}"


@query(
    "state_holiday_calendar",
    f"""
WITH days AS (SELECT CAST(unnest(generate_series(DATE '2015-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS d),
held AS ({" UNION ALL ".join(_rule_sql(*rule) for rule in STATE_HOLIDAYS)}),
states AS (SELECT state, CAST(place - 1 AS BIGINT) AS key FROM (VALUES {", ".join(f"('{s}', {i})" for i, s in enumerate(STATE_CODES, 1))}) v(state, place)),
buyers AS (SELECT 2 * c_nationkey AS key, count(*) AS customers FROM customer GROUP BY 1)
SELECT held.state, day, name, CAST(coalesce(customers, 0) AS BIGINT) AS customers
FROM held LEFT JOIN states ON held.state = states.state LEFT JOIN buyers ON buyers.key = states.key""",
)
def state_holiday_calendar(spark, folder):
    """The holidays of all states in ten years, with the customers of the nation that stands for a state."""
    buyers = table(spark, folder, "customer").groupBy((2 * F.col("c_nationkey")).alias("key")).agg(F.count(F.lit(1)).alias("customers"))
    states = F.array(*map(F.lit, STATE_CODES))
    days = state_holidays(spark, list(YEARS)).withColumn("key", (F.array_position(states, F.col("state")) - 1).cast("long"))
    return days.join(buyers, "key", "left").select("state", "day", "name", F.coalesce("customers", F.lit(0)).alias("customers"))
