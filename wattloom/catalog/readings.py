"""Reading, typing, rolling up and dating the readings; statistics per state."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.catalog.shape import r, registry, table
from wattloom.catalog.standins import (
    EVENT_BASE,
    SHIPMENT_BASE,
    event_base,
    event_hours,
    event_readings,
    shipment_base,
    shipment_hours,
    shipment_readings,
)
from wattloom.operators.encode import fit_codes
from wattloom.operators.facts import clean_facts, economics, percent_facts, pivot_facts
from wattloom.operators.rollup import hourly
from wattloom.operators.slices import cells
from wattloom.session import scratch_path
from wattloom.sources import write
from wattloom.sources.census import read_sheets
from wattloom.sources.tables import read_codes, scan, scan_partitioned, typed_readings

QUERIES, SQL, query = registry()

HOURS_SQL = "SELECT bldg_id, CAST(state AS BIGINT) AS state, ts, {e} AS energy FROM hours"


def named_hours(hours):
    return hours.select("bldg_id", "state", F.col("timestamp").alias("ts"), F.col("energy_consumption").alias("energy"))


@query("hourly_rollup", f"{EVENT_BASE} {HOURS_SQL.format(e=r('e'))}")
def hourly_rollup(spark, folder):
    """Events summed per user and hour, shifted by one interval."""
    return named_hours(event_hours(spark, folder))


@query("hourly_rollup_shipments", f"{SHIPMENT_BASE} {HOURS_SQL.format(e=r('e'))}")
def hourly_rollup_shipments(spark, folder):
    return named_hours(shipment_hours(spark, folder))


@query(
    "scan_cast_project",
    """SELECT CAST(o_orderkey AS BIGINT) AS bldg_id, o_orderstatus AS state, o_orderdate AS ts,
       CAST(o_totalprice AS DOUBLE) AS energy, 'orders' AS build_type
FROM orders WHERE o_orderstatus IN ('F', 'P')""",
)
def scan_cast_project(spark, folder):
    """A copy in `state=` folders, read back with folder pruning, typed and projected."""
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("bldg_id"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("out.electricity.total.energy_consumption"),
        F.lit("unused").alias("note"),
    )
    path = scratch_path(spark, "by-state")
    write.partitioned(raw, path, "state")
    kept = scan_partitioned(spark, path, ["F", "P"])
    typed = typed_readings(kept, state="state", value="`out.electricity.total.energy_consumption`")
    return named_hours(typed).withColumn("build_type", F.lit("orders"))


@query(
    "compact_by_state",
    f"{SHIPMENT_BASE} {HOURS_SQL.format(e=r('e'))}",
)
def compact_by_state(spark, folder):
    """Raw readings rolled up and written in balanced files per state, then read back."""
    path = scratch_path(spark, "hours")
    write.partitioned(hourly(shipment_readings(spark, folder)), path, "state")
    return named_hours(scan(spark, path))


@query(
    "calendar_enrich",
    f"""{SHIPMENT_BASE}
SELECT bldg_id, ts, CAST(hour AS BIGINT) AS hour, CAST(month AS BIGINT) AS month, CAST(weeknum AS BIGINT) AS weeknum,
       CAST(day AS VARCHAR) AS day, CAST(weekday AS BIGINT) AS weekday, CAST(is_weekend AS BIGINT) AS is_weekend,
       CAST(tou AS BIGINT) AS tou, CAST(season AS BIGINT) AS season, nat AS is_national_holiday, sth AS is_state_holiday
FROM base""",
)
def calendar_enrich(spark, folder):
    """Calendar, season, time of use and holidays of every hour."""
    return shipment_base(spark, folder).select(
        "bldg_id", F.col("timestamp").alias("ts"), "hour", "month", "weeknum", "day", "weekday", "is_weekend",
        "tou", "season", "is_national_holiday", "is_state_holiday",
    )


@query("daily_total_window", f"{EVENT_BASE} SELECT bldg_id, ts, {r('daily')} AS daily_consumption FROM base")
def daily_total_window(spark, folder):
    """The day's total on every hour row."""
    return event_base(spark, folder).select("bldg_id", F.col("timestamp").alias("ts"), "daily_consumption")


@query(
    "calendar_cells",
    f"""{SHIPMENT_BASE}
SELECT bldg_id, CAST(month AS BIGINT) AS month, CAST(weekday AS BIGINT) AS weekday, CAST(hour AS BIGINT) AS hour,
       nat AS is_national_holiday, sth AS is_state_holiday, {r("sum(e)")} AS sum_e, CAST(count(e) AS BIGINT) AS n_e,
       {r("sum(daily)")} AS sum_d, CAST(count(daily) AS BIGINT) AS n_d, {r("max(e)")} AS max_e, {r("min(e)")} AS min_e
FROM base GROUP BY ALL""",
)
def calendar_cells(spark, folder):
    """The sums and counts from which every slice is built."""
    return cells(shipment_base(spark, folder)).drop("season", "tou", "is_weekend")


EVENT_TYPES = ["click", "view", "purchase", "error"]


@query(
    "masked_aggregates",
    "SELECT user_id, "
    + ", ".join(
        f"{r(f'avg(value) FILTER (WHERE event_type = {chr(39)}{kind}{chr(39)})')} AS mean_{kind}, "
        f"{r(f'coalesce(sum(value / 4 + 1) FILTER (WHERE event_type = {chr(39)}{kind}{chr(39)}), 0)')} AS total_{kind}"
        for kind in EVENT_TYPES
    )
    + " FROM events GROUP BY user_id",
)
def masked_aggregates(spark, folder):
    """Aggregates over the rows of a group that match a predicate; an empty total is 0."""
    kind = F.col("event_type")
    return (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(
            *[F.avg(F.when(kind == one, F.col("value"))).alias(f"mean_{one}") for one in EVENT_TYPES],
            *[
                F.coalesce(F.sum(F.when(kind == one, F.col("value") / 4 + 1)), F.lit(0.0)).alias(f"total_{one}")
                for one in EVENT_TYPES
            ],
        )
    )


@query(
    "duration_and_date_format",
    """SELECT user_id, CAST(trunc((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000) AS BIGINT) AS hours,
       CAST(trunc((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000) AS BIGINT) AS minutes,
       strftime(min(ts), '%Y-%m-%d') AS first_day, CAST(CAST(strftime(max(ts), '%Y-%m-01') AS DATE) AS VARCHAR) AS last_month
FROM events GROUP BY user_id""",
)
def duration_and_date_format(spark, folder):
    """Whole hours and minutes between first and last reading; dates formatted and parsed."""
    spans = table(spark, folder, "events").groupBy("user_id").agg(
        F.min("ts").cast("timestamp").alias("first"), F.max("ts").cast("timestamp").alias("last")
    )
    return spans.select(
        "user_id",
        F.timestamp_diff("HOUR", "first", "last").alias("hours"),
        F.timestamp_diff("MINUTE", "first", "last").alias("minutes"),
        F.date_format("first", "yyyy-MM-dd").alias("first_day"),
        F.to_date(F.date_format("last", "yyyy-MM-01")).alias("last_month"),
    )


@query(
    "distinct_entities",
    f"{EVENT_BASE} SELECT DISTINCT bldg_id, CAST(state AS BIGINT) AS state FROM base",
)
def distinct_entities(spark, folder):
    """The (building, state) pairs that the feature row starts from."""
    return event_readings(spark, folder).select("bldg_id", "state").distinct()


@query(
    "mapper_explode",
    """SELECT 'train_label' AS dataset, 'o_orderpriority' AS "column", v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)
UNION ALL
SELECT 'train_data', 'o_orderstatus', v, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT)
FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)""",
)
def mapper_explode(spark, folder):
    """The nested mapper written as JSON and read back in long form."""
    codes = fit_codes(table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"]).withColumn(
        "dataset", F.when(F.col("column") == "o_orderpriority", "train_label").otherwise("train_data")
    )
    path = scratch_path(spark, "mapper")
    write.codes_json(codes, path)
    return read_codes(spark, path)


# --- statistics per state, printed the way the fact sheets print them

NATION_FACTS = ["Households", "Building share, percent", "Balance ($)", "Largest balance", "Debtor share, percent"]
FACT_NAMES = {
    "Households": "households",
    "Building share, percent": "building_share",
    "Balance ($)": "balance",
    "Largest balance": "largest_balance",
    "Debtor share, percent": "debtor_share",
}


def percent_text(share):
    tenths = F.floor(share * 1000)
    return F.when(tenths < 180, "Z").otherwise(
        F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%"))
    )


def nation_fact_texts(spark, folder):
    """Long (fact, state, value) with text cells: thousands commas, dollar and percent signs, Z and S flags."""
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    facts = customers.groupBy(F.col("n_name").alias("state"), "n_regionkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("c_mktsegment") == "BUILDING").cast("int")).alias("building"),
        F.sum(F.floor("c_acctbal")).alias("balance"),
        F.max(F.floor("c_acctbal")).alias("largest"),
        F.sum((F.col("c_acctbal") < 0).cast("int")).alias("debtors"),
    )
    cells_ = {
        "Households": F.format_number("n", 0),
        "Building share, percent": percent_text(F.col("building") / F.col("n")),
        "Balance ($)": F.concat(F.lit("$"), F.format_number("balance", 0)),
        "Largest balance": F.when(F.pmod("largest", F.lit(4)) == 0, "S").otherwise(F.format_number("largest", 0)),
        "Debtor share, percent": F.concat(F.floor(F.col("debtors") * 100 / F.col("n")).cast("string"), F.lit("%")),
    }
    return facts.select(
        "n_regionkey",
        "state",
        F.explode(F.array(*[F.struct(F.lit(name).alias("fact"), text.alias("value")) for name, text in cells_.items()])).alias("cell"),
    ).select("n_regionkey", "state", "cell.fact", "cell.value")


def fact_sheets(spark, folder):
    """One CSV sheet per region with the nations as columns, note columns in between and a footnote below."""
    long = nation_fact_texts(spark, folder)
    nations = table(spark, folder, "nation").select("n_regionkey", "n_name").orderBy("n_name").collect()
    paths = []
    for region in sorted({row["n_regionkey"] for row in nations}):
        names = [row["n_name"] for row in nations if row["n_regionkey"] == region]
        wide = long.filter(F.col("n_regionkey") == region).groupBy(F.col("fact").alias("Fact")).pivot("state", names).agg(F.first("value"))
        sheet = wide.select(
            "Fact", F.lit("").alias("Fact Note"),
            *[column for name in names for column in (F.col(name), F.lit("").alias(f"Value Note for {name}"))],
        )
        footnote = sheet.limit(1).withColumns({"Fact": F.lit("Value Notes"), **{name: F.lit("") for name in names}})
        path = scratch_path(spark, f"sheet-{region}")
        sheet.unionByName(footnote).write.option("header", True).option("escape", '"').csv(path)
        paths.append(path)
    return paths


FACTS_SQL = """
WITH facts AS (
  SELECT n_name AS state, count(*) AS n, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS building,
         sum(floor(c_acctbal)) AS balance, max(floor(c_acctbal)) AS largest, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS debtors
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
),
numbers AS (
  SELECT state, n AS households,
         CASE WHEN floor(building / n * 1000) < 180 THEN 0 ELSE floor(building / n * 1000) / 1000 END AS building_share,
         balance, CASE WHEN CAST(largest AS BIGINT) % 4 = 0 THEN NULL ELSE largest END AS largest_balance,
         floor(debtors * 100 / n) / 100 AS debtor_share
  FROM facts
)"""
FACT_COLUMNS = ", ".join(f"{r(name)} AS {name}" for name in FACT_NAMES.values())


@query(
    "econ_unpivot_pivot",
    f"""{FACTS_SQL}
SELECT state, fact, {r("value")} AS value FROM (
  SELECT state, 'Households' AS fact, households AS value FROM numbers
  UNION ALL SELECT state, 'Building share, percent', building_share FROM numbers
  UNION ALL SELECT state, 'Balance ($)', balance FROM numbers
  UNION ALL SELECT state, 'Largest balance', largest_balance FROM numbers
  UNION ALL SELECT state, 'Debtor share, percent', debtor_share FROM numbers
)""",
)
def econ_unpivot_pivot(spark, folder):
    """Sheets with different states read, unpivoted, united and cleaned."""
    return clean_facts(read_sheets(spark, fact_sheets(spark, folder), NATION_FACTS))


@query("econ_clean", f"{FACTS_SQL} SELECT CAST(substr(state, 8) AS BIGINT) AS state, {FACT_COLUMNS} FROM numbers")
def econ_clean(spark, folder):
    """One numeric row per state code from text cells."""
    code = F.substring_index("n_name", "_", -1).cast("int")
    codes = table(spark, folder, "nation").select(F.col("n_name").alias("value"), code.alias("code"))
    return economics(nation_fact_texts(spark, folder).drop("n_regionkey"), FACT_NAMES, codes)


@query(
    "percent_facts",
    f"""{FACTS_SQL}
SELECT 'Households' AS fact, count(*) < 0 AS is_percent FROM facts
UNION ALL SELECT 'Building share, percent', bool_or(floor(building / n * 1000) >= 180) FROM facts
UNION ALL SELECT 'Balance ($)', count(*) < 0 FROM facts
UNION ALL SELECT 'Largest balance', count(*) < 0 FROM facts
UNION ALL SELECT 'Debtor share, percent', bool_or(debtors >= 0) FROM facts""",
)
def percent_fact_flags(spark, folder):
    """Facts of which any cell carries a percent sign."""
    return percent_facts(nation_fact_texts(spark, folder))


@query(
    "fact_pivot",
    f"""{FACTS_SQL}
SELECT n.state, CAST(households AS BIGINT) AS "Households", CAST(f.balance AS BIGINT) AS "Balance ($)",
       CASE WHEN CAST(f.largest AS BIGINT) % 4 = 0 THEN 'S' ELSE CAST(CAST(f.largest AS BIGINT) AS VARCHAR) END AS "Largest balance",
       CASE WHEN floor(f.building / f.n * 1000) < 180 THEN 'Z' ELSE CAST(CAST(floor(f.building / f.n * 1000) AS BIGINT) AS VARCHAR) END AS "Building share, percent",
       CAST(floor(f.debtors * 100 / f.n) AS BIGINT) AS "Debtor share, percent"
FROM numbers n JOIN facts f USING (state)""",
)
def fact_pivot(spark, folder):
    """All facts to columns, still as text but for the signs."""
    wide = pivot_facts(nation_fact_texts(spark, folder), NATION_FACTS)

    def plain(name, signs):
        return F.translate(F.col(f"`{name}`"), signs, "")

    return wide.select(
        "state",
        plain("Households", ",").cast("long").alias("Households"),
        plain("Balance ($)", "$,").cast("long").alias("Balance ($)"),
        plain("Largest balance", ",").alias("Largest balance"),
        plain("Building share, percent", ".%").alias("Building share, percent"),
        plain("Debtor share, percent", "%").cast("long").alias("Debtor share, percent"),
    )
