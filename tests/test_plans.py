"""The physical plans that the design promises."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wattloom import catalog
from wattloom.catalog import standins
from wattloom.operators import gold, ranking
from wattloom.operators.folds import stratified_folds
from wattloom.sources import write

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange (hash|range|Single|Round)", text))


def test_bucketed_hours_need_no_shuffle(spark):
    write.bucketed_table(standins.shipment_hours(spark, SF), "hours_bucketed", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    base = gold.base_hours(spark.table("hours_bucketed"), cluster=False)
    features = gold.load_features(base)
    assert shuffles(plan(features)) == 0
    narrow = gold.narrow_hours(standins.shipment_hours(spark, SF))
    kept = gold.load_features(gold.dated_hours(narrow))
    left, right = (df.orderBy("bldg_id").toPandas() for df in (features, kept))
    names = [name for name in left.columns if "holiday" not in name]
    assert ((left[names] - right[names]).abs().fillna(0) < 1e-9).all().all()
    narrow.unpersist()
    spark.sql("DROP TABLE hours_bucketed")


def test_kept_hours_are_sorted_once(spark):
    """Windows by day and in time order read the stored order."""
    from wattloom.operators import enrich, profiles, spikes

    narrow = gold.narrow_hours(standins.shipment_hours(spark, SF))
    narrow.count()  # the plan of a filled cache is final
    base = gold.dated_hours(narrow)
    for family in (spikes.daily_spikes(base), profiles.hour_profile_long(base), enrich.with_jump(base)):
        outside = plan(family).split("InMemoryRelation")[0]
        assert "Sort [" not in outside and shuffles(outside) == 0
    narrow.unpersist()


def test_feature_row_leaves_no_cache(spark):
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = kept().size()
    row = gold.feature_row(standins.shipment_hours(spark, SF), spark.range(25).select(F.col("id").alias("state")))
    outside = plan(row)
    assert "InMemoryRelation" not in outside and shuffles(outside) == 0
    assert not re.search(r"Sort \[bldg_id#\d+L ASC NULLS FIRST, day", outside)
    assert kept().size() == before


def test_single_family_has_two_shuffles(spark):
    """One for the rollup, one to hash the hours by building."""
    for name in ("spike_times", "hour_profile", "weekday_deviation", "total_by_slice", "range_of_work"):
        text = plan(catalog.queries()[name](spark, SF))
        assert shuffles(text) == 2, name


def test_scan_reads_only_needed_columns(spark):
    text = plan(catalog.queries()["hourly_rollup_shipments"](spark, SF))
    schema = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem", text).group(1)
    assert {name.split("#")[0] for name in schema.split(",")} == {"l_partkey", "l_suppkey", "l_quantity", "l_shipdate"}


def test_state_filter_prunes_folders(spark, tmp_path):
    from wattloom.sources.tables import scan_partitioned

    rows = spark.createDataFrame([(1, "AK"), (2, "NA"), (3, "WY")], "bldg_id long, state string")
    write.partitioned(rows, str(tmp_path / "tree"), "state")
    kept = scan_partitioned(spark, str(tmp_path / "tree"))
    assert "PartitionFilters: [" in plan(kept) and "state" in plan(kept).split("PartitionFilters: [")[1][:80]
    assert {row["bldg_id"] for row in kept.collect()} == {1, 3}


def test_hot_class_is_spread_over_buckets(spark):
    rows = spark.range(30000).select(F.col("id").alias("bldg_id"), F.when(F.col("id") < 25000, "hot").otherwise("cold").alias("kind"))
    from wattloom.functions.order_keys import bucket_of, order_key

    sizes = rows.filter("kind = 'hot'").groupBy(bucket_of(order_key(0, "bldg_id")).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 40
    folds = stratified_folds(rows, "kind").groupBy("kind", "fold").count().collect()
    for kind in ("hot", "cold"):
        counts = [row["count"] for row in folds if row["kind"] == kind]
        assert max(counts) - min(counts) <= 1


def test_running_total_in_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit(2).alias("v"))
    out = ranking.running_total(rows, ["k"], {"v": "total"}).filter("total <> (k + 1) * 2")
    assert out.count() == 0
