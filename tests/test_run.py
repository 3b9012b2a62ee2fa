"""From raw files to the submission on data derived from the given tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from wattloom.catalog.standins import shipment_readings
from wattloom.functions.fixed_values import CENSUS_FACTS, STATES
from wattloom.functions.order_keys import order_key
from wattloom.operators.ranking import rank_in_group
from wattloom.operators.rollup import hourly
from wattloom.plans import run
from wattloom.sources import write
from wattloom.sources.tables import scan_bucketed
from wattloom.streaming.arrivals import absorb_new_files, read_hours

SF = "/root/testdata/sf0.01"


def raw(spark):
    """Raw layout: text states (every other one is missing), dotted names."""
    letters = F.element_at(F.array(*[F.lit(state) for state in STATES]), (2 * F.col("state") + 1).cast("int"))
    return shipment_readings(spark, SF).select(
        "timestamp", F.col("energy_consumption").alias("out.electricity.total.energy_consumption"),
        letters.alias("in.state"), "bldg_id",
    )


def test_raw_to_submission(spark, tmp_path):
    readings = raw(spark)
    readings.filter("bldg_id < 60").write.parquet(str(tmp_path / "raw_train"))
    readings.filter("bldg_id >= 80").write.parquet(str(tmp_path / "raw_test"))
    ids = spark.range(60).withColumnRenamed("id", "bldg_id")
    commercial = F.col("bldg_id") % 2 == 0
    ids.select(
        "bldg_id",
        F.when(commercial, "commercial").otherwise("residential").alias("building_stock_type"),
        F.when(commercial, F.element_at(F.array(F.lit("Before 1946"), F.lit("1946 to 1959")), (F.col("bldg_id") % 4 / 2 + 1).cast("int"))).alias("in.vintage_com"),
        F.when(~commercial, F.element_at(F.array(F.lit("1"), F.lit("2")), ((F.col("bldg_id") - 1) % 4 / 2 + 1).cast("int"))).alias("in.bedrooms_res"),
    ).write.parquet(str(tmp_path / "raw_labels"))
    header = ",".join(['"Fact","Fact Note"'] + [f'"{name}","Value Note for {name}"' for name in STATES.values()])
    # Another value for every state, so that facts under a wrong code show.
    values = [f'"{1000 + i}",""' for i in range(len(STATES))]
    lines = [header] + [",".join([f'"{fact}",""', *values]) for fact in CENSUS_FACTS]
    (tmp_path / "sheet.csv").write_text("\n".join(lines))

    layout = run.Layout(
        str(tmp_path / "work"), ("building_stock_type", "in_vintage_com", "in_bedrooms_res"), folds=2,
        model={"maxIter": 2, "maxDepth": 2},
    )
    run.build_silver(
        spark, layout, str(tmp_path / "raw_train"), str(tmp_path / "raw_labels"), str(tmp_path / "raw_test"), [str(tmp_path / "sheet.csv")]
    )
    more = hourly(run.typed_readings(run.scan(spark, str(tmp_path / "raw_train")))).filter("bldg_id < 8")
    kinds = {
        "commercial": spark.range(8).select(F.col("id").alias("bldg_id"), F.lit("Before 1946").alias("in_vintage")),
        "residential": spark.range(8).select(F.col("id").alias("bldg_id"), F.lit("2").alias("in_bedrooms")),
    }
    run.add_buildings(spark, layout, {"commercial": more, "residential": more}, kinds, sample=100)
    run.build_gold(spark, layout, add=True)
    run.build_test_gold(spark, layout)

    gold = run.read_gold(spark, layout.at("gold"), "building_stock_type")
    assert gold.count() == 60 + 16
    assert len(gold.columns) == 4 + 585 + 63
    assert gold.filter("bldg_id >= 30000").count() == 16
    letters = {row["code"]: row["value"] for row in run._codes(spark, layout, "train_data").collect()}
    short = next(iter(CENSUS_FACTS.values()))
    places = list(STATES)
    facts = gold.select("state", F.col(f"`{short}`").alias("fact")).distinct().collect()
    assert len(facts) > 1 and len(letters) < len(STATES)
    assert all(row["fact"] == 1000 + places.index(letters[row["state"]]) for row in facts)

    kept = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = kept().size()
    run.train(spark, layout)
    assert kept().size() <= before
    curves = spark.read.parquet(layout.at("reports", "curves"))
    assert curves.groupBy("target", "fold").count().filter("count <> 2").isEmpty()
    assert curves.select("target", "fold").distinct().count() == 3 * 2
    oof = spark.read.parquet(layout.at("reports", "out_of_fold")).filter("target = 'building_stock_type'")
    assert oof.select("bldg_id").distinct().count() == 60 + 16
    used = spark.read.parquet(layout.at("reports", "importance")).filter("target = 'building_stock_type'")
    assert used.count() == 585 + 63 + 1 and not used.filter("feature = 'state'").isEmpty()
    run.submit(spark, layout)
    submission = spark.read.parquet(layout.at("submission")).toPandas()
    assert submission.bldg_id.tolist() == list(range(80, 100))
    is_commercial = submission.building_stock_type == "commercial"
    assert submission.in_bedrooms_res.isna().equals(is_commercial)
    assert submission.in_vintage_com.notna().equals(is_commercial)
    score = spark.read.csv(layout.at("reports", "final_score"), header=True, inferSchema=True).first()["score"]
    assert 0 <= score <= 1


def test_bucketed_silver_shuffles_no_hours(spark, tmp_path):
    """The hours of `build_gold` need no exchange, with additional buildings too; the features are the same."""
    readings = raw(spark).filter("bldg_id < 12")
    readings.write.parquet(str(tmp_path / "raw_train"))
    labels = spark.range(10).select(F.col("id").alias("bldg_id"), F.when(F.col("id") % 2 == 0, "commercial").otherwise("residential").alias("building_stock_type"))
    labels.write.parquet(str(tmp_path / "raw_labels"))
    header = ",".join(['"Fact","Fact Note"'] + [f'"{name}","Value Note for {name}"' for name in STATES.values()])
    (tmp_path / "sheet.csv").write_text("\n".join([header] + [",".join([f'"{fact}",""', *['"7",""'] * len(STATES)]) for fact in CENSUS_FACTS]))
    more = hourly(run.typed_readings(run.scan(spark, str(tmp_path / "raw_train")))).filter("bldg_id < 3")
    kinds = {kind: spark.range(3).select(F.col("id").alias("bldg_id")) for kind in ("commercial", "residential")}
    rows = {}
    for buckets in (None, 3):
        layout = run.Layout(str(tmp_path / f"work_{buckets}"), ("building_stock_type",), folds=2, buckets=buckets)
        run.build_silver(spark, layout, str(tmp_path / "raw_train"), str(tmp_path / "raw_labels"), None, [str(tmp_path / "sheet.csv")])
        run.add_buildings(spark, layout, {"commercial": more, "residential": more}, kinds)
        hours, _ = run.labelled_hours(spark, layout, add=True)
        features, kept = run._features(spark, layout, hours, None)
        if buckets:
            # The rows of the holiday table alone are made distinct by a shuffle.
            moved = re.findall(r"(?<!Broadcast)Exchange ([^,]*?)#", features._jdf.queryExecution().executedPlan().toString())
            assert kept is None and set(moved) <= {"hashpartitioning(state"}, moved
        rows[buckets] = features.orderBy("bldg_id").toPandas()
        if kept is not None:
            kept.unpersist()
    plain, bucketed = rows[None], rows[3]
    assert plain.bldg_id.tolist() == bucketed.bldg_id.tolist() and len(plain) == 16
    assert ((plain - bucketed[plain.columns]).abs().fillna(0) < 1e-9).all().all()
    assert plain.isna().equals(bucketed[plain.columns].isna())


def test_bucketed_folder_of_a_lost_job_is_not_read(spark, tmp_path):
    path = str(tmp_path / "rows")
    write.bucketed_folder(spark.range(20).withColumnRenamed("id", "bldg_id"), path, 2)
    assert scan_bucketed(spark, path).count() == 20
    write.bucketed_folder(spark.range(30).withColumnRenamed("id", "bldg_id"), path, 3)
    assert scan_bucketed(spark, path).count() == scan_bucketed(spark, path).count() == 30
    spark.range(0).write.mode("overwrite").parquet(f"{path}.buckets")
    with pytest.raises(ValueError, match="not written"):
        scan_bucketed(spark, path)


def test_arriving_files_are_counted_once(spark, tmp_path):
    readings = raw(spark).filter("bldg_id < 3")
    incoming, hours, progress = (str(tmp_path / name) for name in ("incoming", "hours", "progress"))
    readings.filter("bldg_id = 0").write.parquet(f"{incoming}/first")
    absorb_new_files(spark, incoming, hours, progress)
    readings.filter("bldg_id > 0").write.parquet(f"{incoming}/second")
    readings.filter("bldg_id = 0").limit(50).write.parquet(f"{incoming}/third")
    absorb_new_files(spark, incoming, hours, progress)
    absorb_new_files(spark, incoming, hours, progress)
    total = read_hours(spark, hours).agg(F.sum("energy_consumption")).first()[0]
    want = readings.unionByName(readings.filter("bldg_id = 0").limit(50)).agg(F.sum("`out.electricity.total.energy_consumption`")).first()[0]
    assert total == want


def test_rank_keeps_rows_of_a_null_group(spark):
    rows = spark.range(40).selectExpr("id", "if(id < 10, null, id % 3) as class")
    got = rank_in_group(rows, ["class"], order_key(0, "id")).groupBy("class").agg(F.max("rank").alias("last")).collect()
    assert {row["class"]: row["last"] for row in got} == {None: 9, 0: 9, 1: 9, 2: 9}
