from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from wattloom.functions.calendar import state_holidays, with_holidays
from wattloom.operators import encode, incremental
from wattloom.sources import runs
from wattloom.sources.tables import footer_profile

SF = "/root/testdata/sf0.001"


def rows_of(spark, first, last):
    return spark.range(first, last).select("id", (F.col("id") % 3).alias("lane"))


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def test_runs_merge_in_levels(spark, tmp_path):
    folder = str(tmp_path / "layer")
    with pytest.raises(ValueError):
        runs.read(spark, folder)
    for i in range(7):
        assert runs.append(rows_of(spark, 10 * i, 10 * i + 10), folder, f"a{i}", ["lane"])
        runs.merge(spark, folder, 2, ["lane"])
    version, held = runs.manifest(spark, folder)
    assert [(r["level"], len(r["arrivals"])) for r in held] == [(0, 1), (1, 2), (2, 4)]
    assert ids(runs.read(spark, folder)) == list(range(70))
    assert not runs.append(rows_of(spark, 0, 10), folder, "a3", ["lane"]) and runs.manifest(spark, folder)[0] == version
    # An earlier version reads as it was.
    assert ids(runs.read(spark, folder, 1)) == list(range(10))
    assert "PartitionFilters: [isnotnull(lane" in runs.read(spark, folder).filter("lane = 1")._jdf.queryExecution().executedPlan().toString()


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "layer")
    for i in range(2):
        runs.append(rows_of(spark, 10 * i, 10 * i + 10), folder, f"a{i}")

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(runs, "commit", crash)
    for job in (lambda: runs.append(rows_of(spark, 90, 99), folder, "a2"), lambda: runs.merge(spark, folder, 2)):
        with pytest.raises(RuntimeError):
            job()
        assert ids(runs.read(spark, folder)) == list(range(20))
    monkeypatch.undo()
    assert runs.append(rows_of(spark, 20, 30), folder, "a2")  # the run that was written in vain is written over
    assert runs.merge(spark, folder, 2) == 1 and ids(runs.read(spark, folder)) == list(range(30))


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    folder = str(tmp_path / "layer")
    runs.append(rows_of(spark, 0, 5), folder, "a")
    version, held = runs.manifest(spark, folder)
    runs.commit(spark, folder, version, [tuple(r) for r in held])
    with pytest.raises(Exception, match="(?i)exist"):
        runs.commit(spark, folder, version, [])
    assert ids(runs.read(spark, folder)) == list(range(5))


def readings(spark, buildings, month):
    return spark.range(24 * 4).select(
        F.explode(F.array(*[F.lit(b).cast("long") for b in buildings])).alias("bldg_id"), F.lit("AK").alias("state"),
        F.timestamp_seconds(F.unix_seconds(F.lit(f"2018-{month:02}-01").cast("timestamp")) + F.col("id") * 900 + 900).alias("timestamp"),
        F.col("id").cast("double").alias("energy_consumption"),
    )


def test_arrivals_touch_only_their_parts(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "hours")
    first = readings(spark, range(30), 1)
    assert incremental.absorb(first, folder, "one", 8) == list(range(8))
    second = readings(spark, [3], 2).unionByName(readings(spark, [3], 1))
    touched = incremental.absorb(second, folder, "two", 8)
    assert len(touched) == 1
    _, known = runs.manifest(spark, folder)
    assert {r["part"] for r in known if r["name"] == "two"} == set(touched) and len(known) == 8
    assert incremental.absorb(second, folder, "two", 8) == []
    want = first.unionByName(second).groupBy("bldg_id").agg(F.sum("energy_consumption").alias("e"))
    got = incremental.hours(spark, folder).groupBy("bldg_id").agg(F.sum("energy_consumption").alias("e"), F.count(F.lit(1)).alias("n"))
    assert got.join(want, ["bldg_id", "e"]).count() == 30
    assert {r["n"] for r in got.filter("bldg_id <> 3").collect()} == {24} and got.filter("bldg_id = 3").first()["n"] == 48
    # Only the runs of the parts that are asked for are opened.
    one = incremental.hours(spark, folder, touched)
    assert {f"part={touched[0]}"} == {re.search(r"part=\d+", name)[0] for name in one.inputFiles()}

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(runs, "commit", crash)
    before = incremental.hours(spark, folder).agg(F.sum("energy_consumption")).first()[0]
    with pytest.raises(RuntimeError):
        incremental.absorb(first, folder, "three", 8)
    assert incremental.hours(spark, folder).agg(F.sum("energy_consumption")).first()[0] == before


def test_versions_of_a_dictionary(spark):
    frame = "kind string, size string"
    first = encode.fit_codes(spark.createDataFrame([("b", "x"), ("d", None)], frame)).withColumn("version", F.lit(1))
    second = encode.extended_codes(first, spark.createDataFrame([("a", "x"), ("d", "y"), ("c", "y"), (None, None)], frame))
    got = {(r["column"], r["value"]): (r["code"], r["version"]) for r in second.collect()}
    assert got == {("kind", "b"): (0, 1), ("kind", "d"): (1, 1), ("size", "x"): (0, 1), ("kind", "a"): (2, 2), ("kind", "c"): (3, 2), ("size", "y"): (1, 2)}
    assert sorted(encode.codes_of_version(second, 1).collect()) == sorted(first.drop("version").collect())
    same = encode.extended_codes(second, spark.createDataFrame([("a", "x")], frame))
    assert sorted(same.collect()) == sorted(second.collect())


def test_footers_are_enough(spark, tmp_path):
    rows = spark.range(1000).select("id", F.col("id").cast("string").alias("text"))
    rows.repartition(5).write.parquet(str(tmp_path / "t"))
    got = footer_profile(spark, str(tmp_path / "t"), "t", ["id"]).first()
    assert (got["n_rows"], got["min_id"], got["max_id"]) == (1000, 0, 999)
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    assert footer_profile(spark, str(tmp_path / "none"), "none", ["id"]).first()["n_rows"] == 0
    from wattloom.sources.tables import FOOTER_SETTINGS

    session = spark.newSession()
    for key, value in FOOTER_SETTINGS.items():
        session.conf.set(key, value)
    plan = session.read.parquet(f"{SF}/orders.parquet").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan


def test_known_state_holidays(spark):
    got = {(r["state"], str(r["day"])): r["name"] for r in state_holidays(spark, [2018, 2020, 2021, 2023]).collect()}
    assert got["LA", "2018-02-13"] == "Mardi Gras" and got["UT", "2021-07-23"] == "Pioneer Day" and got["CT", "2018-03-30"] == "Good Friday"
    assert got["VA", "2020-01-17"] == "Lee Jackson Day" and not any(state == "VA" and name.startswith("Lee") and day > "2021" for (state, day), name in got.items())
    assert ("IL", "2018-11-06") in got and ("IL", "2021-11-02") not in got and got["NV", "2018-10-26"] == "Nevada Day"
    hours = spark.createDataFrame([("TX", "2023-06-19"), ("TX", "2018-06-19"), ("UT", "2018-07-24")], "state string, d string").selectExpr("state", "cast(d as date) as day")
    flags = [(r["is_national_holiday"], r["is_state_holiday"]) for r in with_holidays(hours, state_holidays(spark, [2018, 2023])).orderBy("state", "day").collect()]
    assert flags == [(False, True), (True, False), (False, True)]
