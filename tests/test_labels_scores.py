from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import ALL_TARGETS, CENSUS_FACTS, ORDINAL_LEVELS, STATE_CODES, safe_name
from wattloom.functions.text import amount_to_number, percent_to_share, target_class
from wattloom.operators import encode as enc
from wattloom.operators import ensemble, folds, importance, scoring, statistics
from wattloom.operators.facts import economics
from wattloom.operators.metadata import diagonal_union, renumbered, with_suffix
from wattloom.operators.ranking import first_ids, random_ids
from wattloom.sources import write
from wattloom.sources.census import read_economics
from wattloom.sources.tables import read_codes


def test_fixed_values():
    assert len(ALL_TARGETS) == 25 and len(CENSUS_FACTS) == 63 and len(STATE_CODES) == 51
    assert len(ORDINAL_LEVELS["in.weekday_opening_time..hr_com"]) == 36
    assert len(ORDINAL_LEVELS["in.weekday_operating_hours..hr_com"]) == 53
    assert ORDINAL_LEVELS["in.weekday_operating_hours..hr_com"][:3] == ["5.75", "6", "6.25"]
    assert STATE_CODES["AK"] == 0 and STATE_CODES["MO"] == 24 and STATE_CODES["WY"] == 50


def test_fact_texts(spark):
    frame = spark.createDataFrame([("1.7%",), ("Z",), ("-1.4%",)], "t string")
    assert [row[0] for row in frame.select(percent_to_share(F.col("t"))).collect()] == pytest.approx([0.017, 0.0, -0.014])
    frame = spark.createDataFrame([("$1,234",), ("S",), ("43,210.23",), ("x",)], "t string")
    assert [row[0] for row in frame.select(amount_to_number(F.col("t"))).collect()] == [1234.0, None, 43210.23, None]


def test_census_sheets(spark, tmp_path):
    """Two sheets with different states; notes between the states and footnotes below the facts."""
    facts = list(CENSUS_FACTS)

    def sheet(path, states, value):
        lines = [",".join(['"Fact"', '"Fact Note"'] + [x for s in states for x in (f'"{s}"', f'"Value Note for {s}"')])]
        for place, fact in enumerate(facts):
            cell = "1.5%" if place == 0 else value
            lines.append(",".join([f'"{fact}"', '"(a)"'] + [x for _ in states for x in (f'"{cell}"', '""')]))
        lines += ['"FIPS Code",""' + ',"""02""",""' * len(states), '"Value Flags",""' + ',"",""' * len(states)]
        path.write_text("\n".join(lines))
        return str(path)

    paths = [sheet(tmp_path / "a.csv", ["Alaska", "Alabama"], "1,234"), sheet(tmp_path / "b.csv", ["District of Columbia"], "$7")]
    rows = {row["state"]: row for row in read_economics(spark, paths).collect()}
    assert sorted(rows) == [0, 1, 7]
    assert rows[0][CENSUS_FACTS[facts[0]]] == pytest.approx(0.015)
    assert rows[1]["land_area_2010"] == 1234 and rows[7]["land_area_2010"] == 7
    assert len(rows[0]) == 64


def test_percent_is_a_property_of_the_fact(spark):
    long = spark.createDataFrame([("P", "Alaska", "Z"), ("P", "Alabama", "50%"), ("Q", "Alaska", "9"), ("Q", "Alabama", None)], "fact string, state string, value string")
    rows = {row["state"]: row for row in economics(long, {"P": "p", "Q": "q"}).collect()}
    assert (rows[0]["p"], rows[0]["q"], rows[1]["p"], rows[1]["q"]) == (0.0, 9.0, 0.5, None)


def test_dictionaries(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", "2"), (2, "a", "10"), (3, None, "1")], "bldg_id long, kind string, in_bedrooms_res string")
    codes = enc.with_ordinal_order(enc.fit_codes(rows), enc.ordinal_codes(spark))
    maps = enc.as_maps(codes)
    assert maps["kind"] == {"a": 0, "b": 1} and maps["in_bedrooms_res"] == {"1": 0, "2": 1, "3": 2, "4": 3, "5": 4}
    coded = enc.encode(rows, maps).orderBy("bldg_id").collect()
    assert [(row["kind"], row["in_bedrooms_res"]) for row in coded] == [(1, 1), (0, None), (None, 0)]
    back = enc.decode(enc.encode(rows, maps), maps).orderBy("bldg_id").collect()
    assert [row["kind"] for row in back] == ["b", "a", None]
    write.codes_json(codes.withColumn("dataset", F.lit("train_label")), str(tmp_path / "m"))
    assert read_codes(spark, str(tmp_path / "m")).drop("dataset").exceptAll(codes.select("column", "value", "code")).isEmpty()
    kept = spark.createDataFrame([("a",), ("z",)], "v string").select(enc.lookup_or_keep({"a": "x"}, F.col("v")))
    assert [row[0] for row in kept.collect()] == ["x", "z"]


def test_dictionary_of_any_width(spark):
    rows = spark.range(1000).select(F.col("id").alias("bldg_id"), F.concat(F.lit("v"), F.col("id")).alias("kind"), F.lit("x").alias("other"))
    codes = enc.fit_codes(rows)
    assert codes.groupBy("column").agg(F.min("code"), F.max("code"), F.count_distinct("code")).orderBy("column").collect() == [
        ("kind", 0, 999, 1000), ("other", 0, 0, 1)
    ]
    joined = enc.encode_by_join(rows, codes, ["kind", "other"])
    assert joined.select("kind").distinct().count() == 1000
    assert enc.decode_by_join(joined, codes, ["kind", "other"]).exceptAll(rows).isEmpty()


def test_folds(spark):
    sizes = {"a": 1, "b": 3, "c": 7, "d": 20}
    rows = spark.createDataFrame([(i * 100 + j, c) for i, (c, n) in enumerate(sizes.items()) for j in range(n)], "bldg_id long, c string")
    out = folds.stratified_folds(rows, "c")
    again = folds.stratified_folds(rows.orderBy(F.rand()), "c")
    assert out.exceptAll(again).isEmpty()
    total = [row["count"] for row in out.groupBy("fold").count().collect()]
    assert max(total) - min(total) <= 1 and sum(total) == 31
    per_class = out.groupBy("c").pivot("fold", [0, 1, 2, 3, 4]).count().na.fill(0).collect()
    assert all(max(row[1:]) - min(row[1:]) <= 1 for row in per_class)
    text = out.withColumn("info", folds.fold_info(F.col("fold"))).filter("fold = 1").first()["info"]
    assert text == "t, v, t, t, t"
    train, valid = folds.fold_split(out.withColumn("fold_info", folds.fold_info(F.col("fold"))), 1)
    assert train.count() + valid.count() == 31
    folds.check_no_leakage(train, valid)
    with pytest.raises(ValueError):
        folds.check_no_leakage(train, train)


def test_missing_fold_is_n(spark):
    row = spark.range(1).select(folds.fold_info(F.lit(None).cast("int"), 3)).first()
    assert row[0] == "n, n, n"


def test_population(spark):
    rows = spark.createDataFrame([(1, 0, 3, None), (2, 1, 5, 4), (3, 1, None, None)], "bldg_id long, building_stock_type int, x_com int, y_res int")
    out = folds.long_labels(rows, ["building_stock_type", "x_com", "y_res"]).collect()
    assert sorted((r["bldg_id"], r["target"], r["code"]) for r in out) == [
        (1, "building_stock_type", 0), (1, "x_com", 3), (2, "building_stock_type", 1), (2, "y_res", 4), (3, "building_stock_type", 1),
    ]


def test_macro_f1_over_the_union_of_classes(spark):
    rows = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 1)], "y int, p int")
    # Class 0: 2/3, class 1: 1, class 2 (never true): 0.
    assert scoring.macro_f1(rows, "y", "p").first()["f1"] == pytest.approx((2 / 3 + 1 + 0) / 3)


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double")
    assert scoring.roc_auc(rows, "y", "s").first()["auc"] == pytest.approx(0.875)


def test_softmax_survives_large_logits(spark):
    rows = spark.createDataFrame([(1, "t", 0, 1000.0), (1, "t", 1, 1000.0)], "bldg_id long, target string, class int, logit double")
    assert [r["probability"] for r in scoring.softmax(rows, "logit", ["bldg_id", "target"]).collect()] == [0.5, 0.5]


def test_best_iteration_and_final_score(spark):
    curve = [("building_stock_type", f, i, "f1", v) for f in (0, 1) for i, v in enumerate((0.5, 0.9, 0.9))]
    curve += [("a_com", f, i, "f1", v) for f in (0, 1) for i, v in enumerate((0.4, 0.2, 0.1))]
    curve += [("b_res", f, i, "f1", v + f) for f in (0, 1) for i, v in enumerate((0.0, 0.1, 0.3))]
    frame = spark.createDataFrame(curve, "target string, fold int, iteration int, metric string, value double")
    best = scoring.best_iteration(frame, "f1")
    rows = {r["target"]: r for r in best.collect()}
    assert {t: r["best_epoch"] for t, r in rows.items()} == {"building_stock_type": 2, "a_com": 1, "b_res": 3}
    assert rows["b_res"]["best_std"] == pytest.approx(math.sqrt(0.5))
    assert scoring.weighted_score(best).first()["score"] == pytest.approx(0.4 * 0.9 + 0.6 * (0.5 * 0.4 + 0.5 * 0.8))


def test_importance(spark):
    gains = spark.createDataFrame([("t", 0, "f_1_x", 5.0), ("t", 1, "f_2_x", 10.0), ("t", 1, "g", 1.0)], "target string, fold int, feature string, gain double")
    average = importance.average_importance(gains, 5)
    assert {r["feature"]: r["average"] for r in average.collect()} == {"f_1_x": 1.0, "f_2_x": 2.0, "g": 0.2}
    templates = {r["feature_cluster"]: (r["mean"], r["count"], r["rank"]) for r in importance.template_importance(average).collect()}
    assert templates == {r"f_\d+_x": (1.5, 2, 0), "g": (0.2, 1, 1)}


def test_ensemble(spark):
    rows = [(1, "x_com", f, c, p) for f in (0, 1) for c, p in enumerate((0.4, 0.4, 0.2))]
    rows += [(1, "building_stock_type", f, 1, p) for f, p in ((0, 0.25), (1, 0.75))]
    frame = spark.createDataFrame(rows, "bldg_id long, target string, fold int, class int, probability double")
    table = ensemble.predict_table(ensemble.predicted_class(ensemble.blend(frame, 2)), ["building_stock_type", "x_com"])
    assert table.collect()[0].asDict() == {"bldg_id": 1, "building_stock_type": 0, "x_com": 0}
    decoded = spark.createDataFrame([("commercial", "a", "b"), ("residential", "a", "b"), (None, "a", "b")], "building_stock_type string, x_com string, y_res string")
    out = ensemble.null_out(decoded, ["building_stock_type", "x_com", "y_res"]).collect()
    assert [tuple(r) for r in out] == [("commercial", "a", None), ("residential", None, "b"), (None, "a", "b")]


def test_samples_and_ids(spark):
    ids = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(2).alias("state"), (F.col("id") % 950).alias("bldg_id"))
    first = first_ids(ids, ["state"], 30).filter("state = 1").collect()
    assert sorted(r["bldg_id"] for r in first) == list(range(30))
    drawn = random_ids(ids, ["state"], 30, seed=4)
    assert drawn.exceptAll(random_ids(ids.orderBy(F.rand()), ["state"], 30, seed=4)).isEmpty()
    res = with_suffix(spark.createDataFrame([(2, "r"), (10, "q")], "bldg_id long, in_x string"), "res", "residential")
    com = with_suffix(spark.createDataFrame([(2, "c")], "bldg_id long, in_x string"), "com", "commercial")
    renamed, mapping = renumbered(diagonal_union(res, com))
    assert {(r["build_type"], r["bldg_id"]): r["new_id"] for r in mapping.collect()} == {
        ("commercial", 2): 30000, ("residential", 10): 30001, ("residential", 2): 30002,
    }
    assert {(r["bldg_id"], r["in_x_res"], r["in_x_com"]) for r in renamed.collect()} == {(30000, None, "c"), (30001, "q", None), (30002, "r", None)}


def test_statistics(spark):
    frame = spark.createDataFrame([(1.0, None), (2.0, 1), (3.0, 1)], "x double, k int")
    assert statistics.distinct_count(frame, "k").first()["n"] == 2
    assert [r["x"] for r in statistics.standardize(frame, ["x"]).collect()] == [-1.0, 0.0, 1.0]


def test_target_class(spark):
    names = [safe_name(name) for name in ALL_TARGETS]
    frame = spark.createDataFrame([(name,) for name in names], "t string").groupBy(target_class(F.col("t")).alias("c")).count()
    assert {r["c"]: r["count"] for r in frame.collect()} == {"binary": 1, "commercial": 11, "residential": 13}
