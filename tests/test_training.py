from __future__ import annotations

import pytest

from wattloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name,columns",
    [
        ("train_score_binary", {"bldg_id", "target", "code"}),
        ("boosting_curve", {"target", "fold", "iteration", "metric", "value", "best_epoch", "best_score", "best_std"}),
        ("gain_importance", {"target", "feature", "average"}),
        ("permutation_importance", {"target", "feature", "importance"}),
        ("train_score_multi", {"fold", "f1"}),
        ("mlp_score", {"bldg_id", "label", "predicted"}),
    ],
)
def test_training_jobs(spark, name, columns):
    out = catalog.queries()[name](spark, SF)
    assert set(out.columns) == columns
    assert out.count() > 0


def test_submission_nulls_the_other_kind(spark):
    rows = catalog.queries()["score_submission"](spark, SF).collect()
    assert rows
    for row in rows:
        if row["building_stock_type"] == "commercial":
            assert row["in_bedrooms_res"] is None and row["in_heating_fuel_com"] is not None
        else:
            assert row["in_heating_fuel_com"] is None and row["in_bedrooms_res"] is not None


def test_last_boosting_round_is_the_model(spark):
    """The running margin over all trees gives the model's own predictions."""
    from pyspark.sql import functions as F

    from wattloom.catalog.training import document_gold, quality_models
    from wattloom.operators import models, scoring
    from wattloom.operators.folds import fold_split

    gold = document_gold(spark, SF)
    trained = quality_models(gold, maxIter=3, maxDepth=2)
    curve = {(r["fold"], r["iteration"]): r["value"] for r in models.boosting_curve(trained, gold, "quality").collect()}
    for fold, model in enumerate(trained):
        valid = fold_split(gold, fold)[1]
        scored = model.transform(valid).select("quality", F.col("prediction").cast("int").alias("predicted"))
        assert curve[fold, 2] == pytest.approx(scoring.macro_f1(scored, "quality", "predicted").first()["f1"])
    rows = models.out_of_fold(trained, gold, "quality")
    assert rows.select("bldg_id").distinct().count() * 2 == rows.count() == gold.count() * 2


def test_donors_are_a_permutation_without_fixed_rows(spark):
    from pyspark.sql import functions as F

    from wattloom.operators.models import donor_pairs

    rows = spark.range(101).select(F.col("id").alias("bldg_id"))
    for repetition in range(3):
        pairs = donor_pairs(rows, repetition).collect()
        assert sorted(row["bldg_id"] for row in pairs) == sorted(row["donor"] for row in pairs) == list(range(101))
        assert all(row["donor"] != row["bldg_id"] for row in pairs)


def test_one_scan_and_no_shuffle_for_all_models(spark, tmp_path):
    """A chain of models gives what the long form gives, from one scan."""
    import re

    from wattloom.catalog.training import TEXT_FEATURES, document_gold
    from wattloom.operators import ensemble, models

    document_gold(spark, SF).write.parquet(str(tmp_path / "gold"))
    gold = spark.read.parquet(str(tmp_path / "gold"))
    fitted = {
        kind: models.train_target(gold, "quality", TEXT_FEATURES, 2, 3, kind=kind, parallel=3, **params)
        for kind, params in {"gbt": {"maxIter": 2, "maxDepth": 2}, "forest": {"numTrees": 2, "maxDepth": 2}, "logistic": {"maxIter": 3}}.items()
    }
    classes = models.predicted_classes(fitted, gold)
    plan = classes._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan|Scan parquet", plan)) == 1 and "Exchange" not in plan
    got = {row["bldg_id"]: row.asDict() for row in classes.collect()}
    for kind, fold_models in fitted.items():
        long = ensemble.predicted_class(ensemble.blend(models.predict_folds(fold_models, gold, kind), 3))
        assert {row["bldg_id"]: row["code"] for row in long.collect()} == {key: row[kind] for key, row in got.items()}


def test_importance_of_a_category_and_of_noise(spark):
    """A forest that can only use the category loses its score when that is permuted, and nothing by the constant."""
    from pyspark.sql import functions as F

    from wattloom.operators import models

    gold = spark.range(200).select(
        F.col("id").alias("bldg_id"), (F.col("id") % 2).cast("int").alias("y"), F.lit(1.0).alias("flat"),
        F.when(F.col("id") % 2 == 1, 5).cast("int").alias("kind"),
        F.when(F.col("id") % 4 < 2, "t, v").otherwise("v, t").alias("fold_info"),
    )
    slots = models.feature_slots(["flat"], {"kind": 8})
    assert slots == [("flat", 0, 1), ("kind", 1, 9)]
    fitted = models.train_target(gold, "y", ["flat"], 2, 2, kind="forest", categorical={"kind": 8}, numTrees=3, maxDepth=2)
    lost = {row["feature"]: row["importance"] for row in models.permutation_importance(fitted, gold, "y", slots, 2).collect()}
    assert lost["flat"] == 0 and lost["kind"] > 0.3
    gains = {row["feature"]: row["gain"] for row in models.gains(fitted, "y", slots, spark).filter("fold = 0").collect()}
    assert gains == {"flat": 0.0, "kind": 1.0}
