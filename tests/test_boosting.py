from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wattloom.operators import boosting


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes by two numbers, with noise, and a null label."""
    frame = spark.range(240).select(
        F.col("id"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b"),
        F.when(F.col("id") == 7, None).otherwise(F.when(F.col("id") % 20 < 6, 0).when(F.col("id") * 7 % 11 < 5, 1).otherwise(2) + F.when(F.col("id") % 17 == 0, 1).otherwise(0)).alias("kind"),
    )
    frame = frame.withColumn("kind", F.least("kind", F.lit(2)))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame).persist()


def test_joint_boosting(spark, rows, tmp_path):
    valid = F.col("id") % 4 == 0
    model = boosting.boost(rows, "kind", 3, str(tmp_path / "m"), rounds=5, valid=valid, depth=2, rate=0.5, block=2)
    assert model.rounds == 5 and len(model.stages()) == 15
    train = [loss for _, loss, _ in model.losses]
    assert all(b < a for a, b in zip(train, train[1:]))
    # The losses are those of the margins.
    scored = boosting.margins(model, rows.filter("kind is not null"), rounds=3).withColumn("valid", valid)
    by = {r["valid"]: r["loss"] for r in scored.groupBy("valid").agg(boosting.log_loss("margins", "kind").alias("loss")).collect()}
    assert by[False] == pytest.approx(model.losses[2][1]) and by[True] == pytest.approx(model.losses[2][2])
    # First round: a leaf's value is the mean residual of its rows.
    tree = model.stages(1)[0]
    prior = [math.exp(x) for x in model.prior]
    assert sum(prior) == pytest.approx(1)
    residual = (F.col("kind") == 0).cast("double") - F.lit(prior[0])
    means = tree.transform(rows.filter(~valid).filter("kind is not null")).groupBy("tree_0").agg(F.avg(residual).alias("mean")).collect()
    assert all(r["tree_0"] == pytest.approx(r["mean"]) for r in means)
    # Margins once more in another engine, from the exported leaves.
    leaves = boosting.leaves(model, spark)
    got = boosting.margins(model, rows).select("id", "margins", vector_to_array("features").alias("x")).toPandas()
    con = duckdb.connect()
    con.register("rows", got[["id", "x"]])
    for k in range(3):
        sql = boosting.margin_sql(leaves, k, model.prior[k], "x[{place} + 1]")
        want = con.execute(f"SELECT id, {sql} AS m FROM rows ORDER BY id").df()
        assert [m[k] for m in got.sort_values("id").margins] == pytest.approx(want.m.tolist(), abs=1e-9)
    best = boosting.probabilities(model, rows).filter("kind is not null")
    assert best.filter("kind = predicted").count() > 0.85 * 239


def test_a_stopped_run_is_the_whole_run_cut(spark, rows, tmp_path):
    # Labels of chance: what is learnt does not hold for other rows.
    rows = rows.withColumn("kind", F.pmod(F.hash("id"), F.lit(3)))
    options = {"valid": F.col("id") % 4 == 0, "depth": 4, "rate": 1.0, "block": 3}
    whole = boosting.boost(rows, "kind", 3, str(tmp_path / "whole"), rounds=6, **options)
    early = boosting.boost(rows, "kind", 3, str(tmp_path / "early"), rounds=6, patience=2, **options)
    assert early.rounds < 6
    assert [x for loss in early.losses for x in loss] == pytest.approx([x for loss in whole.losses[: early.rounds] for x in loss])
    assert early.best_round() == whole.best_round() and early.rounds == early.best_round() + 2


def test_a_lost_run_goes_on(spark, rows, tmp_path, monkeypatch):
    folder = str(tmp_path / "lost")
    options = {"depth": 2, "rate": 0.5, "block": 2}
    whole = boosting.boost(rows, "kind", 3, str(tmp_path / "whole"), rounds=4, **options)
    fitted = []

    def fail_later(*args, fit=boosting.DecisionTreeRegressor.fit):
        fitted.append(1)
        if len(fitted) > 8:
            raise RuntimeError("lost")
        return fit(*args)

    monkeypatch.setattr(boosting.DecisionTreeRegressor, "fit", fail_later)
    with pytest.raises(RuntimeError):
        boosting.boost(rows, "kind", 3, folder, rounds=4, **options)
    monkeypatch.undo()
    counted = []
    monkeypatch.setattr(boosting.DecisionTreeRegressor, "fit", lambda *args, fit=boosting.DecisionTreeRegressor.fit: (counted.append(1), fit(*args))[1])
    again = boosting.boost(rows, "kind", 3, folder, rounds=4, **options)
    assert len(counted) == 6  # the first block of two rounds is not fitted again
    for (n, a, _), (m, b, _) in zip(again.losses, whole.losses, strict=True):
        assert n == m and a == pytest.approx(b)


def test_no_rows_of_a_class(spark, rows, tmp_path):
    model = boosting.boost(rows.filter("kind < 2"), "kind", 4, str(tmp_path / "m"), rounds=1, depth=1)
    got = boosting.probabilities(model, rows.filter("kind < 2"))
    assert got.filter("predicted > 1").isEmpty() and model.best_round() == 1
