from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wattloom.catalog.training import TEXT_FEATURES, document_gold
from wattloom.operators import boosting, folds, models, tree_index
from wattloom.operators.rates import rated_split, with_category_rates

SF = "/root/testdata/sf0.001"


def test_index_equals_scoring_every_variant(spark):
    """One ensemble per class, with a category of several slots."""
    gold = spark.range(150).select(
        F.col("id").alias("bldg_id"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") * 13 % 17).cast("double").alias("noise"),
        (F.col("id") % 3 * 10 + F.col("id") % 4).cast("double").alias("told"), F.lit(1.0).alias("flat"),
        F.when(F.col("id") % 6 != 5, F.col("id") % 6).cast("int").alias("kind"),
        F.when(F.col("id") % 2 == 0, "t, v").otherwise("v, t").alias("fold_info"),
    )
    slots = models.feature_slots(["noise", "told", "flat"], {"kind": 5})
    fitted = models.train_target(
        gold, "y", ["noise", "told", "flat"], 3, 2, kind="one_vs_rest", categorical={"kind": 5}, maxIter=2, maxDepth=3
    )
    got, want = (
        {r["feature"]: r["importance"] for r in how(fitted, gold, "y", slots, 2).collect()}
        for how in (tree_index.permutation_importance, models.permutation_importance)
    )
    assert got == pytest.approx(want) and got["flat"] == 0 and max(got.values()) > 0.1
    index = tree_index.indexed(fitted[0].stages[-1], slots)
    assert index.entries() <= sum(len(leaf.features) for ensemble in index.leaves for leaf in ensemble)
    assert set(index.used()) < set(range(4))


def test_variants_of_a_joint_model(spark, tmp_path):
    """Every variant of every row, against margins of vectors with the feature replaced."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 6, (60, 4)).astype(float)
    frame = spark.createDataFrame([(int(v.sum()) % 3, *map(float, v)) for v in values], "y int, a double, b double, c double, d double")
    rows = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(frame)
    model = boosting.boost(rows, "y", 3, str(tmp_path / "m"), rounds=2, depth=3, block=2)
    slots = [("a", 0, 1), ("bc", 1, 2), ("d", 3, 1)]
    index = tree_index.indexed(model, slots)
    other = np.roll(values, 1, axis=0)
    base, change = tree_index.variant_margins(index, values, other)

    def plain(matrix):
        out = np.tile(model.prior, (len(matrix), 1))
        for number, tree in enumerate(model.stages()):
            for value, conditions in boosting.tree_leaves(tree):
                here = np.ones(len(matrix), bool)
                for place, sign, threshold in conditions:
                    here &= (matrix[:, place] <= threshold) if sign == "<=" else (matrix[:, place] > threshold)
                out[here, number % 3] += value * model.rate
        return out

    assert np.allclose(base, plain(values))
    for feature, (_, first, size) in enumerate(slots):
        variant = values.copy()
        variant[:, first : first + size] = other[:, first : first + size]
        assert np.allclose(base + change[:, :, feature].T, plain(variant))


def test_only_boosted_trees_have_an_index(spark):
    forest = models.train_fold(document_gold(spark, SF), "quality", 0, TEXT_FEATURES, 2, kind="forest", numTrees=1, maxDepth=1)
    with pytest.raises(ValueError):
        tree_index.indexed(forest.stages[-1], models.feature_slots(TEXT_FEATURES))


def test_iterative_folds(spark):
    """A rare label that always comes with a frequent one, nulls, and rows without any label."""
    rows = spark.range(403).select(
        F.col("id").alias("bldg_id"),
        F.when(F.col("id") < 300, "hot").when(F.col("id") < 320, "cold").alias("a"),
        F.when(F.col("id") < 11, "rare").when(F.col("id") < 160, (F.col("id") % 3).cast("string")).alias("b"),
        F.lit("x").alias("_all"),
    )
    got = folds.iterative_folds(rows, ["a", "b"], 5).toPandas()
    assert sorted(got.bldg_id) == list(range(403)) and got.fold.between(0, 4).all() and list(got.columns) == ["bldg_id", "a", "b", "_all", "fold"]
    for name in ("a", "b"):
        for _, part in got[got[name].notna()].groupby(name):
            counts = part.fold.value_counts().reindex(range(5), fill_value=0)
            assert counts.max() - counts.min() <= 2
    sizes = got.fold.value_counts()
    assert sizes.max() - sizes.min() <= 3
    again = folds.iterative_folds(rows.repartition(7), ["a", "b"], 5).toPandas()
    assert got.set_index("bldg_id").fold.sort_index().equals(again.set_index("bldg_id").fold.sort_index())
    none = folds.iterative_folds(rows.select("bldg_id", F.lit(None).cast("string").alias("a")), ["a"], 2).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in none) == [201, 202]
    assert folds.iterative_folds(rows.limit(0), ["a"], 2).collect() == []


def test_quotas():
    assert folds._quotas([2.4, 2.4, 2.2], 7, [0, 0, 0]) == [3, 2, 2]
    assert folds._quotas([-1, 0.5, 0.5], 1, [0, 1, 2]) == [0, 0, 1]
    assert folds._quotas([0, 0], 3, [1, 0]) == [2, 1]


def test_rates_see_no_label_of_their_own_fold(spark):
    """Against plain counting: hot, rare, null and unknown categories, rows without a label or a fold."""
    rows = [
        (i, None if i % 11 == 0 else ("hot" if i % 3 else f"c{i % 40}"), None if i % 13 == 0 else i % 2 if i % 5 else 1, None if i % 17 == 0 else i % 3)
        for i in range(200)
    ] + [(900, "only unlabelled", None, 1), (901, "one fold", 1, 2)]
    frame = spark.createDataFrame(rows, "bldg_id long, kind string, y int, fold int")

    def plain(kind, fold, seen):
        def counts(keep):
            return [sum(1 for r in seen if r[2] == k and keep(r) and (fold is None or r[3] != fold)) for k in range(2)]

        mine, every = counts(lambda r: r[1] == kind), counts(lambda r: True)
        return [(mine[k] + 20.0 * every[k] / sum(every)) / (sum(mine) + 20.0) for k in range(2)]

    for split in (None, 1):
        got = (with_category_rates(frame, "kind", "y", 2) if split is None else rated_split(frame, "kind", "y", 2, split)).collect()
        seen = [r for r in rows if r[2] is not None and (split is None or r[3] != split)]
        assert len(got) == len(rows)
        for r in got:
            assert np.allclose([r.kind_rate_0, r.kind_rate_1], plain(r.kind, r.fold, seen)), r
    none = with_category_rates(frame.filter("y is null"), "kind", "y", 2).collect()
    assert len(none) == sum(r[2] is None for r in rows) and all(r.kind_rate_0 == r.kind_rate_1 == 0 for r in none)
    assert with_category_rates(frame.limit(0), "kind", "y", 2).collect() == []
