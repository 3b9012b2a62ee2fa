"""Training and scoring jobs per (target, fold) on Spark ML."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import FOLDS
from wattloom.functions.order_keys import order_key
from wattloom.operators.folds import check_no_leakage, fold_split
from wattloom.operators.ranking import rank_in_group
from wattloom.operators.scoring import argmax_class, macro_f1, mean_over
from wattloom.session import cut_lineage

BELOW_ALL = -1e12


def classifier(kind: str, label: str, classes: int, inputs: int = 0, seed: int = 0, **params):
    """`gbt` (binary), `forest`, `logistic`, `one_vs_rest` or `mlp`."""
    common = {"labelCol": label, "featuresCol": "features"}
    if kind == "gbt":
        return GBTClassifier(seed=seed, **common, **params)
    if kind == "forest":
        return RandomForestClassifier(seed=seed, **common, **params)
    if kind == "logistic":
        return LogisticRegression(family="multinomial", **common, **params)
    if kind == "one_vs_rest":
        return OneVsRest(classifier=GBTClassifier(seed=seed, **params), **common)
    if kind == "mlp":
        hidden = params.pop("hidden", [32])
        return MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], seed=seed, **common, **params)
    raise ValueError(f"unknown model {kind}")


def feature_slots(numeric: Sequence[str], categorical: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """(feature, first slot, number of slots) of the feature vector; a category has a slot more, for unknown codes."""
    slots = [(name, place, 1) for place, name in enumerate(numeric)]
    place = len(numeric)
    for name, size in (categorical or {}).items():
        slots.append((name, place, size + 1))
        place += size + 1
    return slots


def feature_stages(numeric: Sequence[str], categorical: dict[str, int] | None = None, scale: bool = False) -> list:
    """Feature vector of numbers and one-hot categories of the given sizes, in the order of `feature_slots`.

    Empty slices leave nulls. Trees see them as a value below all others, so a split can set them apart;
    scaled models see 0. A code that is null or outside of its size has a slot of its own.
    """
    filled = [f"{name}_filled" for name in numeric]
    missing = 0.0 if scale else BELOW_ALL
    parts = [f"coalesce(CAST(`{name}` AS DOUBLE), {missing!r}D) AS `{new}`" for name, new in zip(numeric, filled)]
    hot = []
    for name, size in (categorical or {}).items():
        known = f"coalesce(`{name}` BETWEEN 0 AND {size - 1}, false)"
        parts += [f"CAST(`{name}` <=> {code} AS DOUBLE) AS `{name}_is_{code}`" for code in range(size)]
        parts.append(f"CAST(NOT {known} AS DOUBLE) AS `{name}_is_other`")
        hot += [*[f"{name}_is_{code}" for code in range(size)], f"{name}_is_other"]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    if scale:
        stages += [
            VectorAssembler(inputCols=filled, outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        ]
        filled = ["scaled"]
    return [*stages, VectorAssembler(inputCols=[*filled, *hot], outputCol="features")]


def train_fold(
    gold: DataFrame, target: str, split: int, numeric: Sequence[str], classes: int, kind: str = "gbt",
    categorical: dict[str, int] | None = None, info: str = "fold_info", check: bool = True, **params,
) -> PipelineModel:
    """Fit one (target, fold) on the rows that train in this split."""
    train, valid = fold_split(gold.filter(F.col(target).isNotNull()), split, info)
    if check:
        check_no_leakage(train, valid)
    inputs = len(numeric) + sum(size + 1 for size in (categorical or {}).values())
    model = classifier(kind, target, classes, inputs, **params)
    stages = feature_stages(numeric, categorical, scale=kind in ("mlp", "logistic"))
    columns = [*numeric, *(categorical or {}), target]
    return Pipeline(stages=[*stages, model]).fit(train.select(*columns))


def train_target(
    gold: DataFrame, target: str, numeric: Sequence[str], classes: int, folds: int = FOLDS, parallel: int = 1, **params
) -> list[PipelineModel]:
    """One model per fold, `parallel` fits in flight. The threads only submit jobs; the rows stay on the executors."""
    def fit(split: int) -> PipelineModel:
        return train_fold(gold, target, split, numeric, classes, **params)

    with ThreadPool(parallel) as pool:
        return pool.map(inheritable_thread_target(gold.sparkSession)(fit), range(folds))


def save_models(models: Sequence[PipelineModel], folder: str) -> None:
    for fold, model in enumerate(models):
        model.write().overwrite().save(f"{folder}/fold_{fold}")


def load_models(folder: str, folds: int = FOLDS) -> list[PipelineModel]:
    return [PipelineModel.load(f"{folder}/fold_{fold}") for fold in range(folds)]


LEAF = re.compile(r"Predict: (\S+)")


def boosters(classifier_model: Model) -> list[GBTClassificationModel]:
    """The boosted trees of a classifier: one ensemble, or one per class; none for other kinds."""
    if isinstance(classifier_model, GBTClassificationModel):
        return [classifier_model]
    if isinstance(classifier_model, OneVsRestModel):
        return list(classifier_model.models)
    return []


def leaf_values(booster: GBTClassificationModel) -> list[list[float]]:
    """Per tree its weighted predictions in the order of the leaves; at most rounds x 2^depth numbers."""
    return [
        [weight * float(value) for value in LEAF.findall(tree.toDebugString)]
        for tree, weight in zip(booster.trees, booster.treeWeights, strict=True)
    ]


def _with_tree_outputs(classifier_model: Model, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """`rows` with one array of tree outputs per booster.

    A tree's output is the value of the leaf that the row reaches. The values are one literal, so the plan does
    not grow with the number of trees.
    """
    names = []
    for number, booster in enumerate(boosters(classifier_model)):
        name = f"_outputs_{number}"
        values = F.from_json(F.lit(json.dumps(leaf_values(booster))), "array<array<double>>")
        leaves = booster.copy().setLeafCol("_leaves").transform(rows)
        outputs = F.zip_with(vector_to_array("_leaves"), values, lambda leaf, tree: F.get(tree, leaf.cast("int")))
        rows = leaves.select(*rows.columns, outputs.alias(name))
        names.append(name)
    return rows, names


def _chance(margin: Column) -> Column:
    return 1 / (1 + F.exp(-2 * margin))


def classified(classifier_model: Model, rows: DataFrame, result: str, rounds: int | None = None) -> DataFrame:
    """`rows` (with `features`) and the array of class probabilities; of the first `rounds` boosting rounds if given.

    One model per class has margins, read through the logistic function.
    """
    if rounds is not None and boosters(classifier_model):
        with_outputs, names = _with_tree_outputs(classifier_model, rows)
        chances = [
            _chance(F.aggregate(F.slice(name, 1, rounds), F.lit(0.0), lambda total, x: total + x)) for name in names
        ]
        values = F.array(1 - chances[0], chances[0]) if len(chances) == 1 else F.array(*chances)
        return with_outputs.select(*rows.columns, values.alias(result))
    scored = classifier_model.transform(rows)
    if "probability" in scored.columns:
        values = vector_to_array("probability")
    else:
        values = F.transform(vector_to_array("rawPrediction"), _chance)
    return scored.select(*rows.columns, values.alias(result))


def prepared(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """`rows` with the feature vector of the model."""
    plain = rows.drop("features")
    return PipelineModel(model.stages[:-1]).transform(plain).select(*plain.columns, "features")


def _preparation(model: PipelineModel) -> str | None:
    """What tells the steps before the classifier apart; None if they hold fitted statistics."""
    steps = model.stages[:-1]
    if not all(isinstance(step, (SQLTransformer, VectorAssembler)) for step in steps):
        return None
    return "|".join(step.getStatement() if isinstance(step, SQLTransformer) else ",".join(step.getInputCols()) for step in steps)


def predicted_classes(
    models: dict[str, Sequence[PipelineModel]], rows: DataFrame, rounds: dict[str, int] | None = None, entity: str = "bldg_id"
) -> DataFrame:
    """One row per entity, per target the most probable class in the mean over its fold models (the first on a tie).

    All models are applied one after the other to the same rows: one scan whatever their number, and no shuffle. Models that
    prepare their features alike share the vector.
    """
    out, ready = rows, None
    targets = {}
    for place, (target, fold_models) in enumerate(models.items()):
        parts = []
        for fold, model in enumerate(fold_models):
            steps = _preparation(model)
            if steps is None or steps != ready:
                out, ready = prepared(model, out), steps
            parts.append(f"_chances_{fold}")
            out = classified(model.stages[-1], out, parts[-1], (rounds or {}).get(target))
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), map(F.col, parts))
        mean = F.transform(total, lambda x: F.round(x / len(parts), 12))
        targets[target] = f"_class_{place}"
        out = out.withColumn(targets[target], argmax_class(mean)).drop(*parts)
    return out.select(entity, *[F.col(name).alias(target) for target, name in targets.items()])


def _long(scored: DataFrame, keep: Sequence[str], target: str, fold: int) -> DataFrame:
    return scored.select(
        *keep, F.lit(target).alias("target"), F.lit(fold).alias("fold"), F.posexplode("_chances").alias("class", "probability")
    )


def predict_folds(models: Sequence[PipelineModel], rows: DataFrame, target: str, entity: str = "bldg_id") -> DataFrame:
    """Long (entity, target, fold, class, probability) of every fold model for every row."""
    parts = [
        _long(classified(model.stages[-1], prepared(model, rows), "_chances"), [entity], target, fold)
        for fold, model in enumerate(models)
    ]
    return reduce(DataFrame.unionByName, parts)


def validation(gold: DataFrame, target: str, fold: int) -> DataFrame:
    _, valid = fold_split(gold.filter(F.col(target).isNotNull()), fold)
    return valid.withColumn("label", F.col(target).cast("int"))


def out_of_fold(
    models: Sequence[PipelineModel], gold: DataFrame, target: str, rounds: int | None = None, entity: str = "bldg_id"
) -> DataFrame:
    """Probabilities of each row from the model that did not train on it, with the label."""
    return reduce(DataFrame.unionByName, [out_of_fold_of(model, gold, target, fold, rounds, entity) for fold, model in enumerate(models)])


def out_of_fold_of(
    model: PipelineModel, gold: DataFrame, target: str, fold: int, rounds: int | None = None, entity: str = "bldg_id"
) -> DataFrame:
    """`out_of_fold` of one fold's model, whose features may be its own."""
    rows = prepared(model, validation(gold, target, fold))
    return _long(classified(model.stages[-1], rows, "_chances", rounds), [entity, "label"], target, fold)


def out_of_fold_f1(probabilities: DataFrame, entity: str = "bldg_id") -> DataFrame:
    """Macro-F1 per (target, fold) of the most probable classes of `out_of_fold` rows."""
    best = F.max(F.struct(F.round("probability", 12).alias("p"), (-F.col("class")).alias("c")))["c"]
    chosen = probabilities.groupBy(entity, "target", "fold", "label").agg((-best).alias("predicted"))
    return macro_f1(chosen, "label", "predicted", ["target", "fold"])


def gains(models: Sequence[PipelineModel], target: str, slots: Sequence[tuple[str, int, int]], spark: SparkSession) -> DataFrame:
    """Gain importance as (target, fold, feature, gain); a category has the sum of its slots."""
    rows = []
    for fold, model in enumerate(models):
        last = model.stages[-1]
        parts = last.models if isinstance(last, OneVsRestModel) else [last]
        weights = sum(part.featureImportances.toArray() for part in parts) / len(parts)
        rows += [(target, fold, name, float(weights[first : first + size].sum())) for name, first, size in slots]
    return spark.createDataFrame(rows, "target string, fold int, feature string, gain double")


def boosting_curve(models: Sequence[PipelineModel], gold: DataFrame, target: str, entity: str = "bldg_id") -> DataFrame:
    """Macro-F1 per (target, fold, iteration) of boosted trees, binary or one per class, on their validation rows.

    The margin after i rounds is the running sum of the tree outputs; all rounds of a row come from one pass over it.
    """
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("steps"))

    def add(state: Column, x: Column) -> Column:
        total = state["total"] + x
        return F.struct(total.alias("total"), F.concat(state["steps"], F.array(total)).alias("steps"))

    curves = []
    for fold, model in enumerate(models):
        rows, names = _with_tree_outputs(model.stages[-1], prepared(model, validation(gold, target, fold)).select("label", "features"))
        running = [F.aggregate(name, start, add, lambda state: state["steps"]).alias(name) for name in names]
        steps = rows.select("label", *running).select("label", F.posexplode(F.arrays_zip(*names)).alias("iteration", "margin"))
        margins = [F.col("margin")[name] for name in names]
        predicted = (margins[0] > 0).cast("int") if len(names) == 1 else argmax_class(F.array(*margins))
        curve = macro_f1(steps.select("label", "iteration", predicted.alias("predicted")), "label", "predicted", ["iteration"])
        curves.append(
            curve.select(
                F.lit(target).alias("target"), F.lit(fold).alias("fold"), "iteration", F.lit("f1").alias("metric"), F.col("f1").alias("value")
            )
        )
    return reduce(DataFrame.unionByName, curves)


def donor_pairs(rows: DataFrame, repetition: int = 0, seed: int = 0, entity: str = "bldg_id") -> DataFrame:
    """(entity, donor): every row with its successor by a fixed distance in a pseudo-random order; a permutation."""
    ranked = rank_in_group(
        rows.select(entity, F.lit(0).alias("_all")), ["_all"], order_key(f"{seed}-{repetition}", entity), "_rank"
    )
    size = rows.agg(F.count(F.lit(1))).scalar()
    distance = 1 + F.pmod(F.lit(7919 * (repetition + 1) + seed), F.greatest(size - 1, F.lit(1)))
    donors = ranked.select(F.pmod(F.col("_rank") - distance, size).alias("_rank"), F.col(entity).alias("donor"))
    return ranked.join(donors, "_rank").select(entity, "donor")


def permutation_importance(
    models: Sequence[PipelineModel], gold: DataFrame, target: str, slots: Sequence[tuple[str, int, int]],
    repetitions: int = 3, seed: int = 0, entity: str = "bldg_id",
) -> DataFrame:
    """Macro-F1 lost when one feature is permuted inside the validation fold, mean over folds and repetitions.

    Per fold and repetition every row has a donor; the narrow pairs are stored once. A row carries its own and its donor's
    feature vector and is scored once per feature with that feature's slots from the donor. The variants stream into
    counts per (feature, label, prediction) before anything is shuffled, and the plan has one expression for all features.
    """
    feature_list = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(first).alias("first"), F.lit(size).alias("size")) for name, first, size in slots]
    )
    total = sum(size for _, _, size in slots)
    parts = []
    for fold, model in enumerate(models):
        valid = prepared(model, validation(gold, target, fold)).select(entity, "label", vector_to_array("features").alias("own"))
        last = model.stages[-1]

        def scored(rows: DataFrame, feature: Column, repetition: int, last: Model = last, fold: int = fold) -> DataFrame:
            return last.transform(rows).select(
                feature.alias("feature"), F.lit(fold).alias("fold"), F.lit(repetition).alias("repetition"), "label",
                F.col("prediction").cast("int").alias("predicted"),
            )

        parts.append(scored(valid.select("label", array_to_vector("own").alias("features")), F.lit(""), 0))
        for repetition in range(repetitions):
            pairs = cut_lineage(donor_pairs(valid, repetition, seed, entity))
            donors = valid.select(F.col(entity).alias("donor"), F.col("own").alias("other"))
            paired = valid.join(pairs, entity).join(donors, "donor").select("label", "own", "other")
            one = paired.select("label", "own", "other", F.explode(feature_list).alias("part"))
            first, size = F.col("part.first"), F.col("part.size")
            changed = F.concat(
                F.slice("own", 1, first), F.slice("other", first + 1, size), F.slice("own", first + size + 1, F.lit(total))
            )
            rows = one.select("label", F.col("part.name").alias("name"), array_to_vector(changed).alias("features"))
            parts.append(scored(rows, F.col("name"), repetition))
    f1 = macro_f1(reduce(DataFrame.unionByName, parts), "label", "predicted", ["feature", "fold", "repetition"])
    mean = mean_over(mean_over(f1, ["feature", "fold"]), ["feature"])
    # One row per feature.
    base = F.max(F.when(F.col("feature") == "", F.col("f1"))).over(Window.partitionBy())
    return (
        mean.withColumn("importance", base - F.col("f1"))
        .filter(F.col("feature") != "")
        .select(F.lit(target).alias("target"), "feature", "importance")
    )
