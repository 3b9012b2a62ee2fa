"""Blend fold models and shape the prediction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import BINARY_TARGET
from wattloom.operators.joins import join_bounded


def at_best_iteration(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """Predictions of each target at its best epoch; `best` has one row per target."""
    chosen = best.select("target", (F.col("best_epoch") - 1).alias("iteration"))
    return join_bounded(predictions, chosen, ["target", "iteration"], "inner")


def blend(predictions: DataFrame, folds: int, entity: str = "bldg_id") -> DataFrame:
    """Sum of the fold probabilities over the number of folds, per (entity, target, class).

    Fold models score in different tasks, so summing before the shuffle would not shrink anything. Rows
    are hashed by entity instead, and the class choice and the pivot by entity need no further shuffle.
    An entity has at most targets x classes x folds rows.
    """
    return predictions.repartition(entity).groupBy(entity, "target", "class").agg((F.sum("probability") / folds).alias("probability"))


def predicted_class(blended: DataFrame, entity: str = "bldg_id") -> DataFrame:
    """Most probable class, the first on a tie (of 12 digits, so the order of summation does not count).

    A target with class 1 alone is a binary score: 1 when above one half.
    """
    best = F.max(F.struct(F.round("probability", 12).alias("probability"), (-F.col("class")).alias("c")))
    per_target = blended.groupBy(entity, "target").agg(
        best.alias("best"), F.count(F.lit(1)).alias("n"), F.max("class").alias("only")
    )
    binary = (F.col("n") == 1) & (F.col("only") == 1)
    return per_target.select(
        entity,
        "target",
        F.when(binary, (F.col("best.probability") > 0.5).cast("int")).otherwise(-F.col("best.c")).cast("int").alias("code"),
    )


def predict_table(classes: DataFrame, targets: Sequence[str], value: str = "code", entity: str = "bldg_id") -> DataFrame:
    """One row per entity, one column per target."""
    return classes.groupBy(entity).pivot("target", list(targets)).agg(F.first(value))


def null_out(
    table: DataFrame, targets: Sequence[str], kind: str = BINARY_TARGET,
    commercial: object = "commercial", residential: object = "residential",
) -> DataFrame:
    """Commercial rows keep no residential prediction and the other way round."""
    changes = {}
    for target in targets:
        if target == kind:
            continue
        other = residential if target.lower().endswith("com") else commercial
        changes[target] = F.when(~F.col(kind).eqNullSafe(F.lit(other)), F.col(target))
    return table.withColumns(changes)


def one_hot_class(df: DataFrame, columns: Sequence[str], result: str) -> DataFrame:
    """Index of the first largest column of a one-hot group."""
    values = F.array(*[F.col(name) for name in columns])
    return df.withColumn(result, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def one_hot(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """0/1 column per value."""
    return df.withColumns({f"{column}_{value}": F.col(column).eqNullSafe(F.lit(value)).cast("int") for value in values})


def prior_margin(labels: DataFrame) -> DataFrame:
    """Mean label per target: the constant a booster starts from."""
    return labels.groupBy("target").agg(F.avg("label").alias("margin"))


def with_prior_margin(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return join_bounded(rows, prior_margin(labels), ["target"])

