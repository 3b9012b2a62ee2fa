"""Feature importance tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import FOLDS
from wattloom.functions.text import first_matching_template, name_template


def average_importance(gains: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Mean gain over folds per (target, feature); a fold without the feature counts as 0."""
    return gains.groupBy("target", "feature").agg((F.sum("gain") / folds).alias("average"))


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """The k most important features overall rows, by importance and then name."""
    return importance.orderBy(F.desc("average"), "target", "feature").limit(k)


def template_importance(importance: DataFrame) -> DataFrame:
    """Mean, min, max, count per name template and its rank (from 0) within the target."""
    grouped = importance.groupBy("target", name_template(F.col("feature")).alias("feature_cluster")).agg(
        F.avg("average").alias("mean"),
        F.min("average").alias("min"),
        F.max("average").alias("max"),
        F.count("average").alias("count"),
    )
    # One row per name template of a target.
    order = Window.partitionBy("target").orderBy(F.desc("mean"), "feature_cluster")
    return grouped.withColumn("rank", F.row_number().over(order) - 1)


def importance_matrix(templates: DataFrame, targets: Sequence[str], value: str = "mean") -> DataFrame:
    """Templates x targets with the row mean as `average_imp` (or `average_rank`)."""
    mean_name = "average_rank" if value == "rank" else "average_imp"
    keys = ["feature_cluster", "count"]
    wide = templates.groupBy(*keys).pivot("target", list(targets)).agg(F.first(value))
    present = F.filter(F.array(*[F.col(target).cast("double") for target in targets]), lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size(present), F.lit(0))
    return wide.withColumn(mean_name, mean)


def pattern_importance(importance: DataFrame, value: str = "average") -> DataFrame:
    """Mean, min, max, count per fixed name pattern (first match); names without a pattern are left out."""
    return (
        importance.withColumn("feature_cluster", first_matching_template(F.col("feature")))
        .filter(F.col("feature_cluster").isNotNull())
        .groupBy("feature_cluster")
        .agg(
            F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count")
        )
    )
