"""Scores of predictions and of training curves; every table in is reduced to counts before it moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import BINARY_SHARE, DETAIL_SHARE
from wattloom.functions.text import target_class
from wattloom.operators.joins import join_bounded
from wattloom.operators.ranking import running_total


def threshold_class(score: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """Metrics count a score at the threshold as class 1, prediction does not."""
    return ((score >= threshold) if inclusive else (score > threshold)).cast("int")


def ordinal_class(score: Column) -> Column:
    """Regression output to class: rounded half to even, not below 0."""
    return F.greatest(F.bround(score), F.lit(0)).cast("int")


def argmax_class(scores: Column) -> Column:
    """Index of the largest entry of an array of class scores, the first on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Rows per truth and prediction; `rows` names a column that holds counts already."""
    count = F.count(F.lit(1)) if rows is None else F.sum(rows)
    return df.groupBy(*by, truth, predicted).agg(count.alias("n"))


def class_f1(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """F1 of every class that occurs as truth or prediction."""
    hit = F.col(truth) == F.col(predicted)
    n = F.col("n")
    as_truth = F.struct(
        F.col(truth).alias("class"), F.when(hit, n).otherwise(0).alias("tp"), F.when(hit, 0).otherwise(n).alias("wrong")
    )
    as_prediction = F.struct(
        F.col(predicted).alias("class"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(n).alias("wrong")
    )
    return (
        confusion(df, truth, predicted, by, rows)
        .select(*by, F.explode(F.array(as_truth, as_prediction)).alias("part"))
        .groupBy(*by, F.col("part.class").alias("class"))
        .agg((2 * F.sum("part.tp") / (2 * F.sum("part.tp") + F.sum("part.wrong"))).alias("f1"))
    )


def macro_f1(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Unweighted mean of the class F1 values, per `by` group."""
    return class_f1(df, truth, predicted, by, rows).groupBy(*by).agg(F.avg("f1").alias("f1"))


def mean_over(scores: DataFrame, level: Sequence[str], value: str = "f1") -> DataFrame:
    return scores.groupBy(*level).agg(F.avg(value).alias(value))


def out_of_fold_score(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean over folds of the mean over targets; needs `fold` and `target`."""
    per_target = macro_f1(df, truth, predicted, ["fold", "target"])
    return mean_over(mean_over(per_target, ["fold"]), [])


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sum; ties count half."""
    per_score = df.filter(F.col(score).isNotNull()).groupBy(score).agg(
        F.sum((F.col(truth) == 1).cast("long")).alias("pos"),
        F.sum((F.col(truth) == 0).cast("long")).alias("neg"),
    )
    ranked = running_total(per_score, [score], {"neg": "neg_up_to"})
    below = F.col("neg_up_to") - F.col("neg") / 2
    return ranked.agg(
        (F.sum(F.col("pos") * below) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc")
    )


def softmax(df: DataFrame, logit: str, group: Sequence[str], result: str = "probability") -> DataFrame:
    """Softmax over the rows of each (entity, target)."""
    rows = Window.partitionBy(*group)
    weight = F.exp(F.col(logit) - F.max(logit).over(rows))
    return df.withColumn("_weight", weight).withColumn(result, F.col("_weight") / F.sum("_weight").over(rows)).drop("_weight")


def cross_entropy(df: DataFrame, logit: str, entity: str = "bldg_id") -> DataFrame:
    """Sum over targets of the mean negative log probability of the true class.

    Needs (entity, target, class, label) rows; `label` is the true class.
    """
    scored = softmax(df, logit, [entity, "target"]).filter(F.col("class") == F.col("label"))
    per_target = scored.groupBy("target").agg((-F.avg(F.log("probability"))).alias("loss"))
    return per_target.agg(F.sum("loss").alias("loss"))


def curve_statistics(curves: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds per (target, metric, iteration)."""
    return curves.groupBy("target", "metric", "iteration").agg(
        F.avg("value").alias("average"), F.stddev_samp("value").alias("std")
    )


def best_iteration(curves: DataFrame, metric: str, maximize: bool = True) -> DataFrame:
    """The iteration with the best mean over folds, the first on a tie (of 12 digits)."""
    sign = 1 if maximize else -1
    best = F.max(F.struct(F.round(sign * F.col("average"), 12).alias("s"), (-F.col("iteration")).alias("i"), "average", "std"))
    return (
        curve_statistics(curves.filter(F.col("metric") == metric))
        .groupBy("target")
        .agg(best.alias("best"))
        .select(
            "target",
            (-F.col("best.i") + 1).alias("best_epoch"),
            F.col("best.average").alias("best_score"),
            F.col("best.std").alias("best_std"),
        )
    )


def weighted_score(scores: DataFrame, target: str = "target", score: str = "best_score") -> DataFrame:
    """0.4 x binary + 0.6 x mean of the commercial and residential means."""
    of_class = target_class(F.col(target))

    def mean_of(name: str) -> Column:
        return F.avg(F.when(of_class == name, F.col(score)))

    total = BINARY_SHARE * mean_of("binary") + DETAIL_SHARE * (
        0.5 * mean_of("commercial") + 0.5 * mean_of("residential")
    )
    return scores.agg(total.alias("score"))


def baseline_detail(baseline: DataFrame, scores: DataFrame, score: str = "best_score") -> DataFrame:
    """Baseline (feature, type, baseline) with the new score and the difference."""
    new = scores.select(F.col("target").alias("feature"), F.col(score).alias("new"))
    return baseline.join(new, "feature", "left").withColumn("delta", F.col("new") - F.col("baseline"))


def baseline_summary(detail: DataFrame) -> DataFrame:
    """Class means and weighted totals of baseline and new scores; types are COM, RES and -."""
    long = detail.select(
        "type",
        F.explode(
            F.array(
                F.struct(F.lit("baseline").alias("model"), F.col("baseline").alias("value")),
                F.struct(F.lit("new").alias("model"), F.col("new").alias("value")),
            )
        ).alias("entry"),
    ).select("type", "entry.*")
    means = long.groupBy("model").agg(
        *[
            F.avg(F.when(F.col("type") == kind, F.col("value"))).alias(name)
            for kind, name in (("COM", "com"), ("RES", "res"), ("-", "binary"))
        ]
    )
    return (
        means.withColumn("avg_res_com", (F.col("com") + F.col("res")) / 2)
        .withColumn("binary_total", F.col("binary") * BINARY_SHARE)
        .withColumn("res_com_total", F.col("avg_res_com") * DETAIL_SHARE)
        .withColumn("total", F.col("binary_total") + F.col("res_com_total"))
    )


def fold_score_table(scores: DataFrame, best: DataFrame, folds: int) -> DataFrame:
    """Scores at the best iteration as columns fold_0.. and their mean; `scores` is (target, fold, iteration, score)."""
    epochs = best.select("target", (F.col("best_epoch") - 1).alias("iteration"))
    chosen = join_bounded(scores, epochs, ["target", "iteration"], "inner")
    names = [f"fold_{fold}" for fold in range(folds)]
    wide = (
        chosen.withColumn("fold", F.concat(F.lit("fold_"), F.col("fold").cast("string")))
        .groupBy("target")
        .pivot("fold", names)
        .agg(F.first("score"))
    )
    return wide.join(chosen.groupBy("target").agg(F.avg("score").alias("average")), "target")
