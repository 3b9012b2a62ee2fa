"""The jobs from raw readings to the submission, each reading and writing a layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import ALL_TARGETS, BINARY_TARGET, FOLDS, safe_name
from wattloom.operators.encode import decode_by_join, fit_codes, ordinal_codes, with_ordinal_order
from wattloom.operators.ensemble import null_out
from wattloom.operators.folds import fold_info, long_labels, stratified_folds
from wattloom.operators.models import predicted_classes
from wattloom.sources import write


def label_codes(raw: DataFrame, spark: SparkSession) -> DataFrame:
    """The dictionary of the labels; ordinal targets get their fixed order before anything is encoded."""
    return with_ordinal_order(fit_codes(raw), ordinal_codes(spark))


def folds_of_targets(
    labels: DataFrame, targets: Sequence[str] = tuple(map(safe_name, ALL_TARGETS)), k: int = FOLDS, seed: int = 0,
    commercial_code: int = 0,
) -> DataFrame:
    """(bldg_id, target, code, fold, fold_info) for all targets in one plan."""
    long = long_labels(labels, targets, commercial_code=commercial_code)
    dealt = stratified_folds(long.filter(F.col("code").isNotNull()), "code", k, seed, by=["target"])
    return dealt.withColumn("fold_info", fold_info(F.col("fold"), k))


def write_gold(features: DataFrame, folds: DataFrame, folder: str, targets: Sequence[str]) -> None:
    """The folds as a narrow table per target, and one row per building with its features, codes and folds of all targets.

    The wide features meet the labels in one join here, so reading a target is a scan without a shuffle.
    """
    write.partitioned(folds, f"{folder}/folds", "target")
    wide = folds.groupBy("bldg_id").pivot("target", list(targets)).agg(
        F.first("code").alias("code"), F.first("fold_info").alias("fold_info")
    )
    write.parquet(features.join(wide, "bldg_id", "left"), f"{folder}/features")


def read_gold(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """The training rows of one target: bldg_id, its code, fold_info and the features."""
    rows = spark.read.parquet(f"{folder}/features")
    features = [name for name in rows.columns if name != "bldg_id" and not name.endswith(("_code", "_fold_info"))]
    code = F.col(f"{target}_code")
    return rows.filter(code.isNotNull()).select("bldg_id", code.alias(target), F.col(f"{target}_fold_info").alias("fold_info"), *features)


def score(
    models: dict[str, Sequence[PipelineModel]], rows: DataFrame, codes: DataFrame, binary: str = BINARY_TARGET,
    rounds: dict[str, int] | None = None,
) -> DataFrame:
    """Blend the fold models of every target, decode, and null the targets of the other building kind."""
    table = predicted_classes(models, rows, rounds)
    return null_out(decode_by_join(table, codes, list(models)), list(models), binary)
