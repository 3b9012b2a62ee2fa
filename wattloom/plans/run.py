"""The whole way from raw files to the submission, as four steps over one folder layout."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.calendar import state_holidays as state_holidays_of
from wattloom.functions.fixed_values import ALL_TARGETS, BINARY_TARGET, FOLDS, safe_name
from wattloom.operators import encode as enc
from wattloom.operators import importance, models, scoring
from wattloom.operators.gold import dated_hours, load_features, narrow_hours, with_economics
from wattloom.operators.metadata import aligned_union, diagonal_union, of_ids, of_sampled, renumbered, with_suffix
from wattloom.operators.ranking import first_ids
from wattloom.operators.rollup import hourly
from wattloom.operators.statistics import feature_columns
from wattloom.plans.jobs import folds_of_targets, label_codes, read_gold, score, write_gold
from wattloom.sources import write
from wattloom.sources.census import read_economics
from wattloom.sources.tables import read_codes, scan, scan_bucketed, typed_readings


@dataclass(frozen=True)
class Layout:
    """Folders below one root, and the targets to work on."""

    root: str
    targets: tuple[str, ...] = tuple(map(safe_name, ALL_TARGETS))
    binary: str = BINARY_TARGET
    folds: int = FOLDS
    #: `boosted` (binary or one per class, cut at the best round), `forest`, `logistic` or `mlp`, and its parameters.
    kind: str = "boosted"
    model: dict = field(default_factory=lambda: {"maxIter": 50, "maxDepth": 5})
    #: Fits of one target in flight.
    parallel: int = 5
    #: Silver hours and labels bucketed by building: gold then shuffles no hours and caches none.
    buckets: int | None = None
    #: CSV of (feature, type, baseline) scores to compare with.
    baseline: str | None = None

    def at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])


def _write_by_building(layout: Layout, df: DataFrame, name: str, *order: str) -> None:
    if layout.buckets:
        write.bucketed_folder(df, layout.at("silver", name), layout.buckets, order=order)
    else:
        write.parquet(df, layout.at("silver", name))


def _by_building(spark: SparkSession, layout: Layout, name: str) -> DataFrame:
    path = layout.at("silver", name)
    return scan_bucketed(spark, path) if layout.buckets else spark.read.parquet(path)


def _codes(spark: SparkSession, layout: Layout, dataset: str) -> DataFrame:
    return read_codes(spark, layout.at("silver", "mapper")).filter(F.col("dataset") == dataset).drop("dataset")


def _sizes(codes: DataFrame) -> dict[str, int]:
    """Number of codes per column of the dictionary: one row per column."""
    return {row["column"]: row["n"] for row in codes.groupBy("column").agg((F.max("code") + 1).alias("n")).collect()}


def _coded_columns(df: DataFrame, codes: DataFrame) -> list[str]:
    known = _sizes(codes)
    return [name for name in df.columns if name in known]


def build_silver(
    spark: SparkSession, layout: Layout, train: str, labels: str, test: str | None = None, sheets: Sequence[str] = ()
) -> None:
    """Hourly readings, encoded labels, the mapper and the economics table."""
    readings = typed_readings(scan(spark, train))
    hours = hourly(readings)
    # The states of the raw rows: no rollup for them alone.
    state_codes = enc.fit_codes(readings.select("bldg_id", "state"), ["state"])
    raw_labels = scan(spark, labels)
    codes = state_codes.withColumn("dataset", F.lit("train_data")).unionByName(
        label_codes(raw_labels, spark).withColumn("dataset", F.lit("train_label"))
    )
    write.codes_json(codes, layout.at("silver", "mapper"))
    coded_states, coded_labels = F.broadcast(_codes(spark, layout, "train_data")), _codes(spark, layout, "train_label")
    _write_by_building(layout, enc.encode_by_join(hours, coded_states, ["state"]), "train_hours", "timestamp")
    if test:
        test_hours = hourly(typed_readings(scan(spark, test)))
        _write_by_building(layout, enc.encode_by_join(test_hours, coded_states, ["state"]), "test_hours", "timestamp")
    _write_by_building(layout, enc.encode_by_join(raw_labels, coded_labels, _coded_columns(raw_labels, coded_labels)), "labels")
    if sheets:
        # The training data's own codes; facts of states that it lacks belong to no building.
        facts = read_economics(spark, sheets, coded_states.select("value", "code")).filter("state is not null")
        write.parquet(facts, layout.at("silver", "economics"))


def add_buildings(
    spark: SparkSession, layout: Layout, hours: dict[str, DataFrame], metadata: dict[str, DataFrame], sample: int = 10_000
) -> None:
    """More buildings of both kinds: the first `sample` ids per state, renumbered, encoded like the training data.

    `hours` and `metadata` have the keys commercial and residential; hours are already hourly.
    """
    suffix = {"commercial": "com", "residential": "res"}
    tagged = diagonal_union(*[rows.withColumn("build_type", F.lit(kind)) for kind, rows in hours.items()])
    ids = first_ids(tagged, ["build_type", "state"], sample)
    united = diagonal_union(*[with_suffix(rows, suffix[kind], kind) for kind, rows in metadata.items()])
    sampled = of_sampled(united, ids)
    # New ids begin above all that the training data has.
    largest = spark.read.parquet(layout.at("silver", "labels")).agg(F.max("bldg_id")).first()[0]
    renamed, mapping = renumbered(sampled, max(30_000, (largest or 0) + 1))
    named = renamed.withColumnRenamed("build_type", layout.binary)
    known = _codes(spark, layout, "train_label")
    _write_by_building(layout, enc.encode_by_join(named, known, _coded_columns(named, known)), "additional_labels")
    numbered = tagged.join(mapping, ["build_type", "bldg_id"]).withColumn("bldg_id", F.col("new_id")).drop("new_id")
    # Folders by the state's letters, codes inside; buckets by building instead if the layout has them.
    coded = enc.encode_by_join(numbered.withColumn("folder", F.col("state")), F.broadcast(_codes(spark, layout, "train_data")), ["state"])
    if layout.buckets:
        _write_by_building(layout, coded, "additional_hours", "timestamp")
    else:
        write.partitioned(coded, layout.at("silver", "additional_hours"), "build_type", "folder")


def _economics(spark: SparkSession, layout: Layout) -> DataFrame:
    return spark.read.parquet(layout.at("silver", "economics"))


def _state_holidays(spark: SparkSession, layout: Layout, hours: DataFrame) -> DataFrame:
    """The holidays of the states, by their codes, in the years of the hours: at most rules x years rows."""
    first, last = hours.agg(F.min(F.year("timestamp")), F.max(F.year("timestamp"))).first()
    codes = _codes(spark, layout, "train_data").filter("column = 'state'").select(F.col("value").alias("state"), "code")
    days = state_holidays_of(spark, range(first or 0, (last or -1) + 1) or [0])
    return days.join(F.broadcast(codes), "state").select(F.col("code").alias("state"), "day")


def _features(
    spark: SparkSession, layout: Layout, parts: Sequence[DataFrame], state_holidays: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """The feature rows of hours whose parts share no building, and what is kept for them and has to be released.

    Bucketed parts are worked one by one, as their union would lose the buckets; nothing is kept of them.
    """
    hours = aligned_union(*parts)
    if state_holidays is None:
        state_holidays = _state_holidays(spark, layout, hours)
    kept = [] if layout.buckets else [narrow_hours(hours, state_holidays)]
    narrow = kept or [narrow_hours(part.select(*hours.columns), state_holidays, cluster=False) for part in parts]
    rows = aligned_union(*[load_features(dated_hours(part)) for part in narrow])
    return with_economics(rows, _economics(spark, layout)), kept[0] if kept else None


def labelled_hours(spark: SparkSession, layout: Layout, add: bool = False) -> tuple[list[DataFrame], DataFrame]:
    """The hours of the labelled buildings, additional ones as a part of their own, and all labels."""
    parts, labels = [_by_building(spark, layout, "train_hours")], _by_building(spark, layout, "labels")
    if add:
        parts.append(_by_building(spark, layout, "additional_hours"))
        labels = aligned_union(labels, _by_building(spark, layout, "additional_labels"))
    return [of_ids(part, labels) for part in parts], labels


def build_gold(spark: SparkSession, layout: Layout, add: bool = False, state_holidays: DataFrame | None = None) -> None:
    """Feature rows, folds and labels of the training buildings. State holidays come from the rules unless a table is given."""
    hours, labels = labelled_hours(spark, layout, add)
    kinds = _codes(spark, layout, "train_label").filter((F.col("column") == layout.binary) & (F.col("value") == "commercial"))
    folds = folds_of_targets(labels, layout.targets, layout.folds, commercial_code=kinds.first()["code"])
    features, kept = _features(spark, layout, hours, state_holidays)
    write_gold(features, folds, layout.at("gold"), layout.targets)
    if kept is not None:
        kept.unpersist()


def build_test_gold(spark: SparkSession, layout: Layout, state_holidays: DataFrame | None = None) -> None:
    """Feature rows of the test buildings."""
    features, kept = _features(spark, layout, [_by_building(spark, layout, "test_hours")], state_holidays)
    write.parquet(features, layout.at("gold", "test"))
    if kept is not None:
        kept.unpersist()


def train(spark: SparkSession, layout: Layout) -> None:
    """Fold models of every target on all features and the state, and the reports.

    Boosted models are scored after every round on their validation rows; the round with the best mean over folds is stored
    and later predictions stop there.
    """
    sizes = _sizes(_codes(spark, layout, "train_label"))
    states = _sizes(_codes(spark, layout, "train_data"))["state"]
    reports = []
    for target in layout.targets:
        gold = read_gold(spark, layout.at("gold"), target).persist()
        numeric = feature_columns(gold, ["bldg_id", "state", "fold_info", target])
        categorical = {"state": states}
        kind = layout.kind
        if kind == "boosted":
            kind = "gbt" if sizes[target] == 2 else "one_vs_rest"
        fitted = models.train_target(
            gold, target, numeric, sizes[target], layout.folds, layout.parallel, kind=kind, categorical=categorical, **layout.model
        )
        models.save_models(fitted, layout.at("models", target))
        rounds = None
        if layout.kind == "boosted":
            curve_path = layout.at("reports", "curves", f"target={target}")
            write.parquet(models.boosting_curve(fitted, gold, target).drop("target"), curve_path)
            curve = spark.read.parquet(curve_path).withColumn("target", F.lit(target))
            best_path = layout.at("reports", "best_rounds", f"target={target}")
            write.parquet(scoring.best_iteration(curve, "f1").drop("target"), best_path)
            rounds = spark.read.parquet(best_path).first()["best_epoch"]
        rows_path = layout.at("reports", "out_of_fold", f"target={target}")
        write.parquet(models.out_of_fold(fitted, gold, target, rounds).drop("target"), rows_path)
        scores = models.out_of_fold_f1(spark.read.parquet(rows_path).withColumn("target", F.lit(target)))
        write.parquet(scores.drop("target"), layout.at("reports", "scores", f"target={target}"))
        if kind not in ("logistic", "mlp"):
            reports.append(models.gains(fitted, target, models.feature_slots(numeric, categorical), spark))
        gold.unpersist()
    _write_reports(spark, layout, reports)


def _write_reports(spark: SparkSession, layout: Layout, gains: Sequence[DataFrame]) -> None:
    """Final score, comparison with the baseline, importances per feature and name template, matrices over targets."""
    per_fold = spark.read.parquet(layout.at("reports", "scores"))
    per_target = scoring.mean_over(per_fold, ["target"]).withColumnRenamed("f1", "best_score")
    write.report(scoring.weighted_score(per_target), layout.at("reports", "final_score"), "csv")
    if layout.baseline:
        known = spark.read.csv(layout.baseline, header=True, schema="feature string, type string, baseline double")
        detail = scoring.baseline_detail(known, per_target)
        write.report(detail, layout.at("reports", "baseline_detail"), "csv")
        write.report(scoring.baseline_summary(detail), layout.at("reports", "baseline_summary"), "csv")
    if not gains:
        return
    write.report(importance.average_importance(diagonal_union(*gains), layout.folds), layout.at("reports", "importance"))
    averages = spark.read.parquet(layout.at("reports", "importance"))
    templates = importance.template_importance(averages)
    write.report(templates, layout.at("reports", "importance_by_template"))
    write.report(importance.top_features(averages, 100), layout.at("reports", "importance_top"))
    write.report(importance.importance_matrix(templates, layout.targets), layout.at("reports", "importance_matrix"))
    write.report(importance.importance_matrix(templates, layout.targets, "rank"), layout.at("reports", "rank_matrix"))


def submit(spark: SparkSession, layout: Layout) -> None:
    """Predictions of the test buildings, decoded, nulled for the other kind, sorted by building."""
    codes = _codes(spark, layout, "train_label")
    rows = spark.read.parquet(layout.at("gold", "test"))
    fitted = {target: models.load_models(layout.at("models", target), layout.folds) for target in layout.targets}
    rounds = None
    if layout.kind == "boosted":
        # One row per target.
        best = spark.read.parquet(layout.at("reports", "best_rounds")).collect()
        rounds = {row["target"]: row["best_epoch"] for row in best}
    write.submission(score(fitted, rows, codes, layout.binary, rounds), layout.at("submission"))


def layout_from(path: str) -> Layout:
    """A layout from a JSON file with the keys of `Layout`."""
    with open(path, encoding="utf-8") as file:
        values = json.load(file)
    values["targets"] = tuple(values.get("targets", map(safe_name, ALL_TARGETS)))
    return Layout(**values)
