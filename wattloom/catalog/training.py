"""Training and scoring jobs; models differ between engines, so these have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.catalog.labels import customer_labels
from wattloom.catalog.shape import registry, table
from wattloom.operators import models
from wattloom.operators.ensemble import blend, predicted_class
from wattloom.operators.folds import fold_info, stratified_folds
from wattloom.operators.importance import average_importance
from wattloom.operators.scoring import best_iteration
from wattloom.plans.jobs import folds_of_targets, read_gold, score, write_gold
from wattloom.session import cut_lineage, scratch_path

QUERIES, SQL, query = registry()

TEXT_FEATURES = ["n_chars", "n_words", "digit_share", "upper_share", "mean_word", "line_count"]
TRAINING_FOLDS = 3


def document_gold(spark, folder):
    """Labelled documents with whole-text statistics as features and folds by quality."""
    text = F.col("text")
    length = F.greatest(F.length(text), F.lit(1))
    features = table(spark, folder, "documents").select(
        F.col("doc_id").alias("bldg_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(text, r"\s+")).cast("double").alias("n_words"),
        ((F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))) / length).alias("digit_share"),
        ((F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) / length).alias("upper_share"),
        (F.length(text) / F.size(F.split(text, r"\s+"))).alias("mean_word"),
        F.size(F.split(text, "\n")).cast("double").alias("line_count"),
        "lang",
    )
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("bldg_id"), "quality")
    dealt = stratified_folds(labels, "quality", TRAINING_FOLDS).withColumn("fold_info", fold_info(F.col("fold"), TRAINING_FOLDS))
    return cut_lineage(dealt.drop("fold").join(features, "bldg_id"))


def quality_models(gold, kind="gbt", **params):
    return models.train_target(gold, "quality", TEXT_FEATURES, 2, TRAINING_FOLDS, kind=kind, **params)


@query("train_score_binary")
def train_score_binary(spark, folder):
    """Boosted trees per fold, blended scores of every document."""
    gold = document_gold(spark, folder)
    trained = quality_models(gold, maxIter=4, maxDepth=3)
    path = scratch_path(spark, "models")
    models.save_models(trained, path)
    blended = blend(models.predict_folds(models.load_models(path, TRAINING_FOLDS), gold, "quality"), TRAINING_FOLDS)
    return predicted_class(blended)


@query("boosting_curve")
def boosting_curve(spark, folder):
    """Macro-F1 after every boosting round and the best number of rounds."""
    gold = document_gold(spark, folder)
    curve = models.boosting_curve(quality_models(gold, maxIter=4, maxDepth=3), gold, "quality")
    return curve.join(best_iteration(curve, "f1"), "target")


@query("gain_importance")
def gain_importance(spark, folder):
    """Mean gain of each feature over the fold models."""
    trained = quality_models(document_gold(spark, folder), kind="forest", numTrees=5, maxDepth=4)
    return average_importance(models.gains(trained, "quality", models.feature_slots(TEXT_FEATURES), spark), TRAINING_FOLDS)


@query("permutation_importance")
def permutation_importance(spark, folder):
    """Score lost when a feature is permuted within each validation fold."""
    gold = document_gold(spark, folder)
    trained = quality_models(gold, kind="forest", numTrees=5, maxDepth=4)
    return models.permutation_importance(trained, gold, "quality", models.feature_slots(TEXT_FEATURES), repetitions=2)


@query("train_score_multi")
def train_score_multi(spark, folder):
    """A forest per fold on a multiclass target with the language as a one-hot feature; out-of-fold macro-F1."""
    gold = document_gold(spark, folder)
    coded = gold.withColumn("lang_code", F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang")) - 1)
    coded = coded.withColumns(
        {"lang_code": F.col("lang_code").cast("int"), "length_class": F.least(F.floor(F.log10(F.col("n_chars") + 1)), F.lit(4)).cast("int")}
    )
    trained = models.train_target(
        coded, "length_class", ["n_words", "digit_share", "upper_share", "mean_word"], 5, TRAINING_FOLDS,
        kind="forest", categorical={"lang_code": 4}, numTrees=5, maxDepth=5,
    )
    return models.out_of_fold_f1(models.out_of_fold(trained, coded, "length_class")).drop("target")


@query(
    "out_of_fold_rows",
    """
SELECT doc_id AS bldg_id, CAST(fold AS BIGINT) AS fold, CAST(quality AS BIGINT) AS label, CAST(2 AS BIGINT) AS classes, CAST(1 AS BIGINT) AS total
FROM (SELECT doc_id, quality, (row_number() OVER (ORDER BY quality, md5('0:' || doc_id)) - 1) % 3 AS fold FROM labels)
JOIN (SELECT doc_id FROM documents) USING (doc_id) WHERE quality IS NOT NULL""",
)
def out_of_fold_rows(spark, folder):
    """Every labelled document is scored once, by the boosted model of the fold that it is not trained in, cut at two rounds."""
    gold = document_gold(spark, folder)
    rows = models.out_of_fold(quality_models(gold, maxIter=3, maxDepth=2), gold, "quality", rounds=2)
    return rows.groupBy("bldg_id", "fold", "label").agg(
        F.count_distinct("class").alias("classes"), F.round(F.sum("probability"), 6).cast("long").alias("total")
    )


@query(
    "donor_pairs",
    """
WITH ranked AS (SELECT c_custkey AS bldg_id, row_number() OVER (ORDER BY md5('0-1:' || c_custkey)) - 1 AS place, count(*) OVER () AS n FROM customer)
SELECT r.bldg_id, d.bldg_id AS donor FROM ranked r JOIN ranked d ON d.place = (r.place + 1 + (7919 * 2) % greatest(r.n - 1, 1)) % r.n""",
)
def donor_pairs(spark, folder):
    """Every customer with the customer that lends it a feature in a permutation."""
    return models.donor_pairs(table(spark, folder, "customer").select(F.col("c_custkey").alias("bldg_id")), repetition=1)


@query("mlp_score")
def mlp_score(spark, folder):
    """Feed-forward net on the embedding vectors."""
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("bldg_id"), F.col("label").cast("int").alias("label"), "embedding"
    )
    size, classes = vectors.agg(F.max(F.size("embedding")), F.max("label") + 1).first()
    names = [f"v{number}" for number in range(size)]
    wide = vectors.select("bldg_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(name) for i, name in enumerate(names)])
    gold = cut_lineage(stratified_folds(wide, "label", 2).withColumn("fold_info", fold_info(F.col("fold"), 2)))
    model = models.train_fold(gold, "label", 0, names, classes, kind="mlp", hidden=[16], maxIter=10)
    return model.transform(gold).select("bldg_id", "label", F.col("prediction").cast("int").alias("predicted"))


@query("score_submission")
def score_submission(spark, folder):
    """Gold layer, fold models per target, blend, decode and null-out: one row per customer."""
    targets = ["building_stock_type", "in_heating_fuel_com", "in_bedrooms_res"]
    features = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("bldg_id"))
        .agg(F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).cast("double").alias("orders"))
    )
    path = scratch_path(spark, "gold")
    write_gold(features, folds_of_targets(customer_labels(spark, folder), targets, k=2), path, targets)
    trained = {
        target: models.train_target(
            read_gold(spark, path, target), target, ["total", "mean", "orders"], classes, 2, kind="forest", numTrees=3, maxDepth=3
        )
        for target, classes in zip(targets, (2, 5, 5))
    }
    maps = {
        "building_stock_type": {"commercial": 0, "residential": 1},
        "in_heating_fuel_com": {"DistrictHeating": 0, "Electricity": 1, "FuelOil": 2, "NaturalGas": 3, "Propane": 4},
        "in_bedrooms_res": {str(number + 1): number for number in range(5)},
    }
    rows = [(target, value, code) for target, entries in maps.items() for value, code in entries.items()]
    codes = spark.createDataFrame(rows, "column string, value string, code int")
    return score(trained, spark.read.parquet(f"{path}/features"), codes)
