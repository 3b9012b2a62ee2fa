"""Joint training of all classes, what it exports, and where it stops.

Models differ between engines; the SQL checks which rows come out and that every promise about them holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.catalog.shape import r, registry, table
from wattloom.catalog.training import TEXT_FEATURES, TRAINING_FOLDS, document_gold, quality_models
from wattloom.operators import boosting, models, tree_index
from wattloom.operators.folds import current_fold, stratified_folds
from wattloom.operators.folds import iterative_folds as iterative_folds_of
from wattloom.operators.rates import rate_names, rated_split, with_category_rates
from wattloom.session import cut_lineage, scratch_path

QUERIES, SQL, query = registry()

CLASSES = 4


def judged_documents(spark, folder):
    """Labelled documents with one class for quality and toxicity together, the language as a category, and the feature vector."""
    toxic = table(spark, folder, "labels").select(F.col("doc_id").alias("bldg_id"), "toxic")
    lang = F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang")) - 1
    gold = document_gold(spark, folder).join(toxic, "bldg_id").withColumn("lang_code", lang.cast("int"))
    gold = gold.withColumn("class", (2 * F.col("quality") + F.col("toxic")).cast("int")).filter("class is not null")
    stages = models.feature_stages(TEXT_FEATURES, {"lang_code": 4})
    ready = Pipeline(stages=stages).fit(gold).transform(gold)
    return cut_lineage(ready.select("bldg_id", "class", "features", (current_fold(0) == "v").alias("valid")))


@query(
    "softmax_boosting",
    """
SELECT doc_id AS bldg_id, CAST(2 * quality + toxic AS BIGINT) AS class, CAST(4 AS BIGINT) AS classes, CAST(1 AS BIGINT) AS total,
       true AS leaves_agree, true AS loss_falls
FROM labels JOIN (SELECT doc_id FROM documents) USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL""",
)
def softmax_boosting(spark, folder):
    """Four classes boosted jointly. Margins are recomputed in SQL from the exported leaves; the loss falls every round."""
    rows = judged_documents(spark, folder)
    model = boosting.boost(rows, "class", CLASSES, scratch_path(spark, "softmax"), rounds=3, depth=2, block=2)
    falls = all(b[1] < a[1] for a, b in zip(model.losses, model.losses[1:]))
    table_of_leaves = boosting.leaves(model, spark)
    again = [F.expr(boosting.margin_sql(table_of_leaves, k, model.prior[k])) for k in range(CLASSES)]
    scored = boosting.margins(model, rows).withColumn("x", vector_to_array("features")).withColumn("again", F.array(*again))
    apart = F.exists(F.zip_with("margins", "again", lambda a, b: F.abs(a - b)), lambda x: x > 1e-9)
    chances = boosting.softmax_of("margins")
    return scored.select(
        "bldg_id", "class", F.size(chances).alias("classes"),
        F.round(F.aggregate(chances, F.lit(0.0), lambda a, x: a + x), 9).cast("long").alias("total"),
        (~apart).alias("leaves_agree"), F.lit(falls).alias("loss_falls"),
    )


@query(
    "early_stopping",
    "SELECT CAST(12 AS BIGINT) AS allowed, true AS stopped_in_time, true AS best_is_least, true AS whole",
)
def early_stopping(spark, folder):
    """Training in blocks of two rounds ends when the validation loss has not fallen for two rounds."""
    rows = judged_documents(spark, folder)
    model = boosting.boost(
        rows, "class", CLASSES, scratch_path(spark, "stopping"), rounds=12, valid=F.col("valid"), depth=4, rate=1.0, block=2, patience=2
    )
    losses = boosting.curve(model, spark)
    least = losses.agg(F.min(F.struct("valid_loss", "round"))["round"].alias("least"), F.count(F.lit(1)).alias("trained"))
    best = model.best_round()
    return least.select(
        F.lit(12).alias("allowed"),
        (F.col("trained") == F.least(F.lit(12), F.lit(best + 2))).alias("stopped_in_time"),
        (F.col("least") + 1 == best).alias("best_is_least"),
        (F.lit(len(model.stages())) == F.col("trained") * CLASSES).alias("whole"),
    )


@query(
    "permutation_by_index",
    f"""
SELECT feature, count(quality) AS documents, true AS same, true AS less_work
FROM labels JOIN (SELECT doc_id FROM documents) USING (doc_id), (VALUES {", ".join(f"('{name}')" for name in TEXT_FEATURES)}) v(feature)
GROUP BY feature""",
)
def permutation_by_index(spark, folder):
    """Importance by the index of trees equals scoring every variant with the whole model, by fewer looks at trees."""
    gold = document_gold(spark, folder)
    trained = quality_models(gold, maxIter=4, maxDepth=3)
    slots = models.feature_slots(TEXT_FEATURES)
    quick = tree_index.permutation_importance(trained, gold, "quality", slots, repetitions=1)
    plain = models.permutation_importance(trained, gold, "quality", slots, repetitions=1).withColumnRenamed("importance", "plain")
    documents = gold.filter("quality is not null").count()
    indexes = [tree_index.indexed(model.stages[-1], slots) for model in trained]
    # A tree of depth 3 looks at up to 8 leaves for each feature when it scores that variant.
    looks = sum(len(index.leaves[0]) for index in indexes) * len(slots)
    return quick.join(plain, ["target", "feature"]).select(
        "feature", F.lit(documents).alias("documents"), (F.abs(F.col("importance") - F.col("plain")) < 1e-9).alias("same"),
        F.lit(sum(index.entries() for index in indexes) < looks).alias("less_work"),
    )


@query(
    "iterative_folds",
    """
WITH named AS (
  SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'yes' END AS debt, CAST(c_nationkey % 5 AS VARCHAR) AS area FROM customer
),
labels AS (
  SELECT c_custkey, 'segment=' || segment AS label FROM named
  UNION ALL SELECT c_custkey, 'debt=' || debt FROM named WHERE debt IS NOT NULL
  UNION ALL SELECT c_custkey, 'area=' || area FROM named
)
SELECT label, count(*) AS rows, count(DISTINCT c_custkey) AS with_a_fold, true AS within_rounds
FROM labels GROUP BY label""",
)
def iterative_folds(spark, folder):
    """Folds balanced over every single label: how far they differ, and that no customer is left out."""
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("bldg_id"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") < 0, "yes").alias("debt"), (F.col("c_nationkey") % 5).cast("string").alias("area"),
    )
    names = ["segment", "debt", "area"]
    dealt = iterative_folds_of(rows, names)
    pairs = F.explode(F.array(*[F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}="), F.col(name))) for name in names])).alias("label")
    by_fold = dealt.select("bldg_id", "fold", pairs).filter("label is not null").groupBy("label", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("fold").between(0, 4), F.col("bldg_id"))).alias("known")
    )
    spread = by_fold.groupBy("label").agg(
        F.sum("n").alias("rows"), F.sum("known").alias("with_a_fold"),
        # A fold without the label has no row.
        (F.max("n") - F.when(F.count(F.lit(1)) == 5, F.min("n")).otherwise(0)).alias("apart"),
    )
    # Eleven labels, as many rounds at most.
    return spread.select("label", "rows", "with_a_fold", (F.col("apart") <= 11).alias("within_rounds"))


@query(
    "category_rates",
    f"""
WITH dealt AS (
  SELECT doc_id, quality, (row_number() OVER (ORDER BY quality, md5('0:' || doc_id)) - 1) % 3 AS fold FROM labels WHERE quality IS NOT NULL
),
rows AS (SELECT doc_id, source, fold, quality FROM dealt JOIN documents USING (doc_id)),
cells AS (SELECT source, fold, count(*) AS n, sum(quality) AS good FROM rows GROUP BY source, fold),
every AS (SELECT source, sum(n) AS n, sum(good) AS good FROM cells GROUP BY source),
folds AS (SELECT fold, sum(n) AS n, sum(good) AS good FROM cells GROUP BY fold),
whole AS (SELECT f.fold, 1.0 * (t.good - f.good) / (t.n - f.n) AS share FROM folds f, (SELECT sum(n) AS n, sum(good) AS good FROM folds) t),
parts AS (
  SELECT r.doc_id, r.source, r.fold, e.n - c.n AS n, e.good - c.good AS good, w.share
  FROM rows r JOIN every e ON e.source IS NOT DISTINCT FROM r.source
  JOIN cells c ON c.source IS NOT DISTINCT FROM r.source AND c.fold = r.fold JOIN whole w ON w.fold = r.fold
)
SELECT doc_id AS bldg_id, source, fold, {r("(n - good + 20.0 * (1 - share)) / (n + 20.0)")} AS source_rate_0,
       {r("(good + 20.0 * share) / (n + 20.0)")} AS source_rate_1
FROM parts""",
)
def category_rates(spark, folder):
    """Quality rates of every document's source, counted over the other folds only."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("bldg_id"), "quality").filter("quality is not null")
    sources = table(spark, folder, "documents").select(F.col("doc_id").alias("bldg_id"), "source")
    rows = cut_lineage(stratified_folds(labels, "quality", TRAINING_FOLDS).join(sources, "bldg_id"))
    return with_category_rates(rows, "source", "quality", 2).select("bldg_id", "source", "fold", *rate_names("source", 2))


@query(
    "net_with_rates",
    """
SELECT doc_id AS bldg_id, CAST(fold AS BIGINT) AS fold, CAST(quality AS BIGINT) AS label, CAST(2 AS BIGINT) AS classes, CAST(1 AS BIGINT) AS total
FROM (SELECT doc_id, quality, (row_number() OVER (ORDER BY quality, md5('0:' || doc_id)) - 1) % 3 AS fold FROM labels)
JOIN (SELECT doc_id FROM documents) USING (doc_id) WHERE quality IS NOT NULL""",
)
def net_with_rates(spark, folder):
    """A feed-forward net per fold on text statistics and the rates of the language; every document is scored by the net
    that saw neither it nor a rate with its label."""
    gold = document_gold(spark, folder).withColumn("fold", F.array_position(F.split("fold_info", ", *"), "v").cast("int") - 1)
    names = [*TEXT_FEATURES, *rate_names("lang", 2)]
    rated = [cut_lineage(rated_split(gold, "lang", "quality", 2, split)) for split in range(TRAINING_FOLDS)]
    nets = [models.train_fold(rows, "quality", split, names, 2, kind="mlp", hidden=[8], maxIter=10) for split, rows in enumerate(rated)]
    parts = [models.out_of_fold_of(net, rows, "quality", split) for split, (net, rows) in enumerate(zip(nets, rated, strict=True))]
    return reduce(DataFrame.unionByName, parts).groupBy("bldg_id", "fold", "label").agg(
        F.count_distinct("class").alias("classes"), F.round(F.sum("probability"), 6).cast("long").alias("total")
    )
