"""Scores, curves, importances and ensembles, on predictions derived from orders, line items and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.catalog.shape import r, registry, table
from wattloom.operators import ensemble, importance, scoring, statistics
from wattloom.operators.encode import decode

QUERIES, SQL, query = registry()


# --- predictions


def order_predictions(spark, folder):
    """Orders as predictions: the priority is the class, the prediction is right for a third of the rows."""
    label = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    guess = ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 5).cast("int")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("bldg_id"),
        F.col("o_orderstatus").alias("target"),
        label.alias("label"),
        F.when(F.col("o_orderkey") % 3 == 0, label).otherwise(guess).alias("predicted"),
        (F.col("o_custkey") % 5).cast("int").alias("fold"),
        (F.col("o_orderkey") % 4).cast("int").alias("iteration"),
        (label + (F.col("o_orderkey") % 21 - 10) / F.lit(8.0)).alias("score"),
    )


PREDICTIONS = """
predictions AS (
  SELECT o_orderkey AS bldg_id, o_orderstatus AS target, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS label,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1
              ELSE (o_orderkey * 7 + o_custkey) % 5 END AS predicted,
         o_custkey % 5 AS fold, o_orderkey % 4 AS iteration,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 + (o_orderkey % 21 - 10) / 8.0 AS score
  FROM orders
)"""


def f1_sql(source: str, by: str = "", predicted: str = "predicted") -> str:
    """CTEs up to `macro(by…, f1)`; per class from three separate counts."""
    keys = f"{by}, " if by else ""
    match = " AND ".join([f"p.{key.strip()} = c.{key.strip()}" for key in by.split(",") if key.strip()] or ["true"])
    group = f"GROUP BY {by}" if by else ""
    select = ", ".join([f"c.{key.strip()}" for key in by.split(",") if key.strip()])
    select = f"{select}, " if select else ""
    return f"""
classes AS (SELECT DISTINCT {keys}label AS cls FROM {source} UNION SELECT DISTINCT {keys}{predicted} FROM {source}),
counted AS (
  SELECT {select}c.cls, count(*) FILTER (WHERE p.label = c.cls AND p.{predicted} = c.cls) AS tp,
         count(*) FILTER (WHERE p.label = c.cls) AS truths, count(*) FILTER (WHERE p.{predicted} = c.cls) AS guesses
  FROM classes c JOIN {source} p ON {match} GROUP BY ALL
),
macro AS (SELECT {keys}avg(2.0 * tp / (truths + guesses)) AS f1 FROM counted {group})"""


@query("macro_f1_multi", f"WITH {PREDICTIONS}, {f1_sql('predictions')} SELECT {r('f1')} AS f1 FROM macro")
def macro_f1_multi(spark, folder):
    """Unweighted mean of class F1."""
    return scoring.macro_f1(order_predictions(spark, folder), "label", "predicted")


@query(
    "f1_by_target",
    f"WITH {PREDICTIONS}, {f1_sql('predictions', 'target')} SELECT target, {r('f1')} AS f1, {r('avg(f1) OVER ()')} AS mean_f1 FROM macro",
)
def f1_by_target(spark, folder):
    """F1 of every target and their mean."""
    scores = scoring.macro_f1(order_predictions(spark, folder), "label", "predicted", ["target"])
    # One row per target.
    return scores.withColumn("mean_f1", F.avg("f1").over(Window.partitionBy()))


@query(
    "class_f1",
    f"WITH {PREDICTIONS}, {f1_sql('predictions', 'target')} SELECT target, CAST(cls AS BIGINT) AS class, {r('2.0 * tp / (truths + guesses)')} AS f1 FROM counted",
)
def class_f1(spark, folder):
    return scoring.class_f1(order_predictions(spark, folder), "label", "predicted", ["target"])


@query(
    "confusion_counts",
    f"WITH {PREDICTIONS} SELECT CAST(label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted, CAST(count(*) AS BIGINT) AS n FROM predictions GROUP BY ALL",
)
def confusion_counts(spark, folder):
    return scoring.confusion(order_predictions(spark, folder), "label", "predicted")


@query(
    "ordinal_f1",
    f"""WITH {PREDICTIONS}, rounded AS (SELECT label, CAST(greatest(round_even(score, 0), 0) AS INTEGER) AS predicted FROM predictions),
{f1_sql('rounded')} SELECT {r('f1')} AS f1 FROM macro""",
)
def ordinal_f1(spark, folder):
    """F1 of a rounded regression output."""
    rows = order_predictions(spark, folder).withColumn("predicted", scoring.ordinal_class(F.col("score")))
    return scoring.macro_f1(rows, "label", "predicted")


LABELLED_DOCUMENTS = """
scored AS (
  SELECT doc_id AS bldg_id, quality AS label, (n_chars % 1000) / 1000.0 AS score, lang AS target,
         CASE WHEN (n_chars % 1000) / 1000.0 >= 0.5 THEN 1 ELSE 0 END AS predicted
  FROM documents JOIN labels USING (doc_id)
)"""


def labelled_documents(spark, folder):
    """Documents with a quality label and a score from their length."""
    return (
        table(spark, folder, "documents")
        .select("doc_id", "lang", "n_chars")
        .join(table(spark, folder, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("bldg_id"), F.col("quality").alias("label"),
            ((F.col("n_chars") % 1000) / 1000.0).alias("score"), F.col("lang").alias("target"),
        )
    )


@query("macro_f1_binary", f"WITH {LABELLED_DOCUMENTS}, {f1_sql('scored')} SELECT {r('f1')} AS f1 FROM macro")
def macro_f1_binary(spark, folder):
    """F1 of a thresholded score."""
    rows = labelled_documents(spark, folder).withColumn("predicted", scoring.threshold_class(F.col("score")))
    return scoring.macro_f1(rows, "label", "predicted")


@query(
    "roc_auc",
    f"""WITH {LABELLED_DOCUMENTS},
ranked AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM scored)
SELECT {r("(sum(place) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))")} AS auc FROM ranked""",
)
def roc_auc(spark, folder):
    """Area under the ROC curve by average ranks."""
    return scoring.roc_auc(labelled_documents(spark, folder), "label", "score")


def order_logits(spark, folder):
    """Five class scores per order."""
    rows = order_predictions(spark, folder).select("bldg_id", "target", "label", "fold", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("class"))
    return rows.withColumn("logit", (F.col("bldg_id") * (F.col("class") + 1)) % 11 / F.lit(11.0))


LOGITS = f"""{PREDICTIONS},
logits AS (
  SELECT bldg_id, target, label, fold, c AS class, (bldg_id * (c + 1)) % 11 / 11.0 AS logit
  FROM predictions, (SELECT unnest([0, 1, 2, 3, 4]) AS c)
),
probabilities AS (
  SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY bldg_id, target) AS probability FROM logits
)"""


@query(
    "group_softmax",
    f"WITH {LOGITS} SELECT bldg_id, target, CAST(class AS BIGINT) AS class, {r('probability')} AS probability FROM probabilities",
)
def group_softmax(spark, folder):
    """Softmax within each target."""
    return scoring.softmax(order_logits(spark, folder), "logit", ["bldg_id", "target"]).select("bldg_id", "target", "class", "probability")


@query(
    "cross_entropy",
    f"WITH {LOGITS}, per_target AS (SELECT target, -avg(ln(probability)) AS loss FROM probabilities WHERE class = label GROUP BY target) SELECT {r('sum(loss)')} AS loss FROM per_target",
)
def cross_entropy(spark, folder):
    """Cross-entropy summed over targets."""
    return scoring.cross_entropy(order_logits(spark, folder), "logit")


# --- training curves

TARGET_OF_FLAG = {"A": "building_stock_type", "N": "in_vintage_com", "R": "in_income_res"}
TARGET_CASE = "CASE l_returnflag WHEN 'A' THEN 'building_stock_type' WHEN 'N' THEN 'in_vintage_com' ELSE 'in_income_res' END"


def target_of_flag():
    flag = F.col("l_returnflag")
    return F.when(flag == "A", TARGET_OF_FLAG["A"]).when(flag == "N", TARGET_OF_FLAG["N"]).otherwise(TARGET_OF_FLAG["R"])


def curves(spark, folder):
    """Mean discounts and taxes of line items as training curves (target, fold, iteration, metric, value)."""
    keys = [target_of_flag().alias("target"), (F.col("l_partkey") % 5).cast("int").alias("fold"), (F.col("l_suppkey") % 20).cast("int").alias("iteration")]
    wide = table(spark, folder, "lineitem").groupBy(*keys).agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("loss"))
    return wide.unpivot(["target", "fold", "iteration"], ["f1", "loss"], "metric", "value")


CURVES = f"""
wide AS (
  SELECT {TARGET_CASE} AS target, l_partkey % 5 AS fold, l_suppkey % 20 AS iteration, avg(l_discount) AS f1, avg(l_tax) AS loss
  FROM lineitem GROUP BY ALL
),
curves AS (
  SELECT target, fold, iteration, 'f1' AS metric, f1 AS value FROM wide
  UNION ALL SELECT target, fold, iteration, 'loss', loss FROM wide
),
curve_means AS (SELECT target, metric, iteration, avg(value) AS average, stddev_samp(value) AS std FROM curves GROUP BY ALL),
best AS (
  SELECT target, iteration + 1 AS best_epoch, average AS best_score, std AS best_std FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(average, 12) DESC, iteration) AS place FROM curve_means WHERE metric = 'f1'
  ) WHERE place = 1
)"""


@query(
    "curve_statistics",
    f"WITH {CURVES} SELECT target, metric, CAST(iteration AS BIGINT) AS iteration, {r('average')} AS average, {r('std')} AS std FROM curve_means",
)
def curve_statistics(spark, folder):
    """Mean and deviation over folds per iteration."""
    return scoring.curve_statistics(curves(spark, folder))


BEST_SELECT = f"target, CAST(best_epoch AS BIGINT) AS best_epoch, {r('best_score')} AS best_score, {r('best_std')} AS best_std"


@query("best_iteration", f"WITH {CURVES} SELECT {BEST_SELECT} FROM best")
def best_iteration(spark, folder):
    """First iteration with the best mean score."""
    return scoring.best_iteration(curves(spark, folder), "f1")


@query(
    "best_iteration_of_loss",
    f"""WITH {CURVES},
low AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(average, 12), iteration) AS place FROM curve_means WHERE metric = 'loss')
SELECT target, CAST(iteration + 1 AS BIGINT) AS best_epoch, {r('average')} AS best_score, {r('std')} AS best_std FROM low WHERE place = 1""",
)
def best_iteration_of_loss(spark, folder):
    """First iteration with the lowest mean loss."""
    return scoring.best_iteration(curves(spark, folder), "loss", maximize=False)


@query(
    "weighted_score",
    f"""WITH {CURVES} SELECT {r("0.4 * avg(best_score) FILTER (WHERE target = 'building_stock_type') + 0.6 * (0.5 * avg(best_score) FILTER (WHERE target LIKE '%com') + 0.5 * avg(best_score) FILTER (WHERE target LIKE '%res'))")} AS score FROM best""",
)
def weighted_score(spark, folder):
    """0.4 x binary + 0.6 x mean of commercial and residential."""
    return scoring.weighted_score(scoring.best_iteration(curves(spark, folder), "f1"))


def baseline(spark, folder):
    """Score of the first iteration as the baseline to beat."""
    first = scoring.curve_statistics(curves(spark, folder)).filter((F.col("metric") == "f1") & (F.col("iteration") == 0))
    kind = F.when(F.col("target").endswith("com"), "COM").when(F.col("target").endswith("res"), "RES").otherwise("-")
    return first.select(F.col("target").alias("feature"), kind.alias("type"), F.col("average").alias("baseline"))


BASELINE = f"""{CURVES},
baselines AS (
  SELECT target AS feature, CASE WHEN target LIKE '%com' THEN 'COM' WHEN target LIKE '%res' THEN 'RES' ELSE '-' END AS type,
         average AS baseline FROM curve_means WHERE metric = 'f1' AND iteration = 0
),
detail AS (SELECT b.*, best_score AS new, best_score - baseline AS delta FROM baselines b LEFT JOIN best ON feature = target)"""


@query("baseline_detail", f"WITH {BASELINE} SELECT feature, type, {r('baseline')} AS baseline, {r('new')} AS new, {r('delta')} AS delta FROM detail")
def baseline_detail(spark, folder):
    """New score against the baseline, per target."""
    return scoring.baseline_detail(baseline(spark, folder), scoring.best_iteration(curves(spark, folder), "f1"))


def summary_sql(model: str) -> str:
    com, res, binary = (f"avg({model}) FILTER (WHERE type = '{kind}')" for kind in ("COM", "RES", "-"))
    return f"""SELECT '{model}' AS model, {r(com)} AS com, {r(res)} AS res, {r(binary)} AS "binary", {r(f'({com} + {res}) / 2')} AS avg_res_com,
{r(f'0.4 * {binary}')} AS binary_total, {r(f'0.6 * ({com} + {res}) / 2')} AS res_com_total, {r(f'0.4 * {binary} + 0.6 * ({com} + {res}) / 2')} AS total FROM detail"""


@query("baseline_delta", f"WITH {BASELINE} {summary_sql('baseline')} UNION ALL {summary_sql('new')}")
def baseline_delta(spark, folder):
    """Class means and weighted totals of both."""
    return scoring.baseline_summary(scoring.baseline_detail(baseline(spark, folder), scoring.best_iteration(curves(spark, folder), "f1")))


@query(
    "fold_score_table",
    f"""WITH {CURVES}, chosen AS (SELECT c.target, fold, value FROM curves c JOIN best b ON c.target = b.target AND c.iteration = b.best_epoch - 1 WHERE metric = 'f1')
SELECT target, {", ".join(f"{r(f'max(value) FILTER (WHERE fold = {f})')} AS fold_{f}" for f in range(5))}, {r('avg(value)')} AS average FROM chosen GROUP BY target""",
)
def fold_score_table(spark, folder):
    """Fold scores at the best iteration as columns."""
    all_curves = curves(spark, folder)
    scores = all_curves.filter(F.col("metric") == "f1").select("target", "fold", "iteration", F.col("value").alias("score"))
    return scoring.fold_score_table(scores, scoring.best_iteration(all_curves, "f1"), 5)


# --- importances


def gains(spark, folder):
    """Taxes of line items as gains (target, fold, feature, gain) with feature-like names."""
    month, weekday = F.month("l_shipdate").cast("string"), (F.weekday("l_shipdate") + 1).cast("string")
    key = F.col("l_partkey") % 4
    feature = (
        F.when(key == 0, F.concat(F.lit("average_hour_consumption_month_"), month, F.lit("_is_weekend_"), (F.col("l_linenumber") % 2).cast("string")))
        .when(key == 1, F.concat(F.lit("total_consumption_month_"), month))
        .when(key == 2, F.concat(F.lit("profile_max_weekday_"), weekday))
        .otherwise(F.concat(F.lit("average_hour_consumption_season_"), (F.col("l_linenumber") % 3).cast("string"), F.lit("_tou_"), (F.col("l_suppkey") % 3).cast("string")))
    )
    return (
        table(spark, folder, "lineitem")
        .groupBy(target_of_flag().alias("target"), (F.floor(F.col("l_partkey") / 4) % 5).cast("int").alias("fold"), feature.alias("feature"))
        .agg(F.sum("l_tax").alias("gain"))
    )


IMPORTANCE = f"""
gains AS (
  SELECT {TARGET_CASE} AS target, CAST(floor(l_partkey / 4) AS BIGINT) % 5 AS fold,
         CASE l_partkey % 4
           WHEN 0 THEN 'average_hour_consumption_month_' || month(l_shipdate) || '_is_weekend_' || l_linenumber % 2
           WHEN 1 THEN 'total_consumption_month_' || month(l_shipdate)
           WHEN 2 THEN 'profile_max_weekday_' || isodow(l_shipdate)
           ELSE 'average_hour_consumption_season_' || l_linenumber % 3 || '_tou_' || l_suppkey % 3 END AS feature,
         sum(l_tax) AS gain
  FROM lineitem GROUP BY ALL
),
importance AS (SELECT target, feature, sum(gain) / 5 AS average FROM gains GROUP BY ALL),
clusters AS (
  SELECT target, regexp_replace(feature, '[0-9]+', '\\\\d+', 'g') AS feature_cluster, avg(average) AS mean, min(average) AS min,
         max(average) AS max, CAST(count(*) AS BIGINT) AS count
  FROM importance GROUP BY ALL
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY mean DESC, feature_cluster) - 1 AS BIGINT) AS rank FROM clusters)"""


@query("importance_avg", f"WITH {IMPORTANCE} SELECT target, feature, {r('average')} AS average FROM importance")
def importance_avg(spark, folder):
    """Mean gain over folds."""
    return importance.average_importance(gains(spark, folder))


@query(
    "importance_top",
    f"WITH {IMPORTANCE} SELECT target, feature, {r('average')} AS average FROM importance ORDER BY importance.average DESC, target, feature LIMIT 50",
)
def importance_top(spark, folder):
    """The 50 most important features."""
    return importance.top_features(importance.average_importance(gains(spark, folder)), 50)


@query(
    "importance_template",
    f"""WITH {IMPORTANCE} SELECT target, feature_cluster, {r('mean')} AS mean, {r('"min"')} AS min, {r('"max"')} AS max, count, rank FROM ranked""",
)
def importance_template(spark, folder):
    """Importance by name template with its rank."""
    return importance.template_importance(importance.average_importance(gains(spark, folder)))


MATRIX_TARGETS = list(TARGET_OF_FLAG.values())


def matrix_sql(value: str, result: str, cast: str) -> str:
    columns = ", ".join(f"{cast.format(f'max({value}) FILTER (WHERE target = {chr(39)}{t}{chr(39)})')} AS {t}" for t in MATRIX_TARGETS)
    return f"WITH {IMPORTANCE} SELECT feature_cluster, count, {columns}, {r(f'avg({value})')} AS {result} FROM ranked GROUP BY feature_cluster, count"


@query("importance_matrix", matrix_sql("mean", "average_imp", r("{0}")))
def importance_matrix(spark, folder):
    """Templates x targets with their mean importance."""
    templates = importance.template_importance(importance.average_importance(gains(spark, folder)))
    return importance.importance_matrix(templates, MATRIX_TARGETS)


@query("importance_rank_matrix", matrix_sql("rank", "average_rank", r("{0}")))
def importance_rank_matrix(spark, folder):
    """Templates x targets with their rank."""
    templates = importance.template_importance(importance.average_importance(gains(spark, folder)))
    ranked = templates.withColumn("rank", F.col("rank").cast("double"))
    return importance.importance_matrix(ranked, MATRIX_TARGETS, "rank")


@query(
    "pattern_cluster",
    f"""WITH {IMPORTANCE}, matched AS (
  SELECT average, CASE
    WHEN regexp_matches(feature, '^average_hour_consumption_season_\\d+_tou_\\d+') THEN 'average_hour_consumption_season_\\d+_tou_\\d+'
    WHEN regexp_matches(feature, '^average_hour_consumption_month_\\d+_is_weekend_\\d+') THEN 'average_hour_consumption_month_\\d+_is_weekend_\\d+'
    WHEN regexp_matches(feature, '^total_consumption_month_\\d+') THEN 'total_consumption_month_\\d+' END AS feature_cluster
  FROM importance
)
SELECT feature_cluster, {r('avg(average)')} AS mean, {r('min(average)')} AS min, {r('max(average)')} AS max, CAST(count(*) AS BIGINT) AS count
FROM matched WHERE feature_cluster IS NOT NULL GROUP BY feature_cluster""",
)
def pattern_cluster(spark, folder):
    """Importance by the first fixed name pattern that matches."""
    return importance.pattern_importance(importance.average_importance(gains(spark, folder)))


# --- out-of-fold scores and ensembles


@query(
    "oof_scores",
    f"""WITH {PREDICTIONS}, {f1_sql('predictions', 'fold, iteration, target')}
SELECT CAST(fold AS BIGINT) AS fold, CAST(iteration AS BIGINT) AS iteration, target, {r('f1')} AS f1 FROM macro""",
)
def oof_scores(spark, folder):
    """F1 per fold, iteration and target."""
    return scoring.macro_f1(order_predictions(spark, folder), "label", "predicted", ["fold", "iteration", "target"])


@query(
    "oof_score",
    f"""WITH {PREDICTIONS}, {f1_sql('predictions', 'fold, target')}, per_fold AS (SELECT fold, avg(f1) AS f1 FROM macro GROUP BY fold)
SELECT {r('avg(f1)')} AS f1 FROM per_fold""",
)
def oof_score(spark, folder):
    """Mean over folds of the mean over targets."""
    return scoring.out_of_fold_score(order_predictions(spark, folder), "label", "predicted")


def fold_probabilities(spark, folder):
    """Class probabilities of three fold models per line item order and target.

    The binary target has its positive class only. Probabilities are eighths, so ties occur.
    """
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("bldg_id"), F.col("o_custkey").alias("c"))
    target = F.explode(F.array(*[F.lit(name) for name in ENSEMBLE_CLASSES])).alias("target")
    classes = F.when(F.col("target") == "building_stock_type", F.array(F.lit(1))).when(
        F.col("target") == "in_vintage_com", F.sequence(F.lit(0), F.lit(3))
    ).otherwise(F.sequence(F.lit(0), F.lit(2)))
    rows = orders.select("bldg_id", "c", target).withColumn("class", F.explode(classes)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2))))
    mixed = (F.col("bldg_id") * (F.col("class") + 2) + F.col("c") * (F.col("fold") + 1)) % 8
    return rows.select("bldg_id", "target", "class", "fold", (mixed / F.lit(8.0)).alias("probability"))


ENSEMBLE_CLASSES = {"building_stock_type": [1], "in_vintage_com": [0, 1, 2, 3], "in_bedrooms_res": [0, 1, 2]}
CLASS_ROWS = ", ".join(f"('{t}', {c})" for t, cs in ENSEMBLE_CLASSES.items() for c in cs)
BLENDED = f"""
fold_probabilities AS (
  SELECT o_orderkey AS bldg_id, target, class, fold, (o_orderkey * (class + 2) + o_custkey * (fold + 1)) % 8 / 8.0 AS probability
  FROM orders, (VALUES {CLASS_ROWS}) t(target, class), (VALUES (0), (1), (2)) f(fold)
),
blended AS (SELECT bldg_id, target, class, sum(probability) / 3 AS probability FROM fold_probabilities GROUP BY ALL),
classes AS (
  SELECT bldg_id, target, CASE WHEN target = 'building_stock_type' THEN CASE WHEN max(probability) > 0.5 THEN 1 ELSE 0 END
         ELSE min(class) FILTER (WHERE probability = top) END AS code
  FROM (SELECT *, max(probability) OVER (PARTITION BY bldg_id, target) AS top FROM blended) GROUP BY bldg_id, target
)"""


@query(
    "blend_probabilities",
    f"WITH {BLENDED} SELECT bldg_id, target, CAST(class AS BIGINT) AS class, {r('probability')} AS probability FROM blended",
)
def blend_probabilities(spark, folder):
    """Fold models averaged."""
    return ensemble.blend(fold_probabilities(spark, folder), 3)


@query("blend_argmax", f"WITH {BLENDED} SELECT bldg_id, target, CAST(code AS BIGINT) AS code FROM classes")
def blend_argmax(spark, folder):
    """Most probable class of the blend, the first on a tie; the binary target above one half."""
    return ensemble.predicted_class(ensemble.blend(fold_probabilities(spark, folder), 3))


PREDICT_COLUMNS = ", ".join(f"CAST(max(code) FILTER (WHERE target = '{t}') AS BIGINT) AS {t}" for t in ENSEMBLE_CLASSES)


@query("predict_table", f"WITH {BLENDED} SELECT bldg_id, {PREDICT_COLUMNS} FROM classes GROUP BY bldg_id")
def predict_table(spark, folder):
    """One column per target."""
    return ensemble.predict_table(ensemble.predicted_class(ensemble.blend(fold_probabilities(spark, folder), 3)), list(ENSEMBLE_CLASSES))


DECODE_MAPS = {
    "building_stock_type": {"commercial": 0, "residential": 1},
    "in_vintage_com": {"Before 1946": 0, "1946 to 1959": 1, "1960 to 1969": 2, "1970 to 1979": 3},
    "in_bedrooms_res": {"1": 0, "2": 1, "3": 2},
}


def case_sql(target: str) -> str:
    whens = " ".join(f"WHEN {code} THEN '{value}'" for value, code in DECODE_MAPS[target].items())
    return f"CASE {target} {whens} END"


@query(
    "nullout_decode",
    f"""WITH {BLENDED}, wide AS (SELECT bldg_id, {PREDICT_COLUMNS} FROM classes GROUP BY bldg_id)
SELECT bldg_id, {case_sql('building_stock_type')} AS building_stock_type,
       CASE WHEN building_stock_type = 0 THEN {case_sql('in_vintage_com')} END AS in_vintage_com,
       CASE WHEN building_stock_type = 1 THEN {case_sql('in_bedrooms_res')} END AS in_bedrooms_res FROM wide""",
)
def nullout_decode(spark, folder):
    """Decoded predictions without those of the other building kind."""
    return ensemble.null_out(decode(predict_table(spark, folder), DECODE_MAPS), list(ENSEMBLE_CLASSES))


@query(
    "predictions_at_best",
    f"""WITH {CURVES} SELECT c.target, CAST(fold AS BIGINT) AS fold, metric, {r('value')} AS value, CAST(iteration AS BIGINT) AS iteration
FROM curves c JOIN best b ON c.target = b.target AND c.iteration = b.best_epoch - 1""",
)
def predictions_at_best(spark, folder):
    """Rows of each target cut at its best iteration."""
    all_curves = curves(spark, folder)
    return ensemble.at_best_iteration(all_curves, scoring.best_iteration(all_curves, "f1"))


@query(
    "one_hot_class",
    "SELECT o_orderkey AS bldg_id, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS class FROM orders",
)
def one_hot_class(spark, folder):
    """One-hot group back to a class index."""
    hot = ensemble.one_hot(table(spark, folder, "orders").select(F.col("o_orderkey").alias("bldg_id"), "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])
    return ensemble.one_hot_class(hot, [f"o_orderstatus_{v}" for v in ("F", "O", "P")], "class").select("bldg_id", "class")


@query(
    "argmax_class",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
       CAST(CASE WHEN l_discount >= l_tax AND l_discount >= l_quantity / 500 THEN 0 WHEN l_tax >= l_quantity / 500 THEN 1 ELSE 2 END AS BIGINT) AS class
FROM lineitem""",
)
def argmax_class(spark, folder):
    """Index of the largest of several class scores, the first on a tie."""
    scores = F.array("l_discount", "l_tax", F.col("l_quantity") / 500)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scoring.argmax_class(scores).alias("class"))


# --- statistics


@query(
    "standardize",
    f"""WITH m AS (SELECT avg(p_size) AS ms, stddev_samp(p_size) AS ss, avg(p_retailprice) AS mr, stddev_samp(p_retailprice) AS sr FROM part)
SELECT p_partkey, {r('(p_size - ms) / ss')} AS p_size, {r('(p_retailprice - mr) / sr')} AS p_retailprice FROM part, m""",
)
def standardize(spark, folder):
    """Features minus their mean over their deviation."""
    return statistics.standardize(table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query(
    "feature_moments",
    f"SELECT {r('avg(l_quantity)')} AS l_quantity_mean, {r('stddev_samp(l_quantity)')} AS l_quantity_std, {r('avg(l_tax)')} AS l_tax_mean, {r('stddev_samp(l_tax)')} AS l_tax_std FROM lineitem",
)
def feature_moments(spark, folder):
    return statistics.feature_moments(table(spark, folder, "lineitem"), ["l_quantity", "l_tax"])


@query(
    "class_feature_means",
    f"SELECT CAST(quality AS BIGINT) AS quality, {r('avg(n_chars)')} AS n_chars, {r('avg(doc_id)')} AS doc_id FROM documents JOIN labels USING (doc_id) GROUP BY quality",
)
def class_feature_means(spark, folder):
    """Labels joined to features, then the mean of each feature per class."""
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id", "inner")
    return statistics.class_means(joined, "quality", ["n_chars", "doc_id"])


@query(
    "prior_margin",
    f"WITH {PREDICTIONS} SELECT bldg_id, target, CAST(label AS BIGINT) AS label, {r('avg(label) OVER (PARTITION BY target)')} AS margin FROM predictions",
)
def prior_margin(spark, folder):
    """The target's mean label on every row."""
    rows = order_predictions(spark, folder).select("bldg_id", "target", "label")
    return ensemble.with_prior_margin(rows, rows)
