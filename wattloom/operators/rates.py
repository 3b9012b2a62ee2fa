"""Class rates of a category as numeric features, learned out of fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the prior that every category is mixed with.
PRIOR_ROWS = 20.0


def rate_names(category: str, classes: int) -> list[str]:
    return [f"{category}_rate_{k}" for k in range(classes)]


def with_category_rates(
    rows: DataFrame, category: str, label: str, classes: int, prior_rows: float = PRIOR_ROWS, fold: str = "fold"
) -> DataFrame:
    """Add per class the share of the row's category that has it, counted over the labelled rows of all other folds.

    A share is mixed with `prior_rows` rows of the share over all categories, of the other folds likewise, so a rare category
    tends to the whole and an unknown one is equal to it. A row never sees its own label, nor any of its fold. Rows without a
    fold see all folds; a null category is one of its own; null labels count nowhere, and with no label at all rates are 0.

    One shuffle of counts per (category, fold) after partial sums. They come back by one join of a row per category, whose
    folds are a map; the totals are one row. Category tables of any size go; a hot category is left to adaptive execution.
    """

    def summed(column: str) -> Column:
        return F.array(*[F.sum(F.get(column, F.lit(k))) for k in range(classes)])

    def by_fold(column: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col(fold).isNotNull(), F.struct(fold, column))))

    known = rows.filter(F.col(label).isNotNull())
    hits = F.array(*[F.count_if(F.col(label) == k) for k in range(classes)])
    cells = known.groupBy(F.col(category).alias("_category"), fold).agg(hits.alias("_own"))
    table = cells.groupBy("_category").agg(summed("_own").alias("_all"), by_fold("_own").alias("_folds"))
    folds = cells.groupBy(fold).agg(summed("_own").alias("_own"))
    totals = folds.agg(summed("_own").alias("_sum"), by_fold("_own").alias("_sums"))
    nothing = F.array(*[F.lit(0).cast("long")] * classes)

    def others(every: Column, own: Column) -> Column:
        mine = F.coalesce(F.try_element_at(own, F.col(fold)), nothing)
        return F.zip_with(F.coalesce(every, nothing), mine, lambda a, b: a - b)

    joined = rows.join(table, rows[category].eqNullSafe(F.col("_category")), "left")
    joined = joined.withColumns({"_sum": totals.select("_sum").scalar(), "_sums": totals.select("_sums").scalar()})
    ready = joined.withColumns({"_counts": others(F.col("_all"), F.col("_folds")), "_whole": others(F.col("_sum"), F.col("_sums"))})

    def size(column: str) -> Column:
        return F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)

    rates = []
    for k, name in enumerate(rate_names(category, classes)):
        prior = F.coalesce(F.get("_whole", F.lit(k)) / F.nullif(size("_whole"), F.lit(0)), F.lit(0.0))
        rates.append(((F.get("_counts", F.lit(k)) + prior_rows * prior) / (size("_counts") + prior_rows)).alias(name))
    return ready.select(*rows.columns, *rates)


def rated_split(
    gold: DataFrame, category: str, label: str, classes: int, split: int, prior_rows: float = PRIOR_ROWS, fold: str = "fold"
) -> DataFrame:
    """`with_category_rates` for the model that is validated on fold `split`: no label of that fold enters any rate."""
    seen = gold.withColumn("_seen", F.when(F.col(fold).isNull() | (F.col(fold) != split), F.col(label)))
    return with_category_rates(seen, category, "_seen", classes, prior_rows, fold).drop("_seen")
