"""Target populations and cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import ALL_TARGETS, BINARY_TARGET, FOLDS, safe_name
from wattloom.functions.order_keys import order_key
from wattloom.functions.text import target_class
from wattloom.operators.ranking import rank_in_group
from wattloom.session import cut_lineage


def long_labels(
    labels: DataFrame,
    targets: Sequence[str] = tuple(map(safe_name, ALL_TARGETS)),
    entity: str = "bldg_id",
    binary: str = BINARY_TARGET,
    commercial_code: int = 0,
) -> DataFrame:
    """One row (entity, target, code) for each entity in the population of a target.

    The binary target takes every entity; commercial targets take commercial entities with a value,
    residential targets the others with a value.
    """
    long = labels.select(
        entity,
        F.col(binary).alias("_kind"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(target).alias("target"), F.col(target).cast("int").alias("code"))
                    for target in targets
                ]
            )
        ).alias("_label"),
    ).select(entity, "_kind", "_label.target", "_label.code")
    commercial = F.col("_kind") == commercial_code
    of_class = target_class(F.col("target"))
    member = (
        F.when(of_class == "binary", True)
        .when(of_class == "commercial", commercial & F.col("code").isNotNull())
        .otherwise(~commercial & F.col("code").isNotNull())
    )
    return long.filter(member).drop("_kind")


def stratified_folds(
    df: DataFrame, stratum: str, k: int = FOLDS, seed: int = 0, by: Sequence[str] = (), entity: str = "bldg_id"
) -> DataFrame:
    """Add `fold` so that fold sizes differ by at most one, per class and overall.

    Rows are dealt out in the order (class, pseudo-random key). `by` separates independent problems,
    such as targets. Rows without a class have to be filtered before.
    """
    ranked = rank_in_group(df, [*by, stratum], order_key(seed, entity), "_rank", by)
    return ranked.withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank")


def random_folds(df: DataFrame, k: int = FOLDS, seed: int = 0, entity: str = "bldg_id") -> DataFrame:
    """Add `fold` by pseudo-random rank; sizes differ by at most one."""
    ranked = rank_in_group(df.withColumn("_all", F.lit(0)), ["_all"], order_key(seed, entity), "_rank")
    return ranked.withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank", "_all")


def label_set_folds(
    df: DataFrame, labels: Sequence[str], k: int = FOLDS, seed: int = 0, entity: str = "bldg_id"
) -> DataFrame:
    """Add `fold`, balanced within ±1 over combinations of several labels.

    A combination seen fewer than `k` times joins the pool of its rarest label. Every stratum starts
    dealing at its own fold, so no order over all strata is needed.
    """
    # Codes keep the place of each label, and null is a value of its own.
    parts = [F.concat(F.lit(f"{label}="), F.coalesce(F.col(label).cast("string"), F.lit("-"))) for label in labels]
    tagged = df.withColumn("_set", F.concat_ws("|", *parts))
    sets = tagged.groupBy("_set", *labels).agg(F.count(F.lit(1)).alias("_n"))
    member = F.explode(F.split("_set", r"\|")).alias("_label")
    frequency = sets.select("_n", member).groupBy("_label").agg(F.sum("_n").alias("_label_n"))
    rarest = (
        sets.filter(F.col("_n") < k)
        .select("_set", member)
        .join(frequency, "_label")
        .groupBy("_set")
        .agg(F.min(F.struct("_label_n", "_label"))["_label"].alias("_rarest"))
    )
    # A frequent combination is never in `rarest`; adaptive execution splits it should the rows be shuffled.
    strata = tagged.join(rarest, ["_set"], "left").withColumn("_stratum", F.coalesce(F.concat(F.lit("pool:"), "_rarest"), "_set"))
    start = F.conv(F.substring(F.md5(F.col("_stratum").cast("binary")), 1, 4), 16, 10).cast("long")
    ranked = rank_in_group(strata, ["_stratum"], order_key(seed, entity), "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") + start, F.lit(k)).cast("int")).drop(
        "_rank", "_stratum", "_rarest", "_set"
    )


def iterative_folds(
    df: DataFrame, labels: Sequence[str], k: int = FOLDS, seed: int = 0, entity: str = "bldg_id"
) -> DataFrame:
    """Add `fold`, balanced over every single label of several label columns, by iterative stratification.

    A label is a column with a value. Each round takes the label that fewest rows without a fold still have and deals exactly
    these rows: every fold gets what it lacks of the label's even share, to whole rows by the largest remainder. Rows without
    any label are dealt last, by what folds lack in rows. A round's rows are those that have its label and none of the rounds
    before, so the rows that are left are a filter, never a table that is written again; a round stores only the rows it
    deals. The driver holds counts per label and fold, which schema and dictionaries bound; rows never pass it.

    Rows of a round are dealt by rank in a pseudo-random order. Per label the folds differ by no more than the number of
    rounds until it is dealt, and no row is left out. Null values are no labels.
    """
    parts = [F.when(F.col(label).isNotNull(), F.concat(F.lit(f"{label}="), F.col(label).cast("string"))) for label in labels]
    narrow = cut_lineage(df.select(entity, F.array_compact(F.array(*parts)).alias("_labels")))
    label_of = F.explode("_labels").alias("label")
    totals = {row["label"]: row["count"] for row in narrow.select(label_of).groupBy("label").count().collect()}
    size = narrow.count()
    given = {label: [0] * k for label in totals}
    rows_given = [0] * k
    left, done = dict(totals), []
    dealt = []
    while True:
        rarest = min(((n, label) for label, n in left.items() if n > 0), default=None)
        rest = narrow.filter(~F.arrays_overlap("_labels", F.array(*map(F.lit, done)))) if done else narrow
        if rarest is None:
            count, lacking = size - sum(rows_given), [size / k - n for n in rows_given]
            chosen = rest
        else:
            count, label = rarest
            lacking = [totals[label] / k - n for n in given[label]]
            chosen = rest.filter(F.array_contains("_labels", label))
        if count:
            quotas = _quotas(lacking, count, [size / k - n for n in rows_given])
            ranked = rank_in_group(chosen.withColumn("_all", F.lit(0)), ["_all"], order_key(seed, entity), "_rank")
            fold = F.lit(k - 1)
            for number in range(k - 2, -1, -1):
                fold = F.when(F.col("_rank") < sum(quotas[: number + 1]), number).otherwise(fold)
            part = cut_lineage(ranked.select(entity, "_labels", fold.cast("int").alias("fold")))
            dealt.append(part.select(entity, "fold"))
            rows_given = [a + b for a, b in zip(rows_given, quotas, strict=True)]
            for row in part.select("fold", label_of).groupBy("label", "fold").count().collect():
                given[row["label"]][row["fold"]] += row["count"]
                left[row["label"]] -= row["count"]
        if rarest is None:
            break
        done.append(label)
    if not dealt:
        return df.withColumn("fold", F.lit(None).cast("int"))
    return df.join(reduce(DataFrame.unionByName, dealt), entity)


def _quotas(lacking: Sequence[float], count: int, rows_lacking: Sequence[float]) -> list[int]:
    """`count` rows to folds by what each lacks; what is left of whole rows goes to the largest remainders, then to the fold
    that lacks most rows."""
    wanted = [max(0.0, x) for x in lacking]
    total = sum(wanted)
    shares = [count * x / total if total else count / len(wanted) for x in wanted]
    quotas = [int(x + 1e-9) for x in shares]
    order = sorted(range(len(shares)), key=lambda f: (-round(shares[f] - quotas[f], 9), -rows_lacking[f], f))
    for fold in order[: count - sum(quotas)]:
        quotas[fold] += 1
    return quotas


def fold_info(fold: Column, k: int = FOLDS) -> Column:
    """`t, v, t, t, t`: per split, v where the row validates, t where it trains, n without a fold."""
    flags = [F.when(fold != split, "t").when(fold == split, "v").otherwise("n") for split in range(k)]
    return F.concat_ws(", ", *flags)


def current_fold(split: int, info: str = "fold_info") -> Column:
    return F.get(F.split(info, ", "), F.lit(split))


def fold_split(df: DataFrame, split: int, info: str = "fold_info") -> tuple[DataFrame, DataFrame]:
    """(train, validation) rows of one split."""
    flagged = df.withColumn("current_fold", current_fold(split, info))
    return flagged.filter(F.col("current_fold") == "t"), flagged.filter(F.col("current_fold") == "v")


def leakage(train: DataFrame, valid: DataFrame, entity: str = "bldg_id") -> DataFrame:
    """Entities that occur on both sides; must be empty."""
    return train.select(entity).intersect(valid.select(entity))


def check_no_leakage(train: DataFrame, valid: DataFrame, entity: str = "bldg_id") -> None:
    if not leakage(train, valid, entity).isEmpty():
        raise ValueError("train and validation rows share entities")
