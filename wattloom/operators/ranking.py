"""Exact ranks, running totals and first-k selections without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.order_keys import bucket_of, order_key
from wattloom.session import cut_lineage


def _join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which null equals null."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = [left[key].eqNullSafe(renamed[f"_right_{key}"]) for key in keys]
    return left.join(renamed, same).drop(*[f"_right_{key}" for key in keys])


def rank_in_group(
    df: DataFrame, groups: Sequence[str], key: Column, rank: str = "rank", by: Sequence[str] | None = None
) -> DataFrame:
    """0-based rank within each group by a uniform order key (see `order_keys`).

    A group is cut into 4,096 ordered buckets: the rank is the number of rows in earlier buckets plus
    the position inside the bucket. Join and window use the same (group, bucket) keys, so a group that
    holds a third of all rows is spread over its buckets. Rows with a null group are a group of their own.

    With `by` (a leading part of `groups`) ranks go on from group to group within `by`.
    """
    keyed = df.withColumns({"_key": key, "_bucket": bucket_of(key)})
    slots = [*groups, "_bucket"]
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*slots).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if by is not None:
        # One row per group; it meets the bucket counts only, never the rows.
        rest = [group for group in groups if group not in by]
        earlier_groups = Window.partitionBy(*by).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            counts.groupBy(*groups)
            .agg(F.sum("_n").alias("_n"))
            .withColumn("_start", F.coalesce(F.sum("_n").over(earlier_groups), F.lit(0)))
            .drop("_n")
        )
        offsets = _join_nulls(offsets, starts, groups).withColumn("_before", F.col("_before") + F.col("_start")).drop("_start")
    position = F.row_number().over(Window.partitionBy(*slots).orderBy("_key"))
    return (
        _join_nulls(keyed, offsets, slots)
        .withColumn(rank, F.col("_before") + position - 1)
        .drop("_key", "_bucket", "_before")
    )


def running_total(df: DataFrame, order: Sequence[str], totals: dict[str, str]) -> DataFrame:
    """Inclusive running sums in the order of unique `order` columns; `totals` maps value to result column.

    Rows are range-partitioned and written once, so the partition of a row is a stored fact. Only one
    total per partition is combined across partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    kept = cut_lineage(ordered).withColumn("_part", F.shiftrightunsigned("_slot", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition.
    sums = kept.groupBy("_part").agg(*[F.sum(value).alias(f"_sum_{value}") for value in totals])
    offsets = sums.select(
        "_part", *[F.coalesce(F.sum(f"_sum_{value}").over(before), F.lit(0)).alias(f"_before_{value}") for value in totals]
    )
    inside = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    return (
        kept.join(F.broadcast(offsets), "_part")
        .withColumns(
            {
                result: F.sum(value).over(inside) + F.col(f"_before_{value}")
                for value, result in totals.items()
            }
        )
        .drop("_slot", "_part", *[f"_before_{value}" for value in totals])
    )


def dense_ids(df: DataFrame, keys: Sequence[str], result: str = "new_id", start: int = 30_000) -> DataFrame:
    """Distinct keys with consecutive ids in the order of their concatenated text."""
    text = F.concat(*[F.col(key).cast("string") for key in keys])
    distinct = df.select(*keys).distinct().withColumns({"_order": text, "_one": F.lit(1)})
    return (
        running_total(distinct, ["_order", *keys], {"_one": result})
        .withColumn(result, F.lit(start).cast("long") + F.col(result) - 1)
        .drop("_order", "_one")
    )


def first_k(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], k: int, spread: str) -> DataFrame:
    """The first `k` rows of each group by `order`.

    Each group is first cut by the hash of `spread` and every part keeps its own first k, so no task
    sorts a whole group; the first k of those are the first k of the group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(64)))
    part = Window.partitionBy(*groups, "_salt").orderBy(*order)
    whole = Window.partitionBy(*groups).orderBy(*order)
    return (
        salted.withColumn("_place", F.row_number().over(part))
        .filter(F.col("_place") <= k)
        .withColumn("_place", F.row_number().over(whole))
        .filter(F.col("_place") <= k)
        .drop("_salt", "_place")
    )


def first_ids(ids: DataFrame, groups: Sequence[str], k: int, entity: str = "bldg_id") -> DataFrame:
    """The `k` smallest distinct ids per group."""
    return first_k(ids.select(*groups, entity).distinct(), groups, [entity], k, entity)


def random_ids(ids: DataFrame, groups: Sequence[str], k: int, seed: int = 0, entity: str = "bldg_id") -> DataFrame:
    """`k` ids per group in the repeatable pseudo-random order of `seed`."""
    distinct = ids.select(*groups, entity).distinct()
    return first_k(distinct, groups, [order_key(seed, entity), entity], k, entity)
