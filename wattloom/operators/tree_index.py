"""Permutation importance of boosted trees by an index from features to the leaves that depend on them.

A variant of a row has one feature from its donor. Only leaves with a condition on that feature can be left or entered by it, so
the margin of a variant is the row's own margin and what these leaves change: work follows the entries of the index, where
scoring every variant with the whole model costs features times trees. All variants of a row come from one look at it.

A leaf is reached by the variant of feature f if its conditions on other features hold for the row and those on f hold
for the donor. So per leaf the features on which the row fails are counted; with none the row itself is there, and with
one, f, the variant of f is there if the donor holds on f.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators import models
from wattloom.operators.boosting import Boosted, tree_leaves
from wattloom.operators.scoring import macro_f1, mean_over
from wattloom.session import cut_lineage

#: Rows whose variants are held at once.
BLOCK_ROWS = 512


@dataclass(frozen=True)
class Leaf:
    """A leaf's value and its conditions by feature: (feature, ((place, is below, threshold), ...))."""

    value: float
    features: tuple[tuple[int, tuple[tuple[int, bool, float], ...]], ...]


@dataclass(frozen=True)
class Index:
    """The leaves of every class' ensemble. `binary`: one margin, class 1 above 0; else the class of the largest margin."""

    leaves: tuple[tuple[Leaf, ...], ...]
    start: tuple[float, ...]
    binary: bool
    n_features: int

    def entries(self) -> int:
        """Pairs of leaf and feature: the work per row."""
        return sum(len(leaf.features) for ensemble in self.leaves for leaf in ensemble)

    def used(self) -> list[int]:
        """Features that some tree splits on; no variant of another can change."""
        return sorted({f for ensemble in self.leaves for leaf in ensemble for f, _ in leaf.features})


def indexed(model, slots: Sequence[tuple[str, int, int]]) -> Index:
    """The index of a boosted classifier (binary, or one ensemble per class) or of a joint one."""
    feature_of = {place: number for number, (_, first, size) in enumerate(slots) for place in range(first, first + size)}

    def leaves_of(trees: Sequence, weights: Sequence[float]) -> tuple[Leaf, ...]:
        out = []
        for tree, weight in zip(trees, weights, strict=True):
            for value, conditions in tree_leaves(tree):
                by: dict[int, list[tuple[int, bool, float]]] = {}
                for place, sign, threshold in conditions:
                    by.setdefault(feature_of[place], []).append((place, sign == "<=", threshold))
                out.append(Leaf(value * weight, tuple((f, tuple(held)) for f, held in by.items())))
        return tuple(out)

    if isinstance(model, Boosted):
        stages, k = model.stages(), model.classes
        ensembles = tuple(leaves_of(stages[c::k], [model.rate] * len(stages[c::k])) for c in range(k))
        return Index(ensembles, model.prior, False, len(slots))
    boosters = models.boosters(model)
    if not boosters:
        raise ValueError("only boosted trees have an index")
    return Index(tuple(leaves_of(b.trees, b.treeWeights) for b in boosters), (0.0,) * len(boosters), len(boosters) == 1, len(slots))


def variant_margins(index: Index, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x classes) margins of the rows, and (classes x rows x features) what each variant adds to them."""
    base = np.tile(np.array(index.start), (len(own), 1))
    change = np.zeros((len(index.leaves), len(own), index.n_features))
    for k, ensemble in enumerate(index.leaves):
        for leaf in ensemble:
            fails = np.zeros(len(own), np.int32)
            holds = []
            for feature, conditions in leaf.features:
                mine, lent = np.ones(len(own), bool), np.ones(len(own), bool)
                for place, below, threshold in conditions:
                    mine &= (own[:, place] <= threshold) == below
                    lent &= (other[:, place] <= threshold) == below
                fails += ~mine
                holds.append((feature, mine, lent))
            there = fails == 0
            base[:, k] += leaf.value * there
            for feature, mine, lent in holds:
                change[k, :, feature] += leaf.value * ((lent & (fails == ~mine)).astype(np.int8) - there)
    return base, change


def _classes(index: Index, margins: np.ndarray) -> np.ndarray:
    """The class of each row of margins (classes first)."""
    rounded = np.round(margins, 12)
    return (rounded[0] > 0).astype(np.int32) if index.binary else rounded.argmax(axis=0).astype(np.int32)


def permuted_counts(index: Index, paired: DataFrame) -> DataFrame:
    """(feature, label, predicted, n) of all variants of `paired` (label, own, other); feature -1 is the rows themselves.

    Tasks count before anything is shuffled.
    """
    sent = paired.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        used = known.used()
        total: dict[tuple[int, int, int], int] = {}

        def add(feature: int, labels: np.ndarray, predicted: np.ndarray) -> None:
            pairs, counts = np.unique(np.stack([labels, predicted]), axis=1, return_counts=True)
            for label, guess, n in zip(*pairs.tolist(), counts.tolist(), strict=True):
                total[feature, label, guess] = total.get((feature, label, guess), 0) + n

        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(first, BLOCK_ROWS)
                own, other = (some.column(x).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1) for x in ("own", "other"))
                labels = some.column("label").to_numpy(zero_copy_only=False).astype(np.int32)
                base, change = variant_margins(known, own, other)
                add(-1, labels, _classes(known, base.T))
                for feature in used:
                    add(feature, labels, _classes(known, base.T + change[:, :, feature]))
        # A feature that no tree splits on changes nothing: its variants count as the rows themselves.
        itself = [(label, guess, n) for (feature, label, guess), n in total.items() if feature < 0]
        rows = [(*key, n) for key, n in total.items()]
        rows += [(feature, *counted) for feature in sorted(set(range(known.n_features)) - set(used)) for counted in itself]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x, pa.int32()) for x in columns[:3]], pa.array(columns[3], pa.int64())], names=["feature", "label", "predicted", "n"]
        )

    counted = paired.select("label", "own", "other").mapInArrow(work, "feature int, label int, predicted int, n long")
    return counted.groupBy("feature", "label", "predicted").agg(F.sum("n").alias("n"))


def permutation_importance(
    fold_models: Sequence[PipelineModel], gold: DataFrame, target: str, slots: Sequence[tuple[str, int, int]],
    repetitions: int = 3, seed: int = 0, entity: str = "bldg_id",
) -> DataFrame:
    """What `models.permutation_importance` gives for boosted trees, by the index: every row and its donor are read once."""
    spark = gold.sparkSession
    parts = []
    for fold, model in enumerate(fold_models):
        valid = models.prepared(model, models.validation(gold, target, fold)).select(entity, "label", vector_to_array("features").alias("own"))
        index = indexed(model.stages[-1], slots)
        for repetition in range(repetitions):
            pairs = cut_lineage(models.donor_pairs(valid, repetition, seed, entity))
            donors = valid.select(F.col(entity).alias("donor"), F.col("own").alias("other"))
            paired = valid.join(pairs, entity).join(donors, "donor").select("label", "own", "other")
            counts = permuted_counts(index, paired)
            parts.append(counts.withColumns({"fold": F.lit(fold), "repetition": F.lit(repetition)}))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    f1 = macro_f1(every, "label", "predicted", ["feature", "fold", "repetition"], rows="n")
    mean = mean_over(mean_over(f1, ["feature", "fold"]), ["feature"])
    names = spark.createDataFrame([(number, name) for number, (name, _, _) in enumerate(slots)], "feature int, name string")
    # One row per feature.
    base = F.max(F.when(F.col("feature") == -1, F.col("f1"))).over(Window.partitionBy())
    lost = mean.withColumn("importance", base - F.col("f1")).filter("feature >= 0").select("feature", "importance")
    return names.join(F.broadcast(lost), "feature", "left").select(
        F.lit(target).alias("target"), F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance")
    )
