"""Softmax boosting: one ensemble for all classes, in blocks of rounds that can be stopped early and taken up again.

Every round fits one regression tree per class to the residuals of the shared softmax; the fits of a round are in flight
together. The margins of a row are an array column. After each block of rounds the rows with their margins are written, then
the block's trees, then its losses; the losses are the block's commit. A job that is lost goes on behind the last block
whose losses are there. Nothing of the rows passes the driver, which sees two losses a round.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators.scoring import argmax_class

LOSS_SCHEMA = "round int, train_loss double, valid_loss double"
LEAST_CHANCE = 1e-15


def softmax_of(margins: str | Column) -> Column:
    """Class probabilities of an array of margins."""
    column = F.col(margins) if isinstance(margins, str) else margins
    weights = F.transform(column, lambda x: F.exp(x - F.array_max(column)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def log_loss(margins: str, label: str) -> Column:
    """Mean negative log probability of the true class."""
    return -F.avg(F.log(F.greatest(F.get(softmax_of(margins), F.col(label)), F.lit(LEAST_CHANCE))))


@dataclass(frozen=True)
class Boosted:
    """A fitted ensemble. `trees` holds per block the trees of its rounds, round by round and class by class."""

    prior: tuple[float, ...]
    rate: float
    trees: tuple[PipelineModel, ...]
    losses: tuple[tuple[int, float, float | None], ...]

    @property
    def classes(self) -> int:
        return len(self.prior)

    @property
    def rounds(self) -> int:
        return len(self.losses)

    def best_round(self) -> int:
        """The number of rounds with the least validation loss (training loss without validation rows), the first on a tie."""
        loss = [(train if valid is None else valid, number) for number, train, valid in self.losses]
        return min(loss)[1] + 1 if loss else 0

    def stages(self, rounds: int | None = None) -> list:
        flat = [tree for block in self.trees for tree in block.stages]
        return flat if rounds is None else flat[: rounds * self.classes]


def _after(rows: DataFrame, stages: Sequence, classes: int, rate: float) -> DataFrame:
    """`rows` with the margins after the trees of whole rounds."""
    scored = PipelineModel(list(stages)).transform(rows)
    steps = []
    for k in range(classes):
        outputs = [F.col(tree.getPredictionCol()) for tree in stages[k::classes]]
        steps.append(sum(outputs[1:], outputs[0]) * rate)
    margins = F.zip_with("margins", F.array(*steps), lambda a, x: a + x)
    return scored.select(*[name for name in rows.columns if name != "margins"], margins.alias("margins"))


def margins(model: Boosted, rows: DataFrame, rounds: int | None = None, block: int = 20) -> DataFrame:
    """`rows` (with `features`) and their margins after `rounds` rounds; the plan grows by one projection per `block` rounds."""
    out = rows.withColumn("margins", F.array(*map(F.lit, model.prior)))
    stages = model.stages(rounds)
    size = block * model.classes
    for first in range(0, len(stages), size):
        out = _after(out, stages[first : first + size], model.classes, model.rate)
    return out


def probabilities(model: Boosted, rows: DataFrame, rounds: int | None = None, result: str = "probabilities") -> DataFrame:
    """`rows` with the class probabilities and the most probable class (the first on a tie of 12 digits)."""
    scored = margins(model, rows, rounds).withColumn(result, softmax_of("margins")).drop("margins")
    return scored.withColumn("predicted", argmax_class(F.transform(result, lambda x: F.round(x, 12))))


def _prior(rows: DataFrame, label: str, classes: int) -> tuple[float, ...]:
    """Log shares of the classes among training rows, each counted once more so that none is empty."""
    ones = [F.sum((F.col(label) == k).cast("long")).alias(f"n{k}") for k in range(classes)]
    counts = [n or 0 for n in rows.filter(~F.col("_valid")).agg(*ones).first()]
    total = sum(counts) + classes
    return tuple(rows.sparkSession.range(1).select(*[F.log(F.lit((n + 1) / total)) for n in counts]).first())


def _stored(spark: SparkSession, folder: str, block: int) -> list[tuple[int, float, float | None]] | None:
    try:
        rows = spark.read.schema(LOSS_SCHEMA).parquet(f"{folder}/losses/block={block}").collect()
    except AnalysisException:
        return None
    return sorted((row["round"], row["train_loss"], row["valid_loss"]) for row in rows)


def boost(
    rows: DataFrame, label: str, classes: int, folder: str, rounds: int = 50, valid: Column | None = None, depth: int = 3,
    rate: float = 0.3, block: int = 5, patience: int | None = None, seed: int = 0, parallel: int | None = None,
) -> Boosted:
    """Fit on `rows` (with `features` and `label`, 0 to classes - 1); rows of `valid` are only scored.

    Training stops when the validation loss has not fallen for `patience` rounds. A leaf's value is the mean residual of its
    rows; with a rate up to 1 the training loss cannot rise, as the softmax's curvature is at most 1/2. Called again with the
    same folder, it goes on behind the last stored block; `rounds` may be larger then.
    """
    spark = rows.sparkSession
    flagged = rows.select(F.col(label).cast("int").alias("label"), "features", (F.lit(False) if valid is None else valid).alias("_valid"))
    flagged = flagged.filter("label is not null")
    prior = _prior(flagged, "label", classes)
    start = flagged.withColumn("margins", F.array(*map(F.lit, prior)))
    trees: list[PipelineModel] = []
    losses: list[tuple[int, float, float | None]] = []

    def stale() -> bool:
        curve = [loss for _, _, loss in losses]
        return patience is not None and len(curve) > patience and None not in curve and min(curve[:-patience]) <= min(curve[-patience:])

    # Margins are stored alternately, so a block that is being written never replaces those it reads.
    while (found := _stored(spark, folder, len(trees))) is not None:
        trees.append(PipelineModel.load(f"{folder}/trees/block={len(trees)}"))
        losses += found
    if trees:
        start = spark.read.parquet(f"{folder}/margins/{len(trees) % 2}")

    def fit(number: int, current: DataFrame):
        k = number % classes
        residual = (F.col("label") == k).cast("double") - F.get(softmax_of("margins"), F.lit(k))
        tree = DecisionTreeRegressor(
            featuresCol="features", labelCol="residual", predictionCol=f"tree_{number}", maxDepth=depth, seed=seed, minInstancesPerNode=1
        )
        return tree.fit(current.filter(~F.col("_valid")).select("features", residual.alias("residual")))

    with ThreadPool(parallel or classes) as pool:
        while len(losses) < rounds and not stale():
            done, stages, new = len(losses), [], []
            while len(stages) < block * classes and len(losses) < rounds and not stale():
                current = _after(start, stages, classes, rate) if stages else start
                first = (done + len(new)) * classes
                stages += pool.map(inheritable_thread_target(spark)(lambda k: fit(first + k, current)), range(classes))
                after = _after(start, stages, classes, rate)
                loss = {row["_valid"]: row["loss"] for row in after.groupBy("_valid").agg(log_loss("margins", "label").alias("loss")).collect()}
                new.append((done + len(new), loss.get(False), loss.get(True)))
                losses.append(new[-1])
            number = len(trees) + 1
            _after(start, stages, classes, rate).write.mode("overwrite").parquet(f"{folder}/margins/{number % 2}")
            trees.append(PipelineModel(stages))
            trees[-1].write().overwrite().save(f"{folder}/trees/block={number - 1}")
            spark.createDataFrame(new, LOSS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/losses/block={number - 1}")
            start = spark.read.parquet(f"{folder}/margins/{number % 2}")
    return Boosted(prior, rate, tuple(trees), tuple(losses))


def curve(model: Boosted, spark: SparkSession) -> DataFrame:
    """(round, train_loss, valid_loss)."""
    return spark.createDataFrame(list(model.losses), LOSS_SCHEMA)


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
_LEAF = re.compile(r"^( *)Predict: (\S+)$")


def tree_leaves(tree) -> list[tuple[float, list[tuple[int, str, float]]]]:
    """(value, conditions) of a tree's leaves in their order; a condition is (place in the vector, `<=` or `>`, threshold)."""
    path: list[tuple[int, tuple[int, str, float]]] = []
    out = []
    for line in tree.toDebugString.splitlines()[1:]:
        if split := _SPLIT.match(line):
            depth = len(split[1])
            path = [(at, held) for at, held in path if at < depth]
            path.append((depth, (int(split[3]), split[4], float(split[5]))))
        elif leaf := _LEAF.match(line):
            out.append((float(leaf[2]), [held for at, held in path if at < len(leaf[1])]))
    return out


def leaves(model: Boosted, spark: SparkSession) -> DataFrame:
    """The ensemble as a table: (round, class, leaf, value, conditions), the value times the rate."""
    rows = [
        (number // model.classes, number % model.classes, leaf, value * model.rate, conditions)
        for number, tree in enumerate(model.stages())
        for leaf, (value, conditions) in enumerate(tree_leaves(tree))
    ]
    return spark.createDataFrame(
        rows, "round int, class int, leaf int, value double, conditions array<struct<place: int, sign: string, threshold: double>>"
    )


def margin_sql(leaf_table: DataFrame, kind: int, start: float, slot: str = "get(x, {place})") -> str:
    """The margin of one class as plain SQL over a row's slots, from the exported leaves (bounded by the model, not the rows)."""
    trees: dict[int, list[str]] = {}
    for row in leaf_table.filter(F.col("class") == kind).orderBy("round", "leaf").collect():
        tests = [f"{slot.format(place=c['place'])} {c['sign']} CAST({c['threshold']!r} AS DOUBLE)" for c in row["conditions"]] or ["true"]
        trees.setdefault(row["round"], []).append(f"WHEN {' AND '.join(tests)} THEN CAST({row['value']!r} AS DOUBLE)")
    return " + ".join([f"CAST({start!r} AS DOUBLE)", *[f"CASE {' '.join(cases)} END" for cases in trees.values()]])
