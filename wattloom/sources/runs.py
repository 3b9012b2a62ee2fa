"""A layer as immutable runs under a manifest: arrivals append, merges replace runs, readers see whole commits only.

`<folder>/runs/<name>` holds the rows of a run, `<folder>/manifest/version=<n>` the list of runs of a version, one small file
that appears in one step when its job commits. Rows written before a crash belong to no manifest and are written again under
the same name; an arrival that is in the manifest already is not written again. Old versions stay readable.

Runs have levels. An arrival is a run of level 0; `fanout` runs of a level become one of the next, so a row is written
anew once per level, however many arrivals there are, and a reader opens at most `fanout` - 1 runs per level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, level int, part int, arrivals array<string>"
#: Level-0 and merged runs hold rows of all parts.
EVERY_PART = -1


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list]:
    """(version, runs) of the newest version, or of the one asked for; (0, []) before the first commit."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{folder}/manifest")
        if version is not None:
            rows = rows.filter(F.col("version") == version)
        newest = rows.agg(F.max("version")).first()[0]
    except AnalysisException:
        newest = None
    if newest is None:
        return 0, []
    # One row per run: bounded by fanout x levels, or by the number of parts.
    runs = rows.filter((F.col("version") == newest) & F.col("name").isNotNull()).drop("version")
    return newest, runs.orderBy("level", "name", "part").collect()


def commit(spark: SparkSession, folder: str, before: int, runs: Sequence[tuple]) -> None:
    """The next version. Fails if another writer has committed since `before` was read."""
    rows = list(runs) or [(None, 0, EVERY_PART, [])]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest/version={before + 1}")


def append(df: DataFrame, folder: str, arrival: str, columns: Sequence[str] = ()) -> bool:
    """Add an arrival as a run of level 0; False, and nothing written, if a committed run holds it already."""
    spark = df.sparkSession
    version, runs = manifest(spark, folder)
    if any(arrival in run["arrivals"] for run in runs):
        return False
    _write(df, f"{folder}/runs/{arrival}", columns)
    commit(spark, folder, version, [*map(tuple, runs), (arrival, 0, EVERY_PART, [arrival])])
    return True


def _write(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    writer = (df.hint("rebalance", *columns) if columns else df.hint("rebalance")).write.mode("overwrite")
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def merge(spark: SparkSession, folder: str, fanout: int = 8, columns: Sequence[str] = ()) -> int:
    """Merge every level that has `fanout` runs into one run of the next level, lowest level first; the number of merges.

    A merged run is named after its arrivals' level and version, written, then committed in place of its parts.
    """
    merges = 0
    while True:
        version, runs = manifest(spark, folder)
        levels = sorted({run["level"] for run in runs})
        full = next((level for level in levels if sum(run["level"] == level for run in runs) >= fanout), None)
        if full is None:
            return merges
        parts = [run for run in runs if run["level"] == full]
        name = f"merged-{full + 1}-{version + 1}"
        _write(_rows(spark, folder, parts), f"{folder}/runs/{name}", columns)
        held = [arrival for run in parts for arrival in run["arrivals"]]
        commit(spark, folder, version, [*[tuple(run) for run in runs if run["level"] != full], (name, full + 1, EVERY_PART, held)])
        merges += 1


def _rows(spark: SparkSession, folder: str, runs: Sequence) -> DataFrame:
    """The rows of some runs, by name: columns that only some have are null in the others."""
    out = None
    for run in runs:
        one = spark.read.parquet(f"{folder}/runs/{run['name']}")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """All rows of the newest version, or of an earlier one; the manifest names the runs, no folder is listed for them."""
    _, runs = manifest(spark, folder, version)
    if not runs:
        raise ValueError(f"no run in {folder}")
    return _rows(spark, folder, runs)
