"""Make this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark, once per application.

    Not needed, and not done, where their Python path or working folder has it anyway.
    """
    application = spark.sparkContext.applicationId
    named = [Path(x).resolve() for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x]
    if application in _shipped or _ROOT in named or Path.cwd() == _ROOT:
        return
    _shipped.add(application)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="wattloom-code-")) / "wattloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
