from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wattloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    warehouse = tmp_path_factory.mktemp("warehouse")
    SparkSession.builder.config("spark.sql.warehouse.dir", str(warehouse)).config(
        "spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))
    ).config("spark.sql.shuffle.partitions", "4").master("local[4]").config("spark.driver.memory", "6g").config(
        "spark.ui.enabled", "false"
    ).getOrCreate()
    session = local_session(4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def hours_of(spark):
    """Hourly frame from (building, timestamp text, energy) tuples."""

    def build(rows, state=1):
        frame = spark.createDataFrame([(b, state, t, e) for b, t, e in rows], "bldg_id long, state int, t string, energy_consumption double")
        return frame.selectExpr("bldg_id", "state", "cast(t as timestamp) as timestamp", "energy_consumption")

    return build
