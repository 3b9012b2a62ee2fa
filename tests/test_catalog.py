"""Every catalog query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tools.check import compare, connect
from wattloom import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return connect(SF)


def test_every_query_is_checked_or_trains_a_model():
    unchecked = set(catalog.queries()) - set(SQL)
    assert unchecked == {
        "train_score_binary", "boosting_curve", "gain_importance", "permutation_importance",
        "train_score_multi", "mlp_score", "score_submission",
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    query = catalog.queries()[name](spark, SF)
    plan = query._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
    got = query.toPandas()
    spark.catalog.clearCache()
    assert compare(got, con.execute(SQL[name]).df()) == ""
