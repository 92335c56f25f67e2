"""Every registered query against its SQL on the whole tables."""

import pytest

from __spark_entry__ import entry
from sealrank.plans.oracle import SQL
from sealrank.plans.queries import QUERIES
from tests.conftest import SF_DIR
from tests.oracle_check import connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    answer = QUERIES[name](spark, SF_DIR)
    plan = answer._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = answer.toPandas()
    assert len(got) > 0
    assert difference(got, con.execute(SQL[name]).df()) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 501
    average = [r for r in rows if r["query_id"] == "AVERAGE"]
    assert len(average) == 1 and average[0]["rels"] is None
    others = [r["ndcg"] for r in rows if r["query_id"] != "AVERAGE"]
    assert average[0]["ndcg"] == pytest.approx(sum(others) / len(others))
