"""Each query against its SQL on the smallest tables, and plans that scale."""

import os

import oracle
import pytest

from chronolith.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.differences(spark, con, QUERIES[name], ORACLES[name], DATA) == []


def test_all_queries_have_their_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"q_citations", "q_citations_sql"}))  # nested templates are parsed in Arrow batches
def test_plans_stay_in_the_jvm_and_cross_nothing(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
