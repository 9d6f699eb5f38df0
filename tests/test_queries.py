"""Each query with SQL must give its rows; the rest must run."""

import pytest
from tests.conftest import SF, same

from brindle.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    same(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if "status" in rows[0].asDict():
        assert {r["status"] for r in rows} == {"ok"}
