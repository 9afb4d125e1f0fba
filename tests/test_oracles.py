"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import duck, duck_side, spark_side

from utterfold.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    kinds, rows = spark_side(df)
    assert rows
    plan = df._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert costly not in plan
    if name in ORACLES:
        expected_kinds, expected = duck_side(connection, ORACLES[name])
        assert set(kinds) == set(expected_kinds)
        assert rows == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_and_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["rank", "term", "n"]
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()
