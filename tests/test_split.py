import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from utterfold.operators import split as S


def ids(df):
    return {r["id"] for r in df.collect()}


@pytest.mark.parametrize(("n", "ratio", "expected"), [(4634, 0.2, 927), (10, 0.25, 3), (1, 0.5, 1), (3, 0.99, 3)])
def test_sizes(spark, n, ratio, expected):
    train, validation = S.split_exact(spark.range(n), ratio, "id")
    assert (len(ids(train)), len(ids(validation))) == (n - expected, expected)
    assert ids(train) | ids(validation) == set(range(n))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 400), st.floats(0.01, 0.99), st.integers(0, 99))
def test_same_as_sorting_all_keys(spark, n, ratio, seed):
    _, validation = S.split_exact(spark.range(n), ratio, ["id"], seed)
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{seed}-{i}".encode()).hexdigest())
    assert ids(validation) == set(order[: math.ceil(ratio * n)])


def test_refinement_when_cells_are_full(spark, monkeypatch):
    monkeypatch.setattr(S, "_STEP", 1)
    _, validation = S.split_exact(spark.range(5000), 0.37, "id")
    order = sorted(range(5000), key=lambda i: hashlib.md5(f"42-{i}".encode()).hexdigest())
    assert ids(validation) == set(order[:1850])


@pytest.mark.parametrize("ratio", [0, -0.1, 1, 1.5])
def test_ratio_rules(spark, caplog, ratio):
    df = spark.range(5)
    train, validation = S.split_exact(df, ratio, "id")
    assert train is df and validation is None
    assert bool(caplog.records) == (ratio != 0)


def test_equal_keys_cannot_be_cut(spark):
    same = spark.range(10).withColumn("k", F.lit("x"))
    with pytest.raises(ValueError, match="identify"):
        S.split_exact(same, 0.3, "k")


def test_empty_input(spark):
    train, validation = S.split_exact(spark.range(0), 0.2, "id")
    assert train.count() == 0 and validation.count() == 0
