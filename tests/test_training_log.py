import random

import pytest
from pyspark.sql import functions as F

from utterfold.operators import training_log as L
from utterfold.operators.running import running_before

SCHEMA = "run_id string, epoch int, metric string, value double"


def log(spark, values, run="r", metric="f1"):
    return spark.createDataFrame([(run, i + 1, metric, v) for i, v in enumerate(values)], SCHEMA)


def test_published_run(spark):
    values = [i / 32 for i in range(19)] + [0.25, 18 / 32, 0.5, 0.9]
    assert tuple(L.select_best(log(spark, values[:22]), "f1").first()) == ("r", 19, values[18])
    assert tuple(L.early_stop_epoch(log(spark, values), "f1").first()) == ("r", 22)
    assert L.early_stop_epoch(log(spark, values), "f1", patience=4).count() == 0


def test_lower_is_better_and_nan_is_no_result(spark):
    df = log(spark, [3.0, float("nan"), 1.0, 1.0, 2.0, 1.5], metric="loss")
    assert tuple(L.select_best(df, "loss", greater_is_better=False).first()) == ("r", 3, 1.0)
    assert tuple(L.early_stop_epoch(df, "loss", 3, False).first()) == ("r", 6)
    assert L.select_best(df, "f1").count() == 0
    with pytest.raises(ValueError):
        L.early_stop_epoch(df, "loss", 0)


def stop_of(values, patience):
    best, failed = None, 0
    for epoch, value in enumerate(values, 1):
        if best is None or value > best:
            best, failed = value, 0
        else:
            failed += 1
            if failed == patience:
                return epoch
    return None


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_do_not_change_the_answer(spark, monkeypatch, block):
    monkeypatch.setattr(L, "_BLOCK", block)
    rng = random.Random(2)
    runs = {f"r{i}": [rng.randrange(6) / 1.0 for _ in range(rng.randrange(1, 15))] for i in range(25)}
    rows = [(r, i + 1, "m", v) for r, vs in runs.items() for i, v in enumerate(vs)]
    got = {
        r["run_id"]: r["stop_epoch"]
        for r in L.early_stop_epoch(spark.createDataFrame(rows, SCHEMA), "m", 2).collect()
    }
    assert got == {r: s for r, vs in runs.items() if (s := stop_of(vs, 2))}


@pytest.mark.parametrize("block", ["b", None])
def test_running_values_of_one_big_group(spark, block):
    df = spark.range(1000).select(
        F.lit("k").alias("k"), "id", F.floor(F.col("id") / 64).alias("b"), (F.col("id") % 7).alias("v")
    )
    got = running_before(df, ["k"], block, [F.asc("id")], {"s": "v"}, {"m": "v"}).orderBy("id").collect()
    total, top = 0, None
    for row in got:
        assert (row["s"], row["m"]) == (total, top)
        total += row["v"]
        top = row["v"] if top is None else max(top, row["v"])
