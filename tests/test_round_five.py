"""Blocks of counts, as the passes of a joint fit read them."""

import numpy as np
from pyspark.ml.linalg import Vectors

from utterfold.operators import joint_fit as J


def counted(spark, n=600, d=40, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        held = np.sort(rng.choice(d, rng.integers(0, 9), replace=False))
        found = rng.integers(1, 4, len(held))
        labels = [float((held < 9).sum() + rng.normal() > 1), float(rng.random() < 0.3)]
        rows.append((dict(zip(held.tolist(), map(float, found), strict=True)), labels))
    return rows


def framed(spark, rows, d, scale):
    scaled = [
        (Vectors.sparse(d, {j: x * scale[j] for j, x in row.items()}), labels)
        for row, labels in rows
    ]
    return spark.createDataFrame(scaled, ["features", "labels"]).repartition(3)


def test_blocks_of_counts_are_small_and_dealt_evenly(spark):
    d = 40
    rows = counted(spark)
    stored = J._stored_blocks(framed(spark, rows, d, np.ones(d)))
    n = sum(len(row) for row, _ in rows)
    blocks = [J._Block.read(*row) for row in stored.collect()]
    assert sum(len(block.values) for block in blocks) == n
    # a byte for a count and one for its place among the bins of the block
    assert sum(len(row["place"]) + len(row["val"]) for row in stored.collect()) == 2 * n
    sums = np.zeros(d)
    for block in blocks:
        np.add.at(sums, block.bins, block.values)
    wanted = np.zeros(d)
    for row, _ in rows:
        for j, x in row.items():
            wanted[j] += x
    assert sums.tolist() == wanted.tolist()
    many = J._stored_blocks(framed(spark, rows, d, np.ones(d)).repartition(40))
    assert len(many.inputFiles()) <= spark.sparkContext.defaultParallelism


def test_values_and_bins_of_any_size_survive_storing(spark):
    rows = [
        (Vectors.sparse(1 << 24, {0: -1.0, 70_000: 0.5, (1 << 24) - 1: 300.0}), [1.0, 0.0]),
        (Vectors.sparse(1 << 24, {}), [0.0, 0.0]),
        (Vectors.sparse(1 << 24, {5: 0.0, 6: 255.0}), [1.0, 1.0]),
    ]
    frame = spark.createDataFrame(rows, ["features", "labels"]).coalesce(1)
    (row,) = J._stored_blocks(frame).collect()
    block = J._Block.read(*row)
    assert block.bins.tolist() == [0, 70_000, (1 << 24) - 1, 6]
    assert block.values.tolist() == [-1.0, 0.5, 300.0, 255.0]
    assert block.row_of.tolist() == [0, 0, 0, 2]
    assert (block.label_row.tolist(), block.label_idx.tolist()) == ([0, 2, 2], [0, 0, 1])
    dense = [(Vectors.dense([0.0, 2.0, 0.0, 3.0]), [0.0]), (Vectors.dense([1.0, 0, 0, 0]), [1.0])]
    (row,) = J._stored_blocks(spark.createDataFrame(dense, ["features", "labels"]).coalesce(1)).collect()
    assert J._Block.read(*row).bins.tolist() == [1, 3, 0]


def test_counts_with_a_scale_fit_as_scaled_features_do(spark):
    d = 40
    rows = counted(spark)
    scale = np.random.default_rng(1).uniform(0.2, 5, d)
    scale[3] = 0.0
    plain = J.fit_joint(framed(spark, rows, d, scale), 2, d, 1e-2, 300)
    counts = J.fit_joint(framed(spark, rows, d, np.ones(d)), 2, d, 1e-2, 300, scale=scale)
    assert np.abs(plain[0] - counts[0]).max() < 1e-5 and np.abs(plain[1] - counts[1]).max() < 1e-5
    assert not counts[0][:, 3].any() and counts[0][:, 4].any()
