"""Arithmetic on score arrays, one row at a time and without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda body is evaluated per element, and the optimizer may move the
    expression behind a column into it. So a row-level value used in a lambda
    must be bound outside.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Softmax with the maximum subtracted first."""
    shifted = bind(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return bind(
        shifted,
        lambda powers: bind(
            array_sum(powers), lambda total: F.transform(powers, lambda x: x / total)
        ),
    )


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def argmax(scores: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def binarize(scores: Column, threshold: float = 0.5) -> Column:
    """1 where the score is strictly above the threshold, else 0."""
    return F.transform(scores, lambda x: (x > F.lit(float(threshold))).cast("int"))


def multi_hot(label_ids: Column, width: Column) -> Column:
    """Fixed-length float vector with ones at ``label_ids``; ids outside are ignored."""
    positions = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return bind(
        label_ids,
        lambda ids: F.transform(positions, lambda i: F.array_contains(ids, i).cast("float")),
    )


def cross_entropy(logits: Column, truth: Column) -> Column:
    """Softmax cross-entropy of one row against its class id."""
    log_total = bind(
        F.array_max(logits),
        lambda top: top + F.log(array_sum(F.transform(logits, lambda x: F.exp(x - top)))),
    )
    return log_total - F.get(logits, truth.cast("int"))


def binary_cross_entropy(logits: Column, truth: Column) -> Column:
    """Binary cross-entropy of one row, summed over its labels."""
    losses = F.zip_with(
        logits,
        truth,
        lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))),
    )
    return array_sum(losses)
