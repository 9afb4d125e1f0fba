"""Ranked predictions as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bind


def decode_label(label_id: Column, names: Column) -> Column:
    """Name of a label id, ``UNKNOWN_<id>`` when the map lacks it.

    ``names`` is the array of names by id, see ``operators.labels.label_names``.
    """
    position = label_id.cast("int")
    known = F.when(position >= 0, F.get(names, position))
    return F.coalesce(known, F.concat(F.lit("UNKNOWN_"), position.cast("string")))


def ranked(scores: Column, names: Column) -> Column:
    """All (label, confidence) pairs, best first; equal scores keep id order."""
    keyed = bind(
        names,
        lambda known: F.transform(
            scores,
            lambda score, i: F.struct(
                (-score).alias("order"),
                i.alias("label_id"),
                decode_label(i, known).alias("label"),
                score.alias("confidence"),
            ),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda item: F.struct(item["label"].alias("label"), item["confidence"].alias("confidence")),
    )


def top_k(ranking: Column, k: int = 3, digits: int = 4) -> Column:
    """The first ``k`` pairs with the confidence rounded."""
    return F.transform(
        F.slice(ranking, 1, k),
        lambda item: F.struct(
            item["label"].alias("label"),
            F.round(item["confidence"], digits).alias("confidence"),
        ),
    )


def above(scores: Column, names: Column, threshold: float = 0.5) -> Column:
    """(label, confidence) pairs strictly above the threshold, in id order."""
    pairs = bind(
        names,
        lambda known: F.transform(
            scores,
            lambda score, i: F.struct(
                decode_label(i, known).alias("label"), score.alias("confidence")
            ),
        ),
    )
    return F.filter(pairs, lambda item: item["confidence"] > F.lit(float(threshold)))
