"""Comparison of two splits: classes, vocabulary, lengths, metrics.

The functions whose names end in ``_of`` take one frame with a column ``side`` and read it
once: each aggregation counts both sides. The others put two frames together for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from . import profile as P


SIDE = "side"


def tagged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames with the same columns as one, ``side`` telling them apart."""
    return a.withColumn(SIDE, F.lit("a")).unionByName(b.withColumn(SIDE, F.lit("b")))


def _both(of: Callable[[Column], Column]) -> list[Column]:
    """An aggregate for the rows of either side, in one aggregation."""
    return [of(F.col(SIDE) == side).alias(f"n_{side}") for side in ("a", "b")]


def _summed(key: str, counts: DataFrame) -> DataFrame:
    """``key, n_a, n_b`` of counts ``key, n, side``."""
    total = _both(lambda here: F.sum(F.when(here, F.col("n")).otherwise(F.lit(0))))
    return counts.groupBy(key).agg(*total)


def _side_by_side(a: DataFrame, b: DataFrame, key: str, count: str) -> DataFrame:
    """``key, n_a, n_b`` of two count tables: one shuffle instead of a full outer join."""
    named = [side.select(F.col(key), F.col(count).alias("n")) for side in (a, b)]
    return _summed(key, tagged(*named))


def _status() -> Column:
    return (
        F.when(F.col("n_b") == 0, F.lit("missing"))
        .when(F.col("n_a") == 0, F.lit("new"))
        .otherwise(F.lit("shared"))
    )


def label_drift(a: DataFrame, b: DataFrame, label_col: str = "label") -> DataFrame:
    """:func:`label_drift_of` for two frames."""
    return label_drift_of(tagged(*[df.select(label_col) for df in (a, b)]), label_col)


def label_counts(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """``label, n_a, n_b``; null labels are not a class."""
    known = rows.filter(F.col(label_col).isNotNull())
    return known.groupBy(F.col(label_col).alias("label")).agg(*_both(F.count_if))


def label_drift_of(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """Counts and shares of every class in both sides of one frame with a ``side``, a or b.

    ``status`` says whether side b misses the class, brings it in, or shares it. The frame
    is read once, at once; what is left is a row per class.
    """
    counts = cut_lineage(label_counts(rows, label_col))
    totals = counts.agg(F.sum("n_a").alias("all_a"), F.sum("n_b").alias("all_b"))
    share_a, share_b = (
        F.try_divide(F.col(f"n_{side}"), F.col(f"all_{side}")).cast("double") for side in "ab"
    )
    # one row of totals
    return counts.join(F.broadcast(totals)).select(
        "label",
        "n_a",
        "n_b",
        share_a.alias("share_a"),
        share_b.alias("share_b"),
        (share_b - share_a).alias("share_delta"),
        _status().alias("status"),
    )


def term_sides(
    rows: DataFrame,
    text_col: str = "text",
    words: Iterable[str] = T.ENGLISH_STOPWORDS,
) -> DataFrame:
    """``term, n_a, n_b`` of cleaned texts with a ``side``, stopwords left out; one scan."""
    exploded = rows.select(SIDE, F.explode(T.raw_tokens(F.col(text_col))).alias("term"))
    kept = T.is_alnum(F.col("term")) & ~T.is_stopword(F.col("term"), words)
    return exploded.filter(kept).groupBy("term").agg(*_both(F.count_if))


def vocab_drift(terms_a: DataFrame, terms_b: DataFrame) -> DataFrame:
    """:func:`vocab_drift_of` for two term tables."""
    return vocab_drift_of(_side_by_side(terms_a, terms_b, "term", "n"))


def vocab_drift_of(sides: DataFrame) -> DataFrame:
    """Vocabulary sizes and shared, missing and new terms of ``term, n_a, n_b``."""
    in_a, in_b = F.col("n_a") > 0, F.col("n_b") > 0
    return sides.agg(
        F.count_if(in_a).alias("vocab_a"),
        F.count_if(in_b).alias("vocab_b"),
        F.count_if(in_a & in_b).alias("n_shared"),
        F.count_if(in_a & ~in_b).alias("n_only_a"),
        F.count_if(~in_a & in_b).alias("n_only_b"),
    )


def term_rank_change(terms_a: DataFrame, terms_b: DataFrame, n: int = 25) -> DataFrame:
    """:func:`term_rank_change_of` for two term tables."""
    return term_rank_change_of(_side_by_side(terms_a, terms_b, "term", "n"), n)


def term_rank_change_of(sides: DataFrame, n: int = 25) -> DataFrame:
    """Rank in both sides of every term among the top ``n`` of either.

    Takes ``term, n_a, n_b``, which is stored first, as it is read for the leading terms
    and for the ranks. The rank is one more than the number of terms with a larger count; a
    term that a side lacks has no rank there.
    """
    sides = cut_lineage(sides)
    top_a = sides.filter("n_a > 0").orderBy(F.desc("n_a"), "term").limit(n)
    top_b = sides.filter("n_b > 0").orderBy(F.desc("n_b"), "term").limit(n)
    # at most 2 n rows from here on
    chosen = top_a.union(top_b).distinct()
    for side in ("a", "b"):
        ranks = P.frequency_ranks(sides.filter(f"n_{side} > 0"), f"n_{side}").select(
            F.col("frequency").alias(f"n_{side}"), F.col("rank_from").alias(f"rank_{side}")
        )
        chosen = chosen.join(ranks, f"n_{side}", "left")
    return chosen.select(
        "term",
        "n_a",
        "n_b",
        "rank_a",
        "rank_b",
        (F.col("rank_a") - F.col("rank_b")).alias("rank_gain"),
    )


def length_drift(lengths_a: DataFrame, lengths_b: DataFrame) -> DataFrame:
    """:func:`length_drift_of` for two length tables."""
    named = [lengths.select("measure", "length", "n") for lengths in (lengths_a, lengths_b)]
    return length_drift_of(tagged(*named))


def length_drift_of(lengths: DataFrame) -> DataFrame:
    """``measure, statistic, value_a, value_b, delta`` of ``measure, length, n, side``."""
    counted = lengths.groupBy(SIDE, "measure", "length").agg(F.sum("n").alias("n"))
    described = P._describe(counted, [SIDE, "measure"])
    names = [c for c in described.columns if c not in (SIDE, "measure")]
    doubles = described.select(SIDE, "measure", *[F.col(c).cast("double").alias(c) for c in names])
    long = doubles.unpivot([SIDE, "measure"], names, "statistic", "value")
    return _sides_to_columns(long, ["measure", "statistic"], SIDE, "a", "b")


def imbalance_drift(a: DataFrame, b: DataFrame, label_col: str = "label") -> DataFrame:
    """:func:`imbalance_drift_of` for two frames."""
    return imbalance_drift_of(tagged(*[df.select(label_col) for df in (a, b)]), label_col)


def imbalance_drift_of(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """``statistic, value_a, value_b, delta`` for the class count and the imbalance ratio."""
    figures = []
    for side in ("a", "b"):
        n = F.when(F.col(f"n_{side}") > 0, F.col(f"n_{side}"))
        figures += [
            F.count(n).cast("double").alias(f"count_{side}"),
            F.try_divide(F.max(n), F.min(n)).cast("double").alias(f"ratio_{side}"),
        ]
    one = label_counts(rows, label_col).agg(*figures)
    values = [("num_classes", "count"), ("imbalance_ratio", "ratio")]
    items = [
        F.struct(
            F.lit(name).alias("statistic"),
            F.col(f"{figure}_a").alias("value_a"),
            F.col(f"{figure}_b").alias("value_b"),
        )
        for name, figure in values
    ]
    return one.select(F.inline(F.array(*items))).withColumn(
        "delta", F.col("value_b") - F.col("value_a")
    )


def _sides_to_columns(
    df: DataFrame, keys: list[str], side: str, a: str, b: str
) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(
            F.max(F.when(F.col(side) == a, F.col("value"))).alias("value_a"),
            F.max(F.when(F.col(side) == b, F.col("value"))).alias("value_b"),
        )
        .withColumn("delta", F.col("value_b") - F.col("value_a"))
    )


def compare_metrics(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """``metric, value_a, value_b, delta`` of two splits of a long metric table.

    The table may hold several runs; each is compared with itself.
    """
    keys = (["run_id"] if "run_id" in metrics.columns else []) + ["metric"]
    chosen = metrics.filter(F.col("split").isin(a, b))
    return _sides_to_columns(chosen, keys, "split", a, b)
