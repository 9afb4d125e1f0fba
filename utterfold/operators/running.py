"""Running values over groups that may be too big for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    block: str | None,
    order: Sequence[Column],
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
) -> DataFrame:
    """Add running sums and maxima over the strictly earlier rows of each group.

    ``sums`` and ``maxima`` map a new column to its source. ``block`` must rise
    along the order within a group: each block is summed up first, the small
    block table gets the totals before each block, and the rows then only need a
    window within their own block. No task ever holds a whole group.
    Without a ``block`` every group must fit one task and is walked directly.
    Group keys must not be null. A sum before the first row is 0, a maximum null.
    """
    sums, maxima = sums or {}, maxima or {}
    if block is None:
        before = (
            Window.partitionBy(*keys)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return df.select(
            *df.columns,
            *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(o) for o, s in sums.items()],
            *[F.max(s).over(before).alias(o) for o, s in maxima.items()],
        )
    block_keys = [*keys, block]
    totals = df.groupBy(*block_keys).agg(
        *[F.sum(src).alias(f"_own_{out}") for out, src in sums.items()],
        *[F.max(src).alias(f"_own_{out}") for out, src in maxima.items()],
    )
    earlier_blocks = (
        Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in block_keys],
        *[F.sum(f"_own_{out}").over(earlier_blocks).alias(f"_off_{out}") for out in sums],
        *[F.max(f"_own_{out}").over(earlier_blocks).alias(f"_off_{out}") for out in maxima],
    )
    same = [F.col(k) == F.col(f"_k_{k}") for k in block_keys]
    # every row has its block; a left join adds no filter that would split the shuffles
    joined = df.join(offsets, same, "left")
    earlier_rows = (
        Window.partitionBy(*block_keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    added = {
        out: F.coalesce(F.col(f"_off_{out}"), F.lit(0))
        + F.coalesce(F.sum(src).over(earlier_rows), F.lit(0))
        for out, src in sums.items()
    }
    # greatest skips nulls, so either part may be missing
    added |= {
        out: F.greatest(F.col(f"_off_{out}"), F.max(src).over(earlier_rows))
        for out, src in maxima.items()
    }
    return joined.select(*df.columns, *[value.alias(out) for out, value in added.items()])
