"""Cleanup of chosen columns and row filters."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("utterfold")


def apply_cleanup(
    df: DataFrame,
    fn: Callable[[Column], Column] | None,
    names: Sequence[str] | None = None,
    indices: Sequence[int] | None = None,
) -> DataFrame:
    """Apply ``fn`` to the chosen columns, then drop incomplete rows.

    Names win over indices; unknown ones are skipped with a warning. When a
    function is given but no valid column remains, the frame comes back as it
    was, incomplete rows included. Without a function only the drop happens.
    ``fn`` maps Column to Column; wrap a Python callable with
    :func:`utterfold.operators.batches.python_cleanup`.
    """
    if fn is None:
        return drop_incomplete(df)
    if names:
        unknown = [name for name in names if name not in df.columns]
        chosen = [name for name in names if name in df.columns]
    else:
        indices = indices or []
        unknown = [i for i in indices if not 0 <= i < len(df.columns)]
        chosen = [df.columns[i] for i in indices if 0 <= i < len(df.columns)]
    if unknown:
        log.warning("cleanup skips unknown columns: %s", unknown)
    if not chosen:
        log.warning("cleanup function given, but no valid column to apply it to")
        return df
    return drop_incomplete(df.withColumns({name: fn(F.col(name)) for name in chosen}))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) in any column.

    One condition per column instead of ``na.drop``: the optimizer drops those
    on columns that cannot be null, such as cleaned text, and pushes the others
    to the scan. Otherwise it would clean every text twice, once to test it.
    """
    present = []
    for column in df.schema.fields:
        known = F.col(f"`{column.name}`").isNotNull()
        if isinstance(column.dataType, (T.FloatType, T.DoubleType)):
            known = known & ~F.isnan(f"`{column.name}`")
        present.append(known)
    return df.filter(reduce(and_, present)) if present else df


def filter_combined(df: DataFrame, label_col: str = "label", delim: str = "+") -> DataFrame:
    """Rows whose label has several parts; a null label has none."""
    return df.filter(F.contains(F.col(label_col), F.lit(delim)))


def drop_unlabelled(df: DataFrame, encoded_col: str = "labels") -> DataFrame:
    """Drop rows whose encoded label is null."""
    return df.na.drop(subset=[encoded_col])
