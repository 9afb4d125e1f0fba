"""User code on batches of rows, through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def python_cleanup(fn: Callable[[str | None], str]) -> Callable[[Column], Column]:
    """Wrap a Python text function for ``apply_cleanup``.

    The slow path: prefer a Column function where Spark has the parts.
    """

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: fn(None if text is None else text))

    return lambda col: run(col.cast("string"))


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    batch_size: int | None = None,
) -> DataFrame:
    """Apply ``fn`` to batches of rows; it may change columns and row count.

    Batches come as Spark cuts them, or in slices of ``batch_size``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in slices(frame, batch_size):
                yield fn(part)

    return df.mapInPandas(run, schema)


def slices(frame: pd.DataFrame, size: int | None) -> Iterator[pd.DataFrame]:
    if not size:
        yield frame
        return
    for start in range(0, len(frame), size):
        yield frame.iloc[start : start + size]
