"""Random train and validation split with exact sizes."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("utterfold")

_STEP = 4  # hex digits per refinement: at most 16 ** 4 counters reach the driver


def split_key(keys: Sequence[str], seed: int = 42) -> Column:
    """Position of a row in the random order: the md5 of seed and key.

    Several keys are hashed as JSON, which tells ("a-b", "c") from ("a", "b-c") and a
    null from an empty key.
    """
    if len(keys) == 1:
        key = F.col(f"`{keys[0]}`").cast("string")
    else:
        named = [F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
        key = F.to_json(F.struct(*named), {"ignoreNullFields": "false"})
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key))


def split_exact(
    df: DataFrame, ratio: float, keys: Sequence[str] | str, seed: int = 42
) -> tuple[DataFrame, DataFrame | None]:
    """``(train, validation)`` with ``ceil(ratio * n)`` validation rows.

    Rows are ordered by :func:`split_key` and cut once, so the same keys always
    land on the same side. ``keys`` must identify a row. Ratio 0 keeps all rows
    in train; a ratio outside [0, 1) does so with a warning.
    """
    if ratio == 0:
        return df, None
    if not 0 < ratio < 1:
        log.warning("split ratio %s is outside [0, 1): all rows stay in train", ratio)
        return df, None
    chosen = in_validation(df, ratio, keys, seed)
    return df.filter(~chosen), df.filter(chosen)


def in_validation(
    df: DataFrame, ratio: float, keys: Sequence[str] | str, seed: int = 42
) -> Column:
    """True for the rows that :func:`split_exact` puts into validation; 0 < ratio < 1.

    As a column of one frame both sides stay in one scan.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    key = split_key(keys, seed)
    cut = _find_cut(df.select(key.alias("key")), ratio)
    if cut is None:
        return F.lit(False)
    return F.substring(key, 1, len(cut)) <= F.lit(cut)


def _find_cut(keyed: DataFrame, ratio: float) -> str | None:
    """Shortest key prefix that ends exactly at the wanted row.

    Instead of sorting all keys, count them by their leading digits and look
    closer only into the cell the cut falls in. Each pass reads the key columns
    alone and brings back at most 65536 counters.
    """
    parent = ""
    wanted = None
    for length in range(_STEP, 32 + _STEP, _STEP):
        inside = keyed.filter(F.col("key").startswith(parent)) if parent else keyed
        cells = (
            inside.groupBy(F.substring("key", 1, length).alias("cell"))
            .agg(F.count("*").alias("n"))
            .collect()
        )
        if wanted is None:
            wanted = math.ceil(ratio * sum(row["n"] for row in cells))
            if wanted == 0:
                return None
        for cell, n in sorted((row["cell"], row["n"]) for row in cells):
            if wanted <= n:
                parent = cell
                break
            wanted -= n
        if wanted == n:
            return parent
    raise ValueError("the split keys do not identify a row: equal keys straddle the cut")
