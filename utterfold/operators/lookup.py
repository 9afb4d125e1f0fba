"""Joins with dictionaries of any size, and with keys of which one may fill much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is hot, so fewer than so many keys are.
SHARES = 1000
#: A dictionary measured to be no larger is broadcast.
BROADCAST_BYTES = 32 << 20


def free_name(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def count_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def hot_keys(counts: DataFrame, total: int, keys: list[str], shares: int = SHARES) -> DataFrame:
    """``*keys, copies`` of the keys with more than ``1 / shares`` of all ``total`` rows.

    ``counts`` has ``*keys, n`` and may leave out rare keys. ``copies`` says into how many
    parts of an even size a key's rows are to be dealt. Fewer than ``shares`` keys can be
    hot, whatever the input, so the table may be broadcast.
    """
    copies = F.ceil(F.col("n") * shares / F.lit(max(total, 1))).cast("int")
    return counts.where(F.col("n") * shares > total).select(*keys, copies.alias("copies"))


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    by: Column,
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows``, whose keys may be hot, with ``lookup`` on ``keys``.

    The rows of a hot key are dealt by ``by``, and its rows of ``lookup`` are repeated
    for each part. ``how`` is any join that keeps no unmatched row of ``lookup``. Null
    keys match nothing. Without ``hot`` (from ``hot_keys``) the rows are counted first, so
    pass a stored table.
    """
    if hot is None:
        hot = hot_keys(count_keys(rows, keys), rows.count(), keys)
    hot = F.broadcast(hot)
    part = free_name("_part", rows)
    dealt = F.coalesce(F.pmod(F.xxhash64(by), F.col("copies")).cast("int"), F.lit(0))
    left = rows.join(hot, keys, "left").withColumn(part, dealt).drop("copies")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)) - 1)
    right = lookup.join(hot, keys, "left").withColumn(part, F.explode(parts)).drop("copies")
    return left.join(right, [*keys, part], how).drop(part)


def dictionary_join(
    rows: DataFrame,
    dictionary: DataFrame,
    column: str,
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` with ``dictionary``, whose first column is its string key, on ``column``.

    The dictionary is measured first. Up to ``limit`` bytes it is broadcast and the rows
    stay where they are; beyond that both are shuffled, the rows of hot keys in parts.
    ``column`` is kept as it is and the key of the dictionary goes.
    """
    key, *values = dictionary.columns
    fixed = 16 * (1 + len(values))
    size = dictionary.agg(F.sum(F.octet_length(F.col(f"`{key}`")) + fixed)).first()[0] or 0
    found = free_name("_key", rows)
    named = dictionary.withColumnRenamed(key, found)
    if size <= limit:
        same = F.col(f"`{column}`").cast("string") == F.col(found)
        return rows.join(F.broadcast(named), same, how).drop(found)
    keyed = rows.withColumn(found, F.col(f"`{column}`").cast("string"))
    by = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != column])
    return salted_join(keyed, named, [found], by, how).select(
        *[F.col(f"`{c}`") for c in rows.columns], *values
    )
