"""Shards that all match the mixture of sources.

Rows of each source are shuffled by a seeded hash and ranked. Rank r of n gets the
fraction (r - 1/2) / n. In the order of the fractions every stretch holds each
source in its share, so cutting that order into equal stretches gives shards that
follow the mixture, with row counts at most one apart.

No task orders a whole source or the whole table: ranks are running counts inside
small hash buckets plus the counts of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Rows that one bucket holds on average.
BUCKET_ROWS = 20_000


def _fractions(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Add ``fraction``: the place of a row in its shuffled source, between 0 and 1."""
    shuffled = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")).withColumn(
        "b", F.pmod(F.shiftright("h", 32), F.lit(buckets)).cast("int")
    )
    counts = shuffled.groupBy("source", "b").count()
    in_source = Window.partitionBy("source")
    before = F.sum("count").over(
        in_source.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = counts.select(
        "source",
        "b",
        F.coalesce(before, F.lit(0)).alias("before"),
        F.sum("count").over(in_source).alias("n"),
    )
    joined = shuffled.alias("r").join(
        stage(cells, "cells").alias("c"),
        F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.b") == F.col("c.b")),
    )
    inside = Window.partitionBy("r.source", "r.b").orderBy("h", "doc_id", "size", "text_crc32")
    rank = F.col("before") + F.row_number().over(inside)
    return joined.select(
        "doc_id", F.col("r.source").alias("source"), "size", "text_crc32", "h",
        ((rank - F.lit(0.5)) / F.col("n")).alias("fraction"),
    )


def interleaved_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``doc_id, source, size, text_crc32, fraction, shard, slot`` for every row.

    ``size`` is the text's UTF-8 bytes plus 8, a null text has none. ``slot``
    numbers the rows of a shard from 0 without gaps. Null sources are one source,
    null ids come first in ties. Rows alike in id and text are alike and fill
    slots of their own. With fewer rows than shards some shards stay empty; an
    empty table gives no rows. Other columns are ignored.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = stage(rows, "shard_rows")
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    placed = stage(_fractions(rows, seed, buckets), "fractions")

    # The second sort by the same means: buckets of the fraction, counted first.
    placed = placed.withColumn("b", F.floor(F.col("fraction") * buckets).cast("int"))
    counts = placed.groupBy("b").count()
    before = F.sum("count").over(
        Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = stage(counts.select("b", F.coalesce(before, F.lit(0)).alias("before")), "cells")
    inside = Window.partitionBy("b").orderBy(
        "fraction", "source", "h", "doc_id", "size", "text_crc32"
    )
    at = F.col("before") + F.row_number().over(inside) - 1
    ordered = placed.join(cells, "b").withColumn("at", at)
    # Stretch s holds the places from ceil(s * total / shards) on.
    n = F.lit(max(total, 1))
    ordered = ordered.withColumn("shard", F.floor(F.col("at") * shards / n).cast("int"))
    first = -F.floor(-(F.col("shard").cast("long") * n) / shards)
    return ordered.select(
        "doc_id", "source", "size", "text_crc32", "fraction", "shard",
        (F.col("at") - first).cast("long").alias("slot"),
    )


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
) -> None:
    """Write every row with its ``slot`` as Parquet, one folder per shard.

    The row is one struct column ``row``, so its column names clash with nothing.
    Rows alike in id and text CRC take that pair's slots in any order.
    """
    placed = interleaved_shards(docs, shards, id_col, text_col, source_col, seed)
    key = ["doc_id", "text_crc32"]
    nth = Window.partitionBy(*key).orderBy("shard", "slot")
    placed = placed.select(*key, "shard", "slot", F.row_number().over(nth).alias("nth"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.crc32(text).alias("text_crc32"), whole.alias("row")
    )
    rows = rows.withColumn(
        "nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    )
    joined = rows.alias("r").join(
        placed.alias("p"),
        F.col("r.doc_id").eqNullSafe(F.col("p.doc_id"))
        & (F.col("r.text_crc32") == F.col("p.text_crc32"))
        & (F.col("r.nth") == F.col("p.nth")),
    )
    (
        joined.select("shard", "slot", "row")
        .repartition("shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
