"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of fixed size. Equal blocks get the same integer name:
the rank of the block in a sort of the distinct blocks. Adjacent names are then
paired and the distinct pairs named the same way, until one name per document is
left. Names stand for contents, never for hashes, so equal names mean equal texts.

The first block is named first, together with the length. A document that shares
this name with no other is settled there, so only possible copies go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, full_text, stage

#: Characters of a block. Larger blocks make fewer rows and wider sort keys.
BLOCK_CHARS = 512


def _names(blocks: DataFrame, *columns: str) -> DataFrame:
    """Each distinct row with an integer ``name`` that follows its sort within the partition."""
    distinct = blocks.select(*columns).distinct().sortWithinPartitions(*columns)
    return stage(distinct.withColumn("name", F.monotonically_increasing_id()), "names")


def _named_blocks(rows: DataFrame, block_chars: int) -> DataFrame:
    """``row_id, pos, name`` for the blocks after the first."""
    rest = F.col("rest")
    last = F.floor((F.char_length(rest) - 1) / block_chars).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(F.col("rest"), i * block_chars + 1, F.lit(block_chars)),
    )
    blocks = rows.where(F.char_length(rest) > 0).select(
        "row_id", F.posexplode(cut).alias("pos", "block")
    )
    names = _names(blocks, "block")
    return stage(blocks.join(names, "block").select("row_id", "pos", "name"), "blocks")


def _paired(named: DataFrame) -> DataFrame:
    """Name adjacent pairs: half as many positions. A last name without partner pairs with -1."""
    even = F.col("pos") % 2 == 0
    pairs = named.groupBy("row_id", (F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.max(F.when(even, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
    )
    pairs = stage(pairs, "pairs")
    names = _names(pairs, "left", "right")
    return stage(pairs.join(names, ["left", "right"]).select("row_id", "pos", "name"), "blocks")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Of equal texts the row with the largest id stays. Null text is empty text, and
    empty texts are equal. A null id is smaller than any other. Rows that repeat
    id and text count in ``group_size``; they are all ``kept`` if their id is.
    Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), full_text(text_col).alias("text")
    ).select(
        "doc_id",
        F.char_length("text").alias("n"),
        F.substring("text", 1, block_chars).alias("head"),
        "text",
    )
    shared = (
        rows.groupBy("n", "head")
        .count()
        .where("count > 1")
        .sortWithinPartitions("n", "head")
        .select("n", "head", F.monotonically_increasing_id().alias("head_name"))
    )
    shared = stage(shared, "heads")
    # Rows alone under their first name are settled and leave their text behind.
    marked = rows.join(shared, ["n", "head"], "left").select(
        "doc_id",
        "head_name",
        F.sha2("text", 256).alias("text_sha256"),
        F.when(
            F.col("head_name").isNotNull(),
            F.substring("text", F.lit(block_chars + 1), F.char_length("text")),
        ).alias("rest"),
    )
    marked = stage(marked.withColumn("row_id", F.monotonically_increasing_id()), "marked")

    open_rows = marked.where(F.col("head_name").isNotNull())
    named = _named_blocks(open_rows, block_chars)
    longest = named.agg(F.max("pos")).first()[0] or 0
    while longest > 0:
        named = _paired(named)
        longest //= 2

    ids = marked.drop("rest", "text_sha256")
    identity = (
        ids.where(F.col("head_name").isNotNull())
        .join(named.select("row_id", "name"), "row_id", "left")
        .select("row_id", "doc_id", "head_name", F.coalesce("name", F.lit(-1)).alias("name"))
    )
    groups = identity.groupBy("head_name", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    grouped = identity.join(groups, ["head_name", "name"]).select(
        "row_id", "keep_id", "group_size"
    )
    found = marked.drop("rest").join(stage(grouped, "groups"), "row_id", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id stays, with all their columns."""
    kept_id, kept_sha = free_name("_kept_id", docs), free_name("_kept_sha", docs)
    found = exact_duplicates(docs, id_col, text_col).where("kept")
    stay = found.select(
        F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)
    ).distinct()
    match = F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (
        F.sha2(full_text(text_col), 256) == F.col(kept_sha)
    )
    return docs.join(stay, match, "left_semi")
