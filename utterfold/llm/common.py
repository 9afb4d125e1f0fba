"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def full_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else.

    ``lower`` does that by itself where every character is one byte.
    """
    one_byte = F.octet_length(text) == F.char_length(text)
    return F.when(one_byte, F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, doc_key, text``: the only columns the operators look at.

    A document is a row's id and text. ``doc_key`` hashes the text and tells rows
    apart that share an id; rows that share both are the same document.
    """
    text = full_text(text_col)
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text")
    )


def same_document(left: str, right: str) -> Column:
    """Join condition on the key of ``keyed``; a null id equals a null id."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.doc_key") == F.col(f"{right}.doc_key")
    )


def free_name(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_on_document(
    docs: DataFrame, marks: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Join whole rows of ``docs`` with ``marks`` (``doc_id, doc_key, ...``) of ``keyed``."""
    doc_id, doc_key = free_name("_doc_id", docs), free_name("_doc_key", docs)
    renamed = marks.withColumnsRenamed({"doc_id": doc_id, "doc_key": doc_key})
    match = F.col(f"`{id_col}`").eqNullSafe(F.col(doc_id)) & (
        F.xxhash64(full_text(text_col)) == F.col(doc_key)
    )
    return docs.join(renamed, match, how)


@contextlib.contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within this block Spark deletes the shuffle files of a query that has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and go on from the files.

    Lost executors cost a file read, row ids made with
    ``monotonically_increasing_id`` stay what they are, and the shuffles that
    made the table give their disk back. Readers take thousands of rows of a file at
    once, so rows of megabytes need a bound on ``rows_per_file``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _freeing_shuffles(spark):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(
            path
        )
    return spark.read.schema(df.schema).parquet(path)
