"""Corpus files as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import (
    NA_TOKENS,
    SEPARATORS,
    all_strings,
    check_file_type,
    mark_missing,
    streamed_delimited,
)


def stream_corpus(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    file_type: str = "tsv",
    header: bool = False,
    na_tokens: Sequence[str] | None = NA_TOKENS,
    max_files_per_trigger: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """New files of a folder as rows, labels left combined.

    Unpacking, cleanup and encoding are row-wise and apply to the stream as
    they do to a table. Records are checked as :func:`read_corpus` checks them. With
    ``multi_line`` each file is read by one task, record by record, whatever its size.
    """
    kind = check_file_type(file_type)
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if kind == "json":
        return reader.schema(all_strings(columns)).json(path)
    df = streamed_delimited(reader, path, columns, SEPARATORS[kind], header, multi_line)
    return mark_missing(df, na_tokens)
