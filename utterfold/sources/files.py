"""Reading corpora and scoring input."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import require_column
from .records import records, stream_records

# Field contents read as missing in delimited corpora.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_TYPES = {".tsv": "tsv", ".csv": "csv", ".json": "json", ".jsonl": "json"}
SEPARATORS = {"tsv": "\t", "csv": ","}
_RAW = "_malformed"


def infer_file_type(path: str) -> str:
    """``tsv``, ``csv`` or ``json`` from the extension, whatever its case."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in _TYPES:
        raise ValueError(f"unsupported file extension {extension!r}, expected {sorted(_TYPES)}")
    return _TYPES[extension]


def check_file_type(file_type: str) -> str:
    if file_type not in ("tsv", "csv", "json"):
        raise ValueError(f"unsupported file type {file_type!r}")
    return file_type


def all_strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def csv_options(separator: str) -> dict[str, str]:
    """Standard quoting: a quote inside a quoted field is doubled, outer spaces are kept."""
    return {
        "sep": separator,
        "quote": '"',
        "escape": '"',
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }


def checked_schema(columns: Sequence[str]) -> T.StructType:
    """All strings, with a column for records that do not fit."""
    return all_strings([*columns, _RAW])


def whole_records(df: DataFrame, columns: Sequence[str], separator: str) -> DataFrame:
    """Fail on a record with more fields than columns or with a quote that never closes.

    One rule for batch, scoring and stream readers. Short records end in nulls.
    """
    raw = F.col(_RAW)
    separators = F.length(raw) - F.length(F.replace(raw, F.lit(separator), F.lit("")))
    quotes = F.length(raw) - F.length(F.replace(raw, F.lit('"'), F.lit("")))
    all_fields = F.concat_ws("", *[F.col(f"`{c}`") for c in columns])
    # naming every column: Spark only notices extra fields when it parses whole rows
    record = F.concat(raw, F.substring(all_fields, 1, 0))
    problem = F.when(quotes % 2 == 1, F.lit("unclosed quote: ")).when(
        separators >= len(columns), F.lit("more fields than columns: ")
    )
    failed = F.raise_error(F.concat(problem, record)).cast("boolean")
    fits = F.when(raw.isNotNull() & problem.isNotNull(), failed).otherwise(F.lit(True))
    return df.filter(fits).select(*[F.col(f"`{c}`") for c in columns])


def parsed_records(found: DataFrame, columns: Sequence[str], separator: str) -> DataFrame:
    """``columns`` of the records in ``record``, checked by :func:`whole_records`."""
    names = ", ".join("`" + name.replace("`", "``") + "` string" for name in [*columns, _RAW])
    options = {**csv_options(separator), "columnNameOfCorruptRecord": _RAW}
    # a line break of its own, so that the parser leaves those inside quotes alone
    parsed = found.select(F.from_csv("record", names, options).alias("fields"))
    return whole_records(parsed.select("fields.*"), columns, separator)


def _delimited(
    spark: SparkSession, path: str, columns: Sequence[str] | None, separator: str, multi_line: bool
) -> DataFrame:
    """Checked records of delimited files; without ``columns`` a header names them."""
    reader = spark.read.options(**csv_options(separator))
    header = columns is None
    if header:
        # header only: with a schema of strings nothing is inferred from the rows
        named = reader.option("header", True).option("multiLine", True).csv(path)
        columns = named.columns
    if multi_line:
        return parsed_records(records(spark, path, separator, header), columns, separator)
    reader = spark.read.options(**csv_options(separator)).option("header", header)
    reader = reader.schema(checked_schema(columns)).option("columnNameOfCorruptRecord", _RAW)
    return whole_records(reader.csv(path), columns, separator)


def streamed_delimited(
    reader, path: str, columns: Sequence[str], separator: str, header: bool, multi_line: bool
) -> DataFrame:
    """As for tables, from a ``spark.readStream`` with its options."""
    if multi_line:
        found = stream_records(
            reader, path, separator, header, csv_options(separator), len(columns)
        )
        return parsed_records(found, columns, separator)
    reader = reader.options(**csv_options(separator)).option("header", header)
    reader = reader.schema(checked_schema(columns)).option("columnNameOfCorruptRecord", _RAW)
    return whole_records(reader.csv(path), columns, separator)


def read_corpus(
    spark: SparkSession,
    path: str,
    file_type: str | None = None,
    columns: Sequence[str] | None = None,
    na_tokens: Sequence[str] | None = NA_TOKENS,
    multi_line: bool = True,
) -> DataFrame:
    """A labelled corpus from TSV, CSV or line-delimited JSON, all columns strings.

    With ``columns`` a delimited file has no header; without them the header
    names the columns. Short rows end in nulls; a row with more fields than
    columns fails the query instead of losing a field, and so does a quote that never
    closes. Line breaks inside quotes belong to the field. Large files are split among
    tasks and scanned three times for it, see :mod:`.records`; with
    ``multi_line=False`` they are scanned once, and a record whose quote does not close
    on its line fails the query.
    """
    kind = check_file_type(file_type or infer_file_type(path))
    if kind == "json":
        if columns:
            return spark.read.schema(all_strings(columns)).json(path)
        return spark.read.option("primitivesAsString", True).json(path)
    df = _delimited(spark, path, columns, SEPARATORS[kind], multi_line)
    return mark_missing(df, na_tokens)


def mark_missing(df: DataFrame, na_tokens: Sequence[str] | None) -> DataFrame:
    """Null for every field that is one of ``na_tokens``."""
    if not na_tokens:
        return df
    return df.select(
        *[
            F.when(~F.col(c).isin(list(na_tokens)), F.col(c)).alias(c)
            for c in df.columns
        ]
    )


def read_scoring_input(
    spark: SparkSession, path: str, text_col: str = "text", multi_line: bool = True
) -> DataFrame:
    """Scoring input with a header, tabs for ``.tsv`` and commas otherwise.

    Empty fields, and those a short record lacks, are empty strings. Line breaks in
    quotes and records that do not fit are treated as in :func:`read_corpus`.
    """
    separator = "\t" if path.rstrip("/").lower().endswith(".tsv") else ","
    df = _delimited(spark, path, None, separator, multi_line)
    require_column(df.columns, text_col, "text")
    return df.na.fill("")
