"""All counts of a corpus profile from one pass over the texts.

Every text is tokenised once and gives a stream of tagged items: its lengths, its terms, the
hash buckets of its n-grams, its missing fields. One aggregation counts them all; map-side
combining keeps what leaves a task near the number of distinct items.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import bind
from ..session import cut_lineage
from .ngrams import gram_buckets
from .profile import _first_seen, shape_of

_CHAR, _WORD, _TERM, _MISSING, _GRAM = 0, 1, 2, 3, 10


@dataclass
class CorpusCounts:
    """What :func:`scan_once` found, as the tables that the analyses take."""

    shape: DataFrame
    missing: DataFrame
    lengths: DataFrame
    terms: DataFrame
    gram_totals: DataFrame


def _item(kind: int, key: Column, number: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), number.cast("bigint").alias("number")
    )


def _items(df: DataFrame, text_col: str, label: Column, words: Iterable[str], sizes: Sequence[int]):
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit(None).cast("string")
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in df.columns]

    def of_tokens(raw: Column) -> Column:
        n_words = F.size(F.filter(raw, lambda token: token != ""))
        return F.concat(
            F.array(_item(_WORD, label, n_words)),
            F.transform(raw, lambda token, i: _item(_TERM, token, i)),
            bind(T.kept_of(raw, True, words), of_bag),
        )

    def of_size(bag: Column, n: int) -> Column:
        return F.transform(gram_buckets(bag, n), lambda b: _item(_GRAM + n, none, b))

    def of_bag(bag: Column) -> Column:
        return F.concat(*[of_size(bag, n) for n in sizes])

    return F.concat(
        F.array(_item(_CHAR, label, T.char_length(text))),
        bind(T.raw_tokens(text), of_tokens),
        F.transform(
            F.filter(F.array(*missing), lambda c: c.isNotNull()),
            lambda c: _item(_MISSING, c, F.lit(0)),
        ),
    )


def scan_once(
    df: DataFrame,
    row_id: str,
    text_col: str = "text",
    label_col: str = "label",
    words: Iterable[str] = T.ENGLISH_STOPWORDS,
    sizes: Sequence[int] = (2, 3),
) -> CorpusCounts:
    """Count everything a profile needs of a cleaned corpus; runs at once."""
    words = list(words)
    items = df.select(
        _first_seen(F.col(row_id)).alias("base"),
        F.inline(_items(df, text_col, F.col(label_col).cast("string"), words, sizes)),
    )
    is_term = F.col("kind") == _TERM
    counted = cut_lineage(
        items.filter(~is_term | T.is_alnum(F.col("key")))
        .groupBy("kind", "key", F.when(~is_term, F.col("number")).alias("number"))
        .agg(
            F.count("*").alias("n"),
            F.min(F.when(is_term, F.col("base") + F.col("number"))).alias("first_seen"),
        )
    )
    lengths = counted.filter(F.col("kind") <= _WORD)
    names = df.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, df.columns))).alias("column")
    )
    absent = counted.filter(F.col("kind") == _MISSING).select(F.col("key").alias("column"), "n")
    rows = lengths.filter(F.col("kind") == _CHAR)
    return CorpusCounts(
        shape_of(df.schema, rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))),
        names.join(absent, "column", "left").select(
            "column", F.coalesce("n", F.lit(0)).alias("n_missing")
        ),
        lengths.select(
            F.col("key").alias("label"),
            F.when(F.col("kind") == _CHAR, "char").otherwise("word").alias("measure"),
            F.col("number").cast("int").alias("length"),
            "n",
        ),
        counted.filter(is_term)
        .select(F.col("key").alias("term"), "n", "first_seen")
        .withColumn("is_stopword", T.is_stopword(F.col("term"), words)),
        counted.filter(F.col("kind") >= _GRAM).select(
            (F.col("kind") - _GRAM).alias("size"), F.col("number").alias("bucket"),
            F.col("n").alias("total"),
        ),
    )
