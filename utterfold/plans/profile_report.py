"""The full corpus profile."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOPWORDS, clean_punct
from ..operators import profile as P
from ..operators.cleanup import apply_cleanup
from ..operators.lookup import free_name
from ..operators.ngrams import leading_ngrams, token_bags
from ..operators.one_scan import scan_once
from ..session import cut_lineage

_SIZES = (2, 3)


def run_profile(
    df: DataFrame,
    row_id: str,
    text_col: str = "text",
    label_col: str = "label",
    top_n: int = 25,
    deep: bool = True,
    words: Iterable[str] = ENGLISH_STOPWORDS,
    clean: bool = True,
) -> dict[str, DataFrame]:
    """Every analysis of a corpus, by name.

    ``clean`` removes punctuation from the text and drops incomplete rows first; the cleaned
    rows are written once.

    The corpus is read and tokenised twice: once for all counts, which go to the shared
    folder, and once for the n-grams that can be among the most frequent ones. Only the
    first rows are read a third time, as they are.
    """
    if clean:
        df = cut_lineage(apply_cleanup(df, clean_punct, [text_col]))
    words = list(words)
    counts = scan_once(df, row_id, text_col, label_col, words, _SIZES)
    lengths, terms = counts.lengths, counts.terms
    kept = P.without_stopwords(terms)
    classes = (
        lengths.filter((F.col("measure") == "char") & F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.sum("n").alias("n"))
    )
    grams = leading_ngrams(
        token_bags(df, row_id, text_col, True, words), _SIZES, top_n, counts.gram_totals
    )
    # The names of the analyses.
    report = {
        "shape": counts.shape,
        "missing_values": counts.missing,
        "head": P.head(df, row_id),
        "target_distribution": classes.orderBy(F.desc("n"), "label"),
        "num_classes": classes.agg(F.count("*").alias("num_classes")),
        "imbalance": P.imbalance_of(classes),
        "length_stats": P.describe_length(lengths),
        "length_histogram": P.length_histogram(lengths),
        "vocabulary_size": P.vocab_size(kept),
        "most_common_words": P.top_terms(kept, top_n),
        "least_common_words": P.rare_terms(kept, top_n),
    }
    for n in _SIZES:
        report[f"most_common_{n}grams"] = grams.filter(F.col("size") == n).drop("size")
    if deep:
        report["avg_word_length_by_class"] = P.mean_length_by_class(lengths)
        report["length_box_by_class"] = P.length_box_by_class(lengths)
        report["zipf_stopwords_included"] = P.zipf(terms)
        report["zipf_stopwords_removed"] = P.zipf(kept)
        report["frequency_range"] = P.frequency_range(terms)
    return report


#: What identifies a row of an analysis; all other columns of numbers are its figures.
_KEYS = {
    "shape": ["column", "type"],
    "missing_values": ["column"],
    "target_distribution": ["label"],
    "length_stats": ["measure"],
    "length_histogram": ["measure", "bin"],
    "most_common_words": ["term"],
    "least_common_words": ["term"],
    "most_common_2grams": ["term"],
    "most_common_3grams": ["term"],
    "avg_word_length_by_class": ["label"],
    "length_box_by_class": ["label", "measure"],
    "zipf_stopwords_included": ["rank"],
    "zipf_stopwords_removed": ["rank"],
}


def report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """``analysis, key, figure, value``: all analyses in one long table.

    The parts of a key are joined by ``|``. Of the first rows every field is a row, its
    text in ``key`` after the position and the name.
    """
    parts = []
    for name, table in report.items():
        if name == "head":
            place = free_name("position", table)
            numbered = table.withColumn(
                place, F.row_number().over(Window.orderBy(table.columns[0])) - 1
            )
            fields = [
                F.concat_ws("|", place, F.lit(c), F.col(f"`{c}`").cast("string"))
                for c in table.columns
            ]
            value = F.col(place).cast("double")
            figures = F.array(F.struct(F.lit("position").alias("figure"), value.alias("value")))
            rows = numbered.select(
                F.explode(F.array(*fields)).alias("key"), figures.alias("figures")
            )
        else:
            keys = _KEYS.get(name, [])
            kept = [c for c in table.columns if c not in keys]
            figures = F.array(
                *[
                    F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value"))
                    for c in kept
                ]
            )
            rows = table.select(F.concat_ws("|", *keys).alias("key"), figures.alias("figures"))
        parts.append(rows.select(F.lit(name).alias("analysis"), "key", F.inline("figures")))
    return functools.reduce(DataFrame.unionByName, parts)
