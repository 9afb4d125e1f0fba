"""Corpus profile.

Most analyses need only one of two compact tables, each made in one pass over
the corpus and far smaller than it:

* ``length_counts``: how many texts of a class have a given length;
* ``term_counts`` / ``ngram_counts``: how often a term occurs and where first.

The analyses below take these tables. :mod:`.one_scan` makes both, and what the n-grams
need, in a single pass, so a full profile reads and tokenises the corpus twice.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.vectors import bind
from .lookup import dictionary_join, free_name

IMBALANCE_LIMIT = 10.0


# --- shape, missing values, head -------------------------------------------------


def profile_shape(df: DataFrame) -> DataFrame:
    """``column, type, position, n_rows, n_columns``, one row per column."""
    return shape_of(df.schema, df.agg(F.count("*").alias("n_rows")))


def shape_of(types: StructType, counted: DataFrame) -> DataFrame:
    """:func:`profile_shape` from a schema and a frame of one row, ``n_rows``."""
    schema = [(f.name, f.dataType.simpleString()) for f in types.fields]
    described = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind).alias("type"),
                F.lit(position).alias("position"),
            )
            for position, (name, kind) in enumerate(schema)
        ]
    )
    return counted.select(
        "n_rows", F.lit(len(schema)).alias("n_columns"), F.inline(described)
    ).select("column", "type", "position", "n_rows", "n_columns")


def profile_missing(df: DataFrame) -> DataFrame:
    """``column, n_missing`` in one pass over the frame."""
    names = df.columns
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counted.unpivot([], names, "column", "n_missing")


def head(df: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``row_id``."""
    return df.orderBy(row_id).limit(n)


# --- classes ----------------------------------------------------------------------


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``label, n``, most frequent first; null labels are not a class."""
    return (
        df.filter(F.col(label_col).isNotNull())
        .groupBy(F.col(label_col).alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def num_classes(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.agg(F.count_distinct(label_col).alias("num_classes"))


def imbalance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Largest by smallest class count; no row unless there are two classes.

    ``imbalanced`` flags a ratio above 10. Observed classes are never empty; a
    zero count (from a prepared distribution) gives infinity.
    """
    return imbalance_of(label_distribution(df, label_col))


def imbalance_of(distribution: DataFrame) -> DataFrame:
    counts = distribution.agg(
        F.max("n").alias("max_n"), F.min("n").alias("min_n"), F.count("*").alias("num_classes")
    )
    ratio = F.when(F.col("min_n") > 0, F.try_divide(F.col("max_n"), F.col("min_n"))).otherwise(
        F.lit(float("inf"))
    )
    return (
        counts.filter(F.col("num_classes") > 1)
        .select("max_n", "min_n", ratio.cast("double").alias("imbalance_ratio"))
        .withColumn("imbalanced", F.col("imbalance_ratio") > IMBALANCE_LIMIT)
    )


def top_classes(df: DataFrame, label_col: str = "label", k: int = 20) -> DataFrame:
    """Rows of the ``k`` most frequent classes (ties by name), all rows if fewer."""
    leading = label_distribution(df, label_col).limit(k).select(F.col("label").alias("_top"))
    return df.join(F.broadcast(leading), F.col(label_col) == F.col("_top"), "left_semi")


def class_order(df: DataFrame, label_col: str = "label", k: int = 20) -> DataFrame:
    """``position, label``: by count when there are more than ``k`` classes, else by name."""
    leading = label_distribution(df, label_col).limit(k + 1)
    sized = leading.withColumn("many", F.count("*").over(Window.partitionBy()) > k)
    by_count = F.row_number().over(Window.orderBy(F.desc("n"), "label"))
    by_name = F.row_number().over(Window.orderBy("label"))
    return (
        sized.select(F.when(F.col("many"), by_count).otherwise(by_name).alias("position"), "label")
        .filter(F.col("position") <= k)
    )


# --- lengths ----------------------------------------------------------------------


def length_counts(
    df: DataFrame, text_col: str = "text", label_col: str | None = "label"
) -> DataFrame:
    """``label, measure, length, n`` for the measures ``char`` and ``word``.

    Expects cleaned text. One shuffle of at most one row per task, class and
    distinct length, whatever the size of the corpus or of its largest class.
    """
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    return count_lengths(
        df.select(label.alias("label"), *text_lengths(F.col(text_col)))
    )


def text_lengths(cleaned: Column) -> list[Column]:
    """``char`` and ``word`` length of one text."""
    return [T.char_length(cleaned).alias("char"), T.word_length(cleaned).alias("word")]


def count_lengths(measured: DataFrame) -> DataFrame:
    """:func:`length_counts` of texts already reduced to ``label, char, word``.

    When labels come from another table, measure first and join after: the join
    then moves two numbers per text instead of the text.
    """
    return (
        measured.unpivot("label", ["char", "word"], "measure", "length")
        .groupBy("label", "measure", "length")
        .agg(F.count("*").alias("n"))
    )


def _overall(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("measure", "length").agg(F.sum("n").alias("n"))


def describe_length(lengths: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per measure."""
    return _describe(_overall(lengths), ["measure"])


def _describe(counted: DataFrame, by: list[str]) -> DataFrame:
    group = Window.partitionBy(*by)
    mean = F.sum(F.col("n") * F.col("length")).over(group) / F.sum("n").over(group)
    spread = counted.withColumn("mean", mean)
    quartiles = F.percentile("length", [0.25, 0.5, 0.75], F.col("n"))
    squares = F.sum(F.col("n") * F.pow(F.col("length") - F.col("mean"), F.lit(2)))
    summary = spread.groupBy(*by).agg(
        F.sum("n").alias("count"),
        F.first("mean").alias("mean"),
        squares.alias("squares"),
        F.min("length").alias("min"),
        quartiles.alias("q"),
        F.max("length").alias("max"),
    )
    deviation = F.when(
        F.col("count") > 1, F.sqrt(F.try_divide(F.col("squares"), F.col("count") - 1))
    ).otherwise(F.lit(float("nan")))
    return summary.select(
        *by,
        "count",
        "mean",
        deviation.alias("std"),
        "min",
        *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))],
        "max",
    )


def length_histogram(lengths: DataFrame, bins: int = 50) -> DataFrame:
    """``measure, bin, bin_start, bin_end, n``: equal widths from minimum to maximum.

    The last bin is closed. Empty bins are listed. If all lengths are equal the
    range is widened by one half on both sides.
    """
    group = Window.partitionBy("measure")
    lo, hi = F.min("length").over(group), F.max("length").over(group)
    bounded = _overall(lengths).select("measure", "length", "n", lo.alias("lo"), hi.alias("hi"))
    spans = F.col("lo") < F.col("hi")
    # integer division keeps the bin of a length exact
    position = F.when(
        spans, F.expr(f"((length - lo) * {bins}L) div nullif(hi - lo, 0)")
    ).otherwise(F.lit(bins // 2))
    filled = (
        bounded.groupBy(
            "measure", "lo", "hi", F.least(position, F.lit(bins - 1)).cast("int").alias("bin")
        )
        .agg(F.sum("n").alias("n"))
        .groupBy("measure", "lo", "hi")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    )
    start = F.when(spans, F.col("lo")).otherwise(F.col("lo") - 0.5)
    width = F.when(spans, F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    return filled.select(
        "measure", "counts", start.alias("start"), width.alias("width"), every_bin
    ).select(
        "measure",
        "bin",
        (F.col("start") + F.col("width") * F.col("bin") / bins).alias("bin_start"),
        (F.col("start") + F.col("width") * (F.col("bin") + 1) / bins).alias("bin_end"),
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).alias("n"),
    )


def mean_length_by_class(lengths: DataFrame) -> DataFrame:
    """``label, mean_words``, longest first."""
    weighted = F.sum(F.col("n") * F.col("length")) / F.sum("n")
    return (
        lengths.filter((F.col("measure") == "word") & F.col("label").isNotNull())
        .groupBy("label")
        .agg(weighted.alias("mean_words"))
        .orderBy(F.desc("mean_words"), "label")
    )


def length_box_by_class(lengths: DataFrame, k: int | None = 20) -> DataFrame:
    """Box-plot numbers per class and measure, for the ``k`` most frequent classes.

    Whiskers end at the last length within 1.5 interquartile ranges of the box;
    what lies beyond is counted in ``n_outliers``. The table is read twice;
    store it first.
    """
    known = lengths.filter(F.col("label").isNotNull())
    if k is not None:
        # conditions inside the sum and an inner join keep both sides on one shuffle
        texts = F.sum(F.when(F.col("measure") == "char", F.col("n")).otherwise(F.lit(0)))
        sizes = known.groupBy("label").agg(texts.alias("size"))
        leading = sizes.orderBy(F.desc("size"), "label").limit(k).select("label")
        known = known.join(F.broadcast(leading), "label")
    group = Window.partitionBy("label", "measure")
    quartiles = F.percentile("length", [0.25, 0.5, 0.75], F.col("n")).over(group)
    boxed = known.select("label", "measure", "length", "n", quartiles.alias("q")).select(
        "*", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))]
    )
    reach = (F.col("q75") - F.col("q25")) * 1.5
    inside = F.col("length").between(F.col("q25") - reach, F.col("q75") + reach)
    low = F.min(F.when(inside, F.col("length"))).cast("double")
    high = F.max(F.when(inside, F.col("length"))).cast("double")
    return boxed.groupBy("label", "measure", "q25", "q50", "q75").agg(
        F.sum("n").alias("count"),
        F.min("length").alias("min"),
        F.max("length").alias("max"),
        # a whisker never ends inside the box
        F.least(low, F.col("q25")).alias("whisker_low"),
        F.greatest(high, F.col("q75")).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("n_outliers"),
    )


# --- terms ------------------------------------------------------------------------


def _first_seen(row_id: Column) -> Column:
    """Row id and position in one number that sorts like the pair.

    A decimal keeps the minimum inside hash aggregation, where a struct would
    force every token through a sort. Positions stay below 2^32.
    """
    return row_id.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")


#: Longer stopword lists are joined as tables; a literal of them would slow every task down.
MAX_LITERAL_WORDS = 2000

Words = Iterable[str] | DataFrame


def _word_table(spark: SparkSession, words: Words) -> DataFrame | None:
    """Distinct ``word`` of a long list or a frame's first column; None for a short list."""
    if isinstance(words, DataFrame):
        return words.select(F.col(f"`{words.columns[0]}`").cast("string").alias("word")).distinct()
    words = sorted(set(words))
    if len(words) <= MAX_LITERAL_WORDS:
        return None
    return spark.createDataFrame(pd.DataFrame({"word": words}), "word string")


def mark_stopwords(terms: DataFrame, words: Words) -> DataFrame:
    """Add ``is_stopword`` to a table of terms, from a list of any length or a frame.

    Terms are counted before, so a long list meets one row per term.
    """
    words = words if isinstance(words, DataFrame) else list(words)
    table = _word_table(terms.sparkSession, words)
    if table is None:
        return terms.withColumn("is_stopword", T.is_stopword(F.col("term"), words))
    found = free_name("_found", terms)
    marked = dictionary_join(terms, table.withColumn(found, F.lit(True)), "term", "left")
    return marked.withColumn("is_stopword", F.coalesce(found, F.lit(False))).drop(found)


def corpus_tokens(
    df: DataFrame,
    row_id: str,
    text_col: str = "text",
    remove_stopwords: bool = True,
    words: Words = T.ENGLISH_STOPWORDS,
) -> DataFrame:
    """``row_id, pos, token``: the alphanumeric tokens of cleaned text.

    A long stopword list, or a frame of words, is taken out by an anti join: broadcast if
    it is measured to be small, with the most frequent tokens in parts otherwise.
    """
    words = words if isinstance(words, DataFrame) else list(words)
    exploded = df.select(
        F.col(row_id).alias("row_id"),
        F.posexplode(T.raw_tokens(F.col(text_col))).alias("pos", "token"),
    ).filter(T.is_alnum(F.col("token")))
    if not remove_stopwords:
        return exploded
    table = _word_table(df.sparkSession, words)
    if table is None:
        return exploded.filter(~T.is_stopword(F.col("token"), words))
    return dictionary_join(exploded, table, "token", "left_anti")


def term_counts(
    df: DataFrame,
    row_id: str,
    text_col: str = "text",
    words: Words = T.ENGLISH_STOPWORDS,
) -> DataFrame:
    """``term, n, first_seen, is_stopword`` over all alphanumeric tokens."""
    exploded = df.select(
        _first_seen(F.col(row_id)).alias("base"),
        F.posexplode(T.raw_tokens(F.col(text_col))).alias("pos", "term"),
    ).filter(T.is_alnum(F.col("term")))
    counted = exploded.groupBy("term").agg(
        F.count("*").alias("n"), F.min(F.col("base") + F.col("pos")).alias("first_seen")
    )
    return mark_stopwords(counted, words)


def without_stopwords(terms: DataFrame) -> DataFrame:
    return terms.filter(~F.col("is_stopword"))


def vocab_size(terms: DataFrame) -> DataFrame:
    """Number of distinct terms."""
    return terms.agg(F.count("*").alias("vocab_size"))


def approx_vocab_size(
    df: DataFrame,
    row_id: str,
    text_col: str = "text",
    remove_stopwords: bool = True,
    rsd: float = 0.01,
) -> DataFrame:
    """Estimated number of distinct terms without shuffling the vocabulary."""
    bag = corpus_tokens(df, row_id, text_col, remove_stopwords)
    return bag.agg(F.approx_count_distinct("token", rsd).alias("approx_vocab_size"))


def _ranked_terms(terms: DataFrame, n: int, order: list[Column]) -> DataFrame:
    # the limit bounds the one-task numbering to n rows
    leading = terms.select("term", "n", "first_seen").orderBy(*order).limit(n)
    return leading.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "term", "n")


def top_terms(terms: DataFrame, n: int = 25) -> DataFrame:
    """``rank, term, n``: most frequent first, ties by first occurrence."""
    return _ranked_terms(terms, n, [F.desc("n"), F.asc("first_seen")])


def rare_terms(terms: DataFrame, n: int = 25) -> DataFrame:
    """The tail of the :func:`top_terms` order read backwards."""
    return _ranked_terms(terms, n, [F.asc("n"), F.desc("first_seen")])


def ngram_counts(
    df: DataFrame,
    row_id: str,
    n: int,
    text_col: str = "text",
    remove_stopwords: bool = True,
    words: Iterable[str] = T.ENGLISH_STOPWORDS,
) -> DataFrame:
    """``term, n, first_seen`` of the n-grams inside one text, joined by spaces.

    N-grams are made after filtering, so they span removed stopwords; texts
    with fewer than ``n`` tokens give none.
    """
    if n < 2:
        raise ValueError("n-grams need n >= 2")
    bag = df.select(
        _first_seen(F.col(row_id)).alias("base"),
        T.kept_tokens(F.col(text_col), remove_stopwords, words).alias("bag"),
    )

    def joined(tokens: Column) -> Column:
        starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        return F.transform(
            starts,
            lambda token, i: F.concat_ws(" ", token, *[F.get(tokens, i + j) for j in range(1, n)]),
        )

    grams = bind(F.col("bag"), joined)
    return (
        bag.select("base", F.posexplode(grams).alias("pos", "term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"), F.min(F.col("base") + F.col("pos")).alias("first_seen"))
    )


def top_ngrams(grams: DataFrame, top_n: int = 25) -> DataFrame:
    """``rank, term, n`` of an :func:`ngram_counts` table."""
    return top_terms(grams, top_n)


# --- rank and frequency -----------------------------------------------------------


def frequency_ranks(terms: DataFrame, count_col: str = "n") -> DataFrame:
    """``frequency, n_terms, rank_from, rank_to``: which ranks share a frequency.

    Distinct frequencies of N tokens number at most sqrt(2 N), so the running
    sum over them fits one task even when the vocabulary does not.
    """
    shared = terms.groupBy(F.col(count_col).alias("frequency")).agg(F.count("*").alias("n_terms"))
    upto = Window.orderBy(F.desc("frequency")).rowsBetween(Window.unboundedPreceding, 0)
    return shared.withColumn("rank_to", F.sum("n_terms").over(upto)).select(
        "frequency",
        "n_terms",
        (F.col("rank_to") - F.col("n_terms") + 1).alias("rank_from"),
        "rank_to",
    )


_RANKS_PER_CHUNK = 10_000


def zipf(terms: DataFrame) -> DataFrame:
    """``rank, frequency, ideal``, one row per term; ideal is top frequency / rank.

    Ranks are written out from the frequency table in chunks spread over the
    cluster; the vocabulary itself is never sorted.
    """
    shared = frequency_ranks(terms)
    top = F.max("frequency").over(Window.partitionBy())
    chunked = (
        shared.withColumn("top", top)
        .select(
            "frequency",
            "top",
            "rank_to",
            F.explode(
                F.sequence(
                    F.col("rank_from"), F.col("rank_to"), F.lit(_RANKS_PER_CHUNK).cast("long")
                )
            ).alias("start"),
        )
        .repartition("start")
    )
    return chunked.select(
        "frequency",
        "top",
        F.explode(
            F.sequence(
                F.col("start"), F.least(F.col("start") + (_RANKS_PER_CHUNK - 1), F.col("rank_to"))
            )
        ).alias("rank"),
    ).select("rank", "frequency", (F.col("top") / F.col("rank")).alias("ideal"))


def frequency_range(terms: DataFrame) -> DataFrame:
    """Number of terms and their largest and smallest frequency."""
    return terms.agg(
        F.count("*").alias("n_terms"),
        F.max("n").alias("max_frequency"),
        F.min("n").alias("min_frequency"),
    )
