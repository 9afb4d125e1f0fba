"""The most frequent n-grams, exact, without shuffling every n-gram.

An n-gram cannot occur more often than all n-grams of its hash bucket together. So the
buckets are counted first: a fixed number of counters, added up in each task. Counting the
n-grams of the fullest buckets then gives a count that the wanted ones must reach, and
only buckets that reach it too can hold more of them. As a rule none is left.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import bind
from ..session import cut_lineage
from .profile import _first_seen

#: Counters per n-gram size, and buckets counted first per wanted n-gram.
BUCKETS, FIRST = 1 << 16, 16


def token_bags(
    df: DataFrame,
    row_id: str,
    text_col: str = "text",
    remove_stopwords: bool = True,
    words: Iterable[str] = T.ENGLISH_STOPWORDS,
) -> DataFrame:
    """``base, bag``: a text's place in the corpus and its tokens, for cleaned text."""
    return df.select(
        _first_seen(F.col(row_id)).alias("base"),
        T.kept_tokens(F.col(text_col), remove_stopwords, words).alias("bag"),
    )


def _starts(bag: Column, n: int) -> Column:
    return F.slice(bag, F.lit(1), F.greatest(F.size(bag) - (n - 1), F.lit(0)))


def _bucket(bag: Column, token: Column, i: Column, n: int) -> Column:
    rest = [F.get(bag, i + j) for j in range(1, n)]
    return F.pmod(F.xxhash64(F.lit(n), token, *rest), F.lit(BUCKETS))


def gram_buckets(bag: Column, n: int) -> Column:
    """The bucket of each n-gram of a bag, an array."""
    return F.transform(_starts(bag, n), lambda token, i: _bucket(bag, token, i, n))


def bucket_totals(bags: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``size, bucket, total``: at most ``BUCKETS`` rows per size, and per task before that."""

    def of_size(bag: Column, n: int) -> Column:
        return F.transform(
            gram_buckets(bag, n), lambda b: F.struct(F.lit(n).alias("size"), b.alias("bucket"))
        )

    def buckets(bag: Column) -> Column:
        return F.concat(*[of_size(bag, n) for n in sizes])

    found = bags.select(F.inline(bind(F.col("bag"), buckets)))
    return found.groupBy("size", "bucket").agg(F.count("*").alias("total"))


def _mask(chosen: np.ndarray) -> Column:
    """A set of buckets as a constant array of 64-bit numbers."""
    bits = np.zeros(BUCKETS // 64, np.uint64)
    np.bitwise_or.at(bits, chosen >> 6, np.uint64(1) << (chosen & 63).astype(np.uint64))
    return F.from_json(F.lit(json.dumps(bits.view(np.int64).tolist())), "array<bigint>")


def _grams_in(bags: DataFrame, chosen: Mapping[int, np.ndarray]) -> DataFrame:
    """``size, term, n, first_seen`` of all n-grams in the chosen buckets, one scan for all sizes."""
    masked = bags.withColumns({f"mask_{n}": _mask(buckets) for n, buckets in chosen.items()})

    def of_size(bag: Column, n: int) -> Column:
        def is_chosen(gram: Column) -> Column:
            word = F.get(f"mask_{n}", F.shiftright(gram["bucket"], 6).cast("int"))
            bit = gram["bucket"].bitwiseAND(F.lit(63)).cast("int")
            return F.call_function("shiftright", word, bit).bitwiseAND(F.lit(1)) == 1

        def spelled(gram: Column) -> Column:
            words = [F.get(bag, gram["pos"] + j) for j in range(n)]
            return F.struct(
                F.lit(n).alias("size"),
                gram["pos"].alias("pos"),
                F.concat_ws(" ", *words).alias("term"),
            )

        placed = F.transform(
            _starts(bag, n),
            lambda token, i: F.struct(_bucket(bag, token, i, n).alias("bucket"), i.alias("pos")),
        )
        return F.transform(F.filter(placed, is_chosen), spelled)

    def grams(bag: Column) -> Column:
        return F.concat(*[of_size(bag, n) for n in chosen])

    found = masked.select("base", F.inline(bind(F.col("bag"), grams)))
    return found.groupBy("size", "term").agg(
        F.count("*").alias("n"), F.min(F.col("base") + F.col("pos")).alias("first_seen")
    )


def _leading(grams: DataFrame, sizes: Iterable[int], top_n: int) -> DataFrame:
    """``size, rank, term, n`` of the first ``top_n`` per size. The counts are stored first."""
    stored = cut_lineage(grams)
    order = [F.desc("n"), F.asc("first_seen")]
    parts = []
    for size in sorted(sizes):
        leading = stored.filter(F.col("size") == size).orderBy(*order).limit(top_n)
        # the limit bounds the one-task numbering
        rank = F.row_number().over(Window.orderBy(*order))
        parts.append(leading.select("size", rank.alias("rank"), "term", "n"))
    return functools.reduce(DataFrame.unionByName, parts)


def leading_ngrams(
    bags: DataFrame,
    sizes: Sequence[int],
    top_n: int = 25,
    totals: DataFrame | None = None,
) -> DataFrame:
    """``size, rank, term, n``: per size the most frequent n-grams, ties by first occurrence.

    Runs at once: one scan of ``bags`` for the buckets unless ``totals`` has them, one for
    the n-grams of the fullest buckets, and a third only where buckets are left that could
    hold a wanted one. N-grams are made after filtering, as in :func:`ngram_counts`.
    """
    if min(sizes) < 2:
        raise ValueError("n-grams need n >= 2")
    if totals is None:
        totals = bucket_totals(bags, sizes)
    full = {n: np.zeros(BUCKETS, np.int64) for n in sizes}
    for batch in totals.select("size", "bucket", "total").toArrow().to_batches():
        size, bucket, total = (column.to_numpy(False) for column in batch.columns)
        for n in sizes:
            full[n][bucket[size == n]] = total[size == n]

    chosen = {n: np.argsort(-t, kind="stable")[: FIRST * top_n] for n, t in full.items()}
    chosen = {n: buckets[full[n][buckets] > 0] for n, buckets in chosen.items()}
    counted = cut_lineage(_leading(_grams_in(bags, chosen), sizes, top_n))
    reached = dict.fromkeys(sizes, 1)
    for row in counted.filter(F.col("rank") == top_n).collect():
        reached[row["size"]] = row["n"]
    needed = {n: np.flatnonzero(full[n] >= reached[n]) for n in sizes}
    left = {n: b for n, b in needed.items() if len(np.setdiff1d(b, chosen[n]))}
    if not left:
        return counted
    more = _leading(_grams_in(bags, left), left, top_n)
    return counted.filter(~F.col("size").isin(list(left))).unionByName(more)
