"""Benchmark passages in training documents, by a distributed positional inverted index.

A posting says that a term stands at a position of a document. Test windows are looked
up from their rarest terms: postings of the two rarest terms of each window, with their
offsets taken off, are intersected, which leaves few places where an item can be aligned
with a document. Only for those documents are the other terms' postings read, and the
aligned positions that agree are cut into unbroken stretches: a stretch of a whole
window is an exact match. Postings of the two rarest terms that lie close but not at
their offsets are proximity matches.

Terms are looked up in blocks of test windows, so that the table a block broadcasts has
a fixed bound. Term counts combine before the shuffle; postings of frequent terms are
never stored unless a window has no rarer ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import full_text, join_on_document, keyed, lower_ascii, same_document, stage

#: Words of a window.
WINDOW = 10
#: Windows that are looked up at once: a broadcast holds at most ten terms for each.
BLOCK_WINDOWS = 20_000
#: Words that the rarest two terms of a window may be shifted in a proximity match.
SLOP = 3


def words_of(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A to Z lower-cased."""
    parts = F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    return F.filter(parts, lambda w: w != "")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_id, words`` with one row per distinct item."""
    words = words_of(F.col("text"))
    items = benchmark.select(
        F.col(f"`{item_col}`").alias("item_id"), full_text(text_col).alias("text")
    ).distinct()
    return items.select("item_id", words.alias("words")).where(F.size("words") > 0)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``item_no, at, words`` per window of an item; a shorter item is one window."""
    last = F.greatest(F.size("words") - window, F.lit(0))
    return items.select(
        "item_no",
        F.posexplode(
            F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.slice("words", i, window))
        ).alias("at", "words"),
    )


def _rarest_two(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``item_no, at, t1, o1, t2, o2``: the rarest terms and their offsets.

    Windows with a term that no document holds cannot occur and are left out.
    """
    terms = windows.select("item_no", "at", F.size("words").alias("n"),
                           F.posexplode("words").alias("o", "t"))
    ranked = (
        terms.join(counts, "t")
        .groupBy("item_no", "at", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "o", "t"))).alias("r"))
        .where(F.size("r") == F.col("n"))
    )
    second = F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    return ranked.select(
        "item_no", "at", F.col("r")[0]["t"].alias("t1"), F.col("r")[0]["o"].alias("o1"),
        second["t"].alias("t2"), second["o"].alias("o2"),
    )


def _postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``t, doc_id, doc_key, pos`` for the given terms, a bounded table."""
    exploded = docs.select(
        "doc_id", "doc_key", F.posexplode(words_of(F.col("text"))).alias("pos", "t")
    )
    return exploded.join(F.broadcast(terms), "t")


def _block(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alignments ``doc_id, doc_key, item_no, shift`` and proximity matches of a block."""
    terms = stage(windows.select(F.explode("words").alias("t")).distinct(), "terms")
    held = docs.select(F.explode(words_of(F.col("text"))).alias("t")).join(
        F.broadcast(terms), "t"
    )
    counts = held.groupBy("t").agg(F.count("*").alias("df"))
    rarest = stage(_rarest_two(windows, stage(counts, "term_counts")), "rarest")
    wanted = rarest.select(F.explode(F.array("t1", "t2")).alias("t")).distinct()
    postings = stage(_postings(docs, wanted), "postings")

    def placed(which: int) -> DataFrame:
        return rarest.join(postings, rarest[f"t{which}"] == postings["t"]).select(
            "item_no", "at", "doc_id", "doc_key", (F.col("pos") - F.col(f"o{which}")).alias("s")
        )

    # Same window, same document, starts at most SLOP apart; a key of neighbouring cells
    # keeps this an equality join.
    cell = F.floor(F.col("s") / (SLOP + 1))
    one = placed(1).select("*", F.explode(F.array(cell - 1, cell, cell + 1)).alias("c"))
    two = placed(2).select("*", cell.alias("c"))
    x, y = one.alias("x"), two.alias("y")
    near = (
        x.join(
            y,
            same_document("x", "y")
            & F.expr("x.item_no = y.item_no AND x.at = y.at AND x.c = y.c")
            & (F.abs(F.expr("x.s - y.s")) <= SLOP),
        )
        .select("x.doc_id", "x.doc_key", "x.item_no", F.expr("x.s - x.at").alias("shift"),
                F.expr("abs(x.s - y.s)").alias("distance"))
        .groupBy("doc_id", "doc_key", "item_no", "shift")
        .agg(F.min("distance").alias("distance"))
    )
    near = stage(near, "near")
    aligned = near.where("distance = 0").select("doc_id", "doc_key", "item_no", "shift")
    return aligned, near


def _agreeing(docs: DataFrame, items: DataFrame, aligned: DataFrame) -> DataFrame:
    """``doc_id, doc_key, item_no, shift, j, n``: item positions the document agrees with."""
    held = aligned.select("doc_id", "doc_key").distinct()
    chosen = docs.alias("d").join(held.alias("h"), same_document("d", "h"), "left_semi")
    tokens = items.select("item_no", F.size("words").alias("n"),
                          F.posexplode("words").alias("j", "t"))
    postings = chosen.select(
        "doc_id", "doc_key", F.posexplode(words_of(F.col("text"))).alias("pos", "t")
    ).distinct()
    expected = aligned.join(tokens, "item_no").select(
        "*", (F.col("shift") + F.col("j")).alias("pos")
    )
    return (
        expected.alias("e")
        .join(
            postings.alias("p"),
            same_document("e", "p") & F.expr("e.pos = p.pos AND e.t = p.t"),
        )
        .select("e.doc_id", "e.doc_key", "e.item_no", "e.shift", "e.j", "e.n")
    )


def _stretches(agreeing: DataFrame, window: int) -> DataFrame:
    """The positions in unbroken stretches of a window or, for a short item, all of it."""
    one = ["doc_id", "doc_key", "item_no", "shift"]
    numbered = agreeing.withColumn(
        "run", F.col("j") - F.row_number().over(Window.partitionBy(*one).orderBy("j"))
    )
    size = F.count("*").over(Window.partitionBy(*one, "run"))
    return (
        numbered.withColumn("size", size)
        .where(F.col("size") >= F.least(F.lit(window), F.col("n")))
        .select("doc_id", "doc_key", "item_no", (F.col("shift") + F.col("j")).alias("pos"))
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> tuple[DataFrame, DataFrame]:
    """Exact matches ``doc_id, doc_key, item_id, pos``, one row per matched word of a
    document and item, and proximity matches ``doc_id, doc_key, item_id, distance``.

    Null texts have no words and match nothing, an item without words neither. Rows of
    ``docs`` that repeat id and text are one document; rows of ``benchmark`` that repeat
    are one item, rows that share an id but not the text are searched each. Null ids are
    ids. Other columns are ignored; empty tables give empty results.
    """
    source = keyed(docs, id_col, text_col)
    items = _items(benchmark, item_col, item_text_col)
    items = stage(items.withColumn("item_no", F.monotonically_increasing_id()), "items")
    windows = stage(
        _windows(items, window).withColumn("w", F.monotonically_increasing_id()), "windows"
    )
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    found = [
        _block(source, windows.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b))
        for b in range(blocks)
    ]
    aligned = reduce(DataFrame.union, [f[0] for f in found]).distinct()
    near = reduce(DataFrame.union, [f[1] for f in found])
    names = items.select("item_no", "item_id")
    exact = _stretches(_agreeing(source, items, stage(aligned, "aligned")), window)
    exact = exact.join(names, "item_no").select("doc_id", "doc_key", "item_id", "pos")
    close = (
        near.groupBy("doc_id", "doc_key", "item_no")
        .agg(F.min("distance").alias("distance"))
        .join(names, "item_no")
        .select("doc_id", "doc_key", "item_id", "distance")
    )
    return stage(exact.distinct(), "exact"), close


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``doc_id, doc_key, n_words, n_hit, items, n_near, contaminated`` for every row.

    ``items`` are the sorted ids, as text, of the items with a window in the document;
    ``n_near`` counts items whose rarest terms stand within a few words of their places.
    """
    exact, close = find_leaks(docs, benchmark, id_col, text_col, window=window)
    one = ["doc_id", "doc_key"]
    hits = exact.groupBy(*one).agg(
        F.count_distinct("pos").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    nears = close.groupBy(*one).agg(F.count_distinct("item_id").alias("n_near"))
    marks = hits.alias("h").join(nears.alias("c"), same_document("h", "c"), "full").select(
        F.coalesce("h.doc_id", "c.doc_id").alias("doc_id"),
        F.coalesce("h.doc_key", "c.doc_key").alias("doc_key"),
        "n_hit", "items", "n_near",
    )
    rows = keyed(docs, id_col, text_col).select(
        *one, F.size(words_of(F.col("text"))).cast("long").alias("n_words")
    )
    marked = rows.alias("r").join(
        stage(marks, "marks").alias("m"), same_document("r", "m"), "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0))
    return marked.select(
        "r.doc_id",
        "r.doc_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns."""
    exact, _ = find_leaks(docs, benchmark, id_col, text_col)
    hit = exact.select("doc_id", "doc_key").distinct()
    return join_on_document(docs, hit, "left_anti", id_col, text_col)
