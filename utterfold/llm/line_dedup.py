"""Repeated runs of lines by hashes of windows.

Each line is hashed, and each ``window`` consecutive lines by the hashes of all of them.
No winnowing is done: no window is skipped, none is extended. A window that stands at an
earlier place as well marks its lines; longer runs are the union of their windows.
Windows of fewer lines count alike if they hold many words, so a long passage on one or
two lines is found as well.

Only hashes and positions are shuffled, dealt by all that a window holds, so a line that
stands in a third of all places spreads over its windows. Dealing by the least line hash of
a window instead gathers such a line's windows in one place. Windows alike are reduced to
their first place before the shuffle; those that occur once leave there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, full_text, join_on_document, keyed, same_document, stage

#: Lines of the shortest run that is removed whatever it holds.
WINDOW = 3
#: A run of fewer lines is removed if it holds more words than this.
MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, window: int, min_words: int | None) -> DataFrame:
    """``doc_id, doc_key, start, size, digest`` per window, with all its lines in 128 bits."""
    lines = docs.select("doc_id", "doc_key", _lines(F.col("text")).alias("lines"))
    if min_words is None:
        lines = lines.where(F.size("lines") >= window)
    hashed = lines.select(
        "doc_id",
        "doc_key",
        F.transform("lines", lambda x: F.unhex(F.md5(x))).alias("h"),
        F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("words"),
    )

    def of_size(size: int) -> Column:
        def held(i: Column) -> Column:
            inside = i + (size - 1) <= F.size("h")
            if size == window:
                return inside
            words = sum((F.get("words", i + (j - 1)) for j in range(size)), F.lit(0))
            return inside & (words > min_words)

        starts = F.sequence(F.lit(1), F.greatest(F.size("h") - (size - 1), F.lit(1)))
        return F.transform(
            F.filter(starts, held),
            lambda i: F.struct(
                (i - 1).alias("start"), F.lit(size).alias("size"), F.slice("h", i, size).alias("w")
            ),
        )

    sizes = [window] if min_words is None else range(1, window + 1)
    starts = hashed.select(
        "doc_id", "doc_key", F.explode(F.concat(*map(of_size, sizes))).alias("at")
    ).select("doc_id", "doc_key", "at.*")
    return starts.select(
        "doc_id",
        "doc_key",
        "start",
        "size",
        F.unhex(
            F.md5(F.concat(*[F.coalesce(F.get("w", F.lit(i)), F.lit(b"")) for i in range(window)]))
        ).alias("digest"),
    )


def repeated_lines(
    docs: DataFrame, window: int = WINDOW, min_words: int | None = MIN_WORDS
) -> DataFrame:
    """``doc_id, doc_key, start, size``: windows that also start earlier, for ``keyed`` docs.

    Earlier is a smaller id (null least), for one id a smaller key, and in one
    document an earlier line. A row that repeats gives its windows again.
    """
    windows = stage(_windows(docs, window, min_words), "windows")
    place = F.struct("doc_id", "doc_key", "start")
    alike = ["digest", "size"]
    first = (
        windows.groupBy(*alike)
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .drop("last")
    )
    return (
        windows.join(first, alike)
        .where(F.struct("doc_id", "doc_key", "start") > F.col("first"))
        .select("doc_id", "doc_key", "start", "size")
    )


def _marks(source: DataFrame, window: int, min_words: int | None) -> DataFrame:
    """``doc_id, doc_key, starts``: sorted start and size of repeated windows per document.

    Marks grow with the documents, so texts meet them in a sort-merge join at every size.
    """
    marks = (
        repeated_lines(source, window, min_words)
        .groupBy("doc_id", "doc_key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("starts"))
    )
    return stage(marks, "line_marks").hint("merge")


def _covered(starts: Column) -> Column:
    """The lines that lie in a window, once each, in order."""
    return F.array_distinct(
        F.flatten(F.transform(starts, lambda s: F.sequence(s.start, s.start + s.size - 1)))
    )


def _without(lines: Column, gone: Column) -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    min_words: int | None = MIN_WORDS,
) -> DataFrame:
    """``doc_id, doc_key, text, n_lines, n_removed, n_runs`` for every row of ``docs``.

    Lines are what stands between line feeds. A line goes if it lies in a run of
    at least ``window`` lines, or of fewer that hold more than ``min_words`` words
    together, that also starts at an earlier place; ``n_runs`` counts the removed
    stretches, ``text`` holds the lines left. Words are what stands between ASCII
    white space. Without ``min_words`` only the number of lines counts. Runs are
    judged on the input, and overlaps count. Null
    text is empty text, an empty text is one empty line. Rows that repeat id and
    text are one document and get the same result. Other columns are ignored.
    """
    source = keyed(docs, id_col, text_col)
    joined = source.alias("d").join(
        _marks(source, window, min_words).alias("m"), same_document("d", "m"), "left"
    )
    lines = joined.select(
        "d.doc_id",
        "d.doc_key",
        "d.text",
        _lines(F.col("d.text")).alias("lines"),
        _covered(F.col("starts")).alias("gone"),
    )
    untouched = F.col("gone").isNull()
    # A stretch begins where the line before is not covered.
    begins = F.size(F.array_except("gone", F.transform("gone", lambda p: p + 1)))
    return lines.select(
        "doc_id",
        "doc_key",
        F.when(untouched, F.col("text"))
        .otherwise(_without(F.col("lines"), F.col("gone")))
        .alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(untouched, F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(untouched, F.lit(0)).otherwise(begins).cast("long").alias("n_runs"),
    )


def with_lines_cut(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = "n_chars",
    window: int = WINDOW,
    min_words: int | None = MIN_WORDS,
    drop_emptied: bool = False,
) -> DataFrame:
    """``docs`` with the same rows and columns and the texts that ``dedup_lines`` gives.

    ``length_col``, if there, counts the characters of a text that has changed. With
    ``drop_emptied`` rows go whose text had something and is left with nothing: all of it
    stands elsewhere. Rows that were empty before stay.
    """
    text = F.col(f"`{text_col}`")
    at, new = free_name("_starts", docs), free_name("_text", docs)
    marks = _marks(keyed(docs, id_col, text_col), window, min_words).withColumnRenamed("starts", at)
    joined = join_on_document(docs, marks, "left", id_col, text_col)
    starts = F.col(at)
    cut = F.when(starts.isNull(), text).otherwise(
        _without(_lines(text), _covered(starts))
    )
    joined = joined.withColumn(new, cut)
    if drop_emptied:
        emptied = starts.isNotNull() & (F.col(new) == "") & (full_text(text_col) != "")
        joined = joined.where(~emptied)

    def column(name: str) -> Column:
        if name == text_col:
            return F.col(new).alias(name)
        if name == length_col:
            kind = docs.schema[name].dataType
            changed = F.char_length(new).cast(kind)
            return F.when(starts.isNull(), F.col(f"`{name}`")).otherwise(changed).alias(name)
        return F.col(f"`{name}`")

    return joined.select(*map(column, docs.columns))
