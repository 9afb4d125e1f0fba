"""How filters interact: what each would remove alone, in any order, and needlessly.

Five filters are judged once per document and packed into a mask of five bits. All
figures for all 120 orders are sums over masks, so the documents are reduced to counts
per part, mask and labels, and the orders are worked out on those few rows.

The filter on repeated texts is the only one that looks at other documents. A counting
Bloom sketch is made first: every text counts up two cells, tasks merge their cells, and
of the merged sketch one bit per cell stays, set where the count is two or more. A text
with a cell of count one stands once in the table and is cleared without a shuffle. The
others are grouped by their whole text for the least id; a false alarm costs a shuffled
row and changes nothing.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import full_text, stage
from .skew import salted_join

LETTERS = "ABCDE"
#: Least number of words (A), and percentages for distinct words (B) and capitals (C).
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
_SYMBOLS = "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = "[\\x20\\x09-\\x0D]+"

#: Cells per row, and the most cells of a sketch. One bit of a cell is broadcast, so 16 MB
#: at most. Beyond 16 million documents the sketch clears fewer texts; results are the same.
CELLS_PER_ROW, MAX_CELLS = 8, 1 << 27
_BUCKET = 1 << 15


def _cells(text: Column, cells: int) -> tuple[Column, Column]:
    """Two places in a sketch whose size is a power of two, from one 64-bit hash."""
    h = F.xxhash64(text)
    last = F.lit(cells - 1).cast("long")
    return h.bitwiseAND(last), F.shiftrightunsigned(h, 32).bitwiseAND(last)


def sketch_size(n_rows: int) -> int:
    wanted = max(_BUCKET, CELLS_PER_ROW * n_rows)
    return min(MAX_CELLS, 1 << (wanted - 1).bit_length())


def repeat_sketch(texts: DataFrame, cells: int) -> DataFrame:
    """``bucket, bits``: a bit per cell that two rows or more count up.

    Cells are counted in each task and the counts merged; 32768 cells make one row of
    4 KB, so the table has at most ``cells / 8`` bytes.
    """
    counted = (
        texts.select(F.explode(F.array(*_cells(F.col("text"), cells))).alias("cell"))
        .groupBy("cell")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    bucket = F.shiftright("cell", 15)
    return counted.groupBy(bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit(_BUCKET - 1))).alias("bits")
    )


def _is_set(bits: Column, cell: Column) -> Column:
    at = cell.bitwiseAND(F.lit(_BUCKET - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10)
    shifted = F.call_function("shiftright", byte.cast("int"), at.bitwiseAND(F.lit(7)))
    return F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(False))


def with_possible_repeats(texts: DataFrame, sketch: DataFrame, cells: int) -> DataFrame:
    """Add ``possible``: false only for a text that no other row has."""
    first, second = _cells(F.col("text"), cells)
    found = texts.withColumns({"_c1": first, "_c2": second})
    for i in (1, 2):
        side = sketch.select(F.col("bucket").alias(f"_b{i}"), F.col("bits").alias(f"_bits{i}"))
        found = found.join(
            F.broadcast(side), F.shiftright(f"_c{i}", 15) == F.col(f"_b{i}"), "left"
        )
    both = [_is_set(F.col(f"_bits{i}"), F.col(f"_c{i}")) for i in (1, 2)]
    return found.withColumn("possible", both[0] & both[1]).drop(
        *[f"{name}{i}" for name in ("_c", "_b", "_bits") for i in (1, 2)]
    )


def _own_mask(text: Column) -> Column:
    """The bits of the four filters that look at one text alone."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    n_chars = F.char_length(text)
    n_capitals = n_chars - F.char_length(F.translate(text, _CAPITALS, ""))
    fails = [
        n_words < LEAST_WORDS,
        n_distinct.cast("long") * 100 < n_words.cast("long") * DISTINCT_PERCENT,
        n_capitals.cast("long") * 100 > n_chars.cast("long") * CAPITALS_PERCENT,
        text.rlike(_SYMBOLS),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def filter_masks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """``doc_id, part, mask`` per row: bit i is set if the row fails filter ``LETTERS[i]``.

    Null text is empty text, a null part the empty string. A repeated text fails E unless
    its id is the least of all rows with that text; rows that share the least id all pass.
    A null id neither fails E nor makes others fail.
    """
    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        full_text(text_col).alias("text"),
    )
    cells = sketch_size(source.count())
    sketch = stage(repeat_sketch(source.select("text"), cells), "repeat_sketch")
    possible = F.col("possible")
    judged = stage(
        with_possible_repeats(source, sketch, cells).select(
            "doc_id",
            "part",
            _own_mask(F.col("text")).alias("mask"),
            F.when(possible, F.unhex(F.sha2("text", 256))).alias("digest"),
            F.when(possible, F.col("text")).alias("text"),
        ),
        "judged",
    )
    least = (
        judged.where(F.col("digest").isNotNull())
        .groupBy("text")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
        .where("last > least")
        .select(F.unhex(F.sha2("text", 256)).alias("digest"), "least")
    )
    rows = judged.select("doc_id", "part", "mask", "digest")
    repeats = salted_join(
        rows.where(F.col("digest").isNotNull()), least, ["digest"], F.col("doc_id"), "left"
    )
    last_bit = F.lit(1 << (len(LETTERS) - 1))
    fails = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return (
        rows.where(F.col("digest").isNull())
        .select("doc_id", "part", "mask")
        .union(
            repeats.select(
                "doc_id", "part", F.when(fails, F.col("mask") + last_bit).otherwise(F.col("mask"))
            )
        )
    )


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and mask, and how many are labelled.

    ``labels`` has ``doc_id, quality, toxic``. An id with several labels is good if one says
    quality 1, and toxic if one says toxic 1; an id without label is neither,
    and so is a null id.
    """
    known = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"),
    )
    # counted before the join: rows that repeat an id meet its label as one row
    per_id = (
        filter_masks(docs, id_col, text_col, part_col)
        .groupBy("doc_id", "part", "mask")
        .agg(F.count("*").alias("n"))
    )
    n = F.col("n")
    return (
        per_id.join(known, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.sum(n).alias("n"),
            F.sum(n * F.coalesce("is_good", F.lit(0))).alias("good"),
            F.sum(n * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
        )
    )


def _steps() -> Column:
    """Every step of every order: its filter's bit and the mask of the filters before it."""
    bits = {letter: 1 << i for i, letter in enumerate(LETTERS)}
    steps = []
    for order in itertools.permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, start=1):
            steps.append(
                {"filter_order": "".join(order), "step": step, "bit": bits[letter], "gone": before}
            )
            before |= bits[letter]
    return F.from_json(
        F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,gone:int>>"
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """What each filter does at each step of each of the 120 orders, per part.

    One row per part, ``filter_order`` and ``step``: ``kept`` documents after the step,
    ``removed`` by it, ``redundant`` ones that fail its filter but were removed before,
    ``unique_fails`` that fail its filter and no other, ``good_lost`` and ``toxic_lost``
    among the removed, and ``shapley``: what the filter removes, summed over all orders.
    Parts are those that occur; an empty table has none. Repeated rows count each time.
    Other columns are ignored. See ``filter_masks`` for nulls and ties.
    """
    counts = stage(mask_counts(docs, labels, id_col, text_col, part_col), "mask_counts")
    rows = counts.select("*", F.inline(_steps()))
    mask, bit, gone = F.col("mask"), F.col("bit"), F.col("gone")
    fails = mask.bitwiseAND(bit) != 0
    reached = mask.bitwiseAND(gone) == 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0))).cast("long").alias(value)

    # of the filters that a document fails each comes first in an equal part of the orders
    share = F.expr("n * (120 div nullif(bit_count(mask), 0))")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )
