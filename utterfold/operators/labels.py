"""Label algebra: unpack, map, encode, regroup, decode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MULTICLASS, check_task
from ..functions.vectors import multi_hot
from ..session import cut_lineage
from .lookup import dictionary_join, free_name


def _named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col(f"`{column}`")


def label_parts(col: Column, delim: str = "+") -> Column:
    """Parts of a combined label; the delimiter is literal, empty parts stay."""
    if not delim:
        raise ValueError("the delimiter must not be empty")
    return F.split(col, "\\Q" + delim.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def canonical_label(col: Column, delim: str = "+") -> Column:
    """Combined label with its parts sorted, so ``b+a`` equals ``a+b``."""
    return F.array_join(F.array_sort(label_parts(col, delim)), delim)


def unpack_labels(
    df: DataFrame, label_col: str = "label", delim: str = "+", null_label: str | None = None
) -> DataFrame:
    """One row per label part.

    A null label stays one null row; ``null_label="empty"`` makes it the empty
    label instead.
    """
    if null_label not in (None, "empty"):
        raise ValueError("null_label must be None or 'empty'")
    label = _named(label_col).cast("string")
    if null_label == "empty":
        label = F.coalesce(label, F.lit(""))
    parts = F.explode_outer(label_parts(label, delim)).alias(label_col)
    return df.select(*[parts if name == label_col else _named(name) for name in df.columns])


def bounded_map(label_map: DataFrame, max_labels: int) -> DataFrame:
    """The same map, failing the query if it has more than ``max_labels`` rows.

    At most one row more than that reaches the task that counts them.
    """
    limited = label_map.select("label", F.col("label_id").cast("int")).limit(max_labels + 1)
    too_many = F.count("*").over(Window.partitionBy()) > max_labels
    label_id = F.when(
        too_many,
        F.raise_error(F.lit(f"more than {max_labels} labels; raise max_labels")).cast("int"),
    ).otherwise(F.col("label_id"))
    return limited.select("label", label_id.alias("label_id"))


def build_label_map(
    df: DataFrame, label_col: str = "label", max_labels: int | None = None
) -> DataFrame:
    """``label, label_id``: distinct labels in ascending order, ids from 0.

    Runs at once and stores the map. Labels are sorted in ranges, each by a task of its
    own and numbered there; the ids of a range begin where the ranges before it end. With
    ``max_labels`` a longer map is an error.
    """
    distinct = (
        df.select(_named(label_col).cast("string").alias("label"))
        .filter(F.col("label").isNotNull())
        .distinct()
    )
    ordered = distinct.repartitionByRange("label").sortWithinPartitions("label")
    # the range in the upper bits, the place in it in the lower 33
    placed = cut_lineage(ordered.select("label", F.monotonically_increasing_id().alias("place")))
    in_range, rank = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range
    ranges = placed.groupBy(in_range.alias("range")).agg(F.count("*").alias("n"))
    offsets = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.join(F.broadcast(offsets), in_range == F.col("range")).select(
        "label", (F.col("offset") + rank).cast("int").alias("label_id")
    )
    return numbered if max_labels is None else bounded_map(numbered, max_labels)


def invert_label_map(label_map: DataFrame) -> DataFrame:
    """The same map with the id first."""
    return label_map.select("label_id", "label")


def label_count(label_map: DataFrame) -> Column:
    """Number of labels, as a scalar subquery."""
    return label_map.agg(F.count("*").cast("int")).scalar()


def label_names(label_map: DataFrame) -> Column:
    """Array of names by id as a scalar subquery; null where an id is missing."""
    entries = F.map_from_entries(F.collect_list(F.struct("label_id", "label")))
    filled = label_map.agg(
        entries.alias("names"), F.coalesce(F.max("label_id"), F.lit(-1)).alias("top")
    )
    positions = F.when(F.col("top") >= 0, F.sequence(F.lit(0), F.col("top"))).otherwise(
        F.array().cast("array<int>")
    )
    return filled.select(
        F.transform(positions, lambda i: F.try_element_at(F.col("names"), i)).alias("names")
    ).scalar()


def _by_label(label_map: DataFrame, name: str) -> DataFrame:
    return label_map.select("label", F.col("label_id").cast("int").alias(name))


def encode_multiclass(
    df: DataFrame, label_map: DataFrame, label_col: str = "label", out: str = "labels"
) -> DataFrame:
    """Label id per row; rows whose label is not in the map are dropped."""
    found = free_name("_id", df)
    joined = dictionary_join(df, _by_label(label_map, found), label_col)
    return joined.select(*map(_named, df.columns), F.col(found).alias(out))


def unseen_labels(df: DataFrame, label_map: DataFrame, label_col: str = "label") -> DataFrame:
    """``label, n_rows`` of the labels the map lacks."""
    counts = (
        df.filter(_named(label_col).isNotNull())
        .groupBy(_named(label_col).cast("string").alias("label"))
        .agg(F.count("*").alias("n_rows"))
    )
    # counted first, so no label is hot
    return counts.join(label_map.select("label"), "label", "left_anti")


def content_id(text: Column) -> Column:
    """128 bits that stand for a text as a key."""
    return F.unhex(F.md5(text))


def _one_text(text_col: str) -> list[Column]:
    """The text of a group of equal content ids, and what shows that there is just one."""
    marks = F.xxhash64(F.col("_text"))
    return [
        F.any_value("_text").alias(text_col),
        F.min(marks).alias("_low"),
        F.max(marks).alias("_high"),
    ]


def _checked(grouped: DataFrame) -> DataFrame:
    clash = F.raise_error(F.lit("two texts share a content id")).cast("boolean")
    same = F.when(F.col("_low") != F.col("_high"), clash).otherwise(F.lit(True))
    return grouped.filter(same).drop("_low", "_high")


def _identified(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``_content, _text, _label`` of the rows with a text."""
    text = _named(text_col)
    return df.filter(text.isNotNull()).select(
        content_id(text.cast("string")).alias("_content"),
        text.alias("_text"),
        _named(label_col).alias("_label"),
    )


def regroup_labels(
    df: DataFrame, text_col: str = "text", label_col: str = "label", repeats: bool = False
) -> DataFrame:
    """One row per distinct text with its sorted label list; null texts fall out.

    Texts are grouped by their content ids, so a text is moved as a value, once per task,
    and never compared or hashed again. Equal labels of one text collapse before the
    shuffle, so a text that fills much of the corpus never builds a long list.
    ``repeats=True`` adds ``label_counts``, how often each label occurred;
    :func:`expand_repeats` turns both into the list with repeats.
    """
    known = _identified(df, text_col, label_col)
    if not repeats:
        labels = F.sort_array(F.collect_set("_label")).alias("label_list")
        grouped = known.groupBy("_content").agg(*_one_text(text_col), labels)
        return _checked(grouped).drop("_content")
    counted = known.groupBy("_content", "_label").agg(
        F.count("*").alias("n"), F.any_value("_text").alias("_text")
    )
    pairs = F.sort_array(
        F.collect_list(
            F.when(F.col("_label").isNotNull(), F.struct(F.col("_label").alias("label"), "n"))
        )
    )
    grouped = counted.groupBy("_content").agg(*_one_text(text_col), pairs.alias("_pairs"))
    return _checked(grouped).select(
        _named(text_col),
        F.col("_pairs.label").alias("label_list"),
        F.col("_pairs.n").alias("label_counts"),
    )


def expand_repeats(label_list: Column, label_counts: Column) -> Column:
    """The label list with every label repeated as often as it occurred."""
    return F.flatten(
        F.zip_with(label_list, label_counts, lambda name, n: F.array_repeat(name, n.cast("int")))
    )


def encode_multilabel(
    df: DataFrame,
    label_map: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    out: str = "labels",
) -> DataFrame:
    """One multi-hot float vector per distinct text.

    Labels outside the map are ignored, so a text may get an all-zero vector.
    Only ids are grouped: at most one per known label and text.
    """
    return encode_with_content(df, label_map, text_col, label_col, out).drop(CONTENT)


#: Column of :func:`encode_with_content` that identifies a text.
CONTENT = "content_id"


def encode_with_content(
    df: DataFrame,
    label_map: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    out: str = "labels",
) -> DataFrame:
    """:func:`encode_multilabel` with the content id, which may serve as the key of a split.

    Texts are grouped by it and shuffled once, as values.
    """
    known = _identified(df, text_col, label_col)
    with_ids = dictionary_join(known, _by_label(label_map, "_id"), "_label", "left")
    grouped = with_ids.groupBy("_content").agg(
        *_one_text(text_col), F.collect_set("_id").alias("_ids")
    )
    # the count is a column of its own: no subquery inside a lambda
    return (
        _checked(grouped)
        .withColumn("_width", label_count(label_map))
        .select(
            _named(text_col),
            multi_hot(F.col("_ids"), F.col("_width")).alias(out),
            F.lower(F.hex("_content")).alias(CONTENT),
        )
    )


def prepare_labels(
    df: DataFrame,
    task: str,
    label_map: DataFrame | None = None,
    text_col: str = "text",
    label_col: str = "label",
) -> tuple[DataFrame, DataFrame]:
    """``(text, labels)`` ready for training and the label map used.

    Test data must pass the training map.
    """
    check_task(task)
    if label_map is None:
        label_map = build_label_map(df, label_col)
    if task == MULTICLASS:
        prepared = encode_multiclass(df, label_map, label_col).select(text_col, "labels")
    else:
        prepared = encode_multilabel(df, label_map, text_col, label_col)
    return prepared, label_map
