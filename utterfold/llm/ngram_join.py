"""Jaccard join on word n-grams by rare-first prefixes.

If all shingles are put in one order, two sets of at least the wanted similarity share a
shingle among the first |set| - ceil(s |set|) + 1 of either: their prefixes. With rare
shingles first, prefixes hold what few others hold, and only sets that share a prefix
shingle are looked at. Of these pairs three filters drop those that cannot be similar:

* length: the smaller set has at least the wanted part of the larger one's size;
* position: what is common before, at and after the shingle that both share is enough;
* suffix: the sets differ in few enough shingles. Those that no other set has are
  differences; the others, before and after the shared one, are dealt into cells, and a
  cell that is odd in one set and even in the other holds a difference.

What is left is confirmed on the full sets, once per pair.

To order shingles by rarity they must be counted, and most sets resemble no other. So a
first round, in the order of the hashes, takes longer prefixes and asks of every set that
so many of them are shared as a similar set would have to share. Only sets that pass are
counted in full.

Documents with equal sets are one class. Links within a component add nothing to the
result, so a prefix shingle's holders are compared with one of them first, and afterwards
only across components. That one is the holder with the fewest shingles of its own, which
among near copies is the one nearest to all: a large group of them is no set of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import full_text, stage
from .graph import components
from .minhash import Shingler, _mixed
from .skew import count_keys, hot_keys, salted_join

#: Words of a shingle, and the least similarity of a link in percent.
WORDS, PERCENT = 4, 85
#: The first round's prefixes are longer by one shingle and by one in so many.
EXTRA = 20
#: A prefix shingle with more than this part of the open postings is joined in parts.
PAIR_SHARES = 32

_NO_ID = -(2**63)
#: Parities of the shingles before a position, and of those after it.
_BEFORE, _AFTER = ["q0"], ["p0", "p1", "p2", "p3"]
_POSTING = ["class", "size", "pos", "alone", *_BEFORE, *_AFTER]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.uint64).view(np.int64)))


def _hashed(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Set size, a 128-bit digest of the set and its first shingles by hash, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingler.shingles(t.as_py()) for t in part["text"]]
                sizes = np.array([len(s) for s in sets], np.int64)
                longest = sizes - (sizes * percent + 99) // 100 + sizes // EXTRA + 1
                digests = [
                    [s.sum(dtype=np.uint64) for s in sets],
                    [_mixed(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64) for s in sets],
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["doc_ref"],
                        part["doc_key"],
                        pa.array(sizes),
                        *[pa.array(np.array(d, np.uint64).view(np.int64)) for d in digests],
                        _lists([s[:n] for s, n in zip(sets, longest, strict=True)]),
                    ],
                    ["doc_id", "doc_ref", "doc_key", "n_shingles", "d1", "d2", "front"],
                )

    return texts.mapInArrow(
        run,
        "doc_id long, doc_ref long, doc_key long, n_shingles long, d1 long, d2 long, "
        "front array<long>",
    )


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``class, shingles`` from ``class, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = [shingler.shingles(t.as_py()) for t in part["text"]]
                yield pa.RecordBatch.from_arrays(
                    [part["class"], _lists(found)], ["class", "shingles"]
                )

    return texts.mapInArrow(run, "class long, shingles array<long>")


def _least_part(size: Column, percent: int) -> Column:
    """The least number of shingles that a set shares with any set similar to it."""
    return F.ceil(size * percent / 100).cast("int")


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """``class`` of the sets that share enough of their longer prefixes to have a partner.

    For sets of sizes m >= n that share o shingles, prefixes longer by k than the usual
    ones have at least k + 1 shingles in common. The smaller one's k counts, and it has
    no less than the wanted part of the size.
    """
    size = F.col("n_shingles")
    need = F.floor(_least_part(size, percent) / EXTRA) + 1
    index = classes.select(
        "class", need.cast("int").alias("need"), F.explode("front").alias("shingle")
    )
    counts = stage(count_keys(index, ["shingle"]).where("n > 1"), "front_counts")
    hot = hot_keys(counts, index.count(), ["shingle"])
    shared = salted_join(index, counts.select("shingle"), ["shingle"], F.col("class"), hot=hot)
    return (
        shared.groupBy("class", "need")
        .agg(F.count("*").alias("n"))
        .where("n >= need")
        .select("class")
    )


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """``class, size, alone, shared``: the shingles that others have too, rare ones first.

    ``alone`` counts the rest, which are the rarest of all and come before them. Sets that
    are all alone in their prefixes have no partner and are left out.
    """
    index = sets.select("class", F.explode("shingles").alias("shingle"))
    counts = stage(count_keys(index, ["shingle"]).where("n > 1"), "counts")
    hot = hot_keys(counts, index.count(), ["shingle"])
    sizes = sets.select("class", F.size("shingles").alias("size"))
    ordered = (
        salted_join(index, counts, ["shingle"], F.col("class"), hot=hot)
        .groupBy("class")
        .agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shared"))
        .join(sizes, "class")
        .withColumn("alone", F.col("size") - F.size("shared"))
    )
    return ordered.where(F.size("shared") >= _least_part(F.col("size"), percent)).select(
        "class", "size", "alone", F.col("shared.shingle").alias("shared")
    )


def _parities(hashes: np.ndarray, words: int) -> np.ndarray:
    """Per shingle, as ``words`` 64-bit numbers, the one cell that it falls in."""
    cell = _mixed(hashes) & np.uint64(64 * words - 1)
    single = np.zeros((len(hashes), words), np.uint64)
    bit = np.uint64(1) << (cell & np.uint64(63))
    single[np.arange(len(hashes)), (cell >> np.uint64(6)).astype(int)] = bit
    return single


def _prefixes(ordered: DataFrame, percent: int) -> DataFrame:
    """``shingle`` and the columns of ``_POSTING`` for each shared shingle of each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for name, size, alone, shared in zip(
                *(batch[c] for c in ("class", "size", "alone", "shared")), strict=True
            ):
                n, first = size.as_py(), alone.as_py()
                hashes = np.asarray(shared.values).view(np.uint64)
                front, back = _parities(hashes, len(_BEFORE)), _parities(hashes, len(_AFTER))
                before = np.bitwise_xor.accumulate(front, axis=0) ^ front
                after = np.bitwise_xor.accumulate(back[::-1], axis=0)[::-1] ^ back
                length = n - -(-n * percent // 100) + 1 - first
                row = np.zeros((length, 1 + len(_POSTING)), np.uint64)
                row[:, 0] = hashes[:length]
                row[:, 1:5] = np.array([name.as_py(), n, 0, first], np.uint64)
                row[:, 3] = np.arange(first, first + length)
                row[:, 5:] = np.concatenate([before, after], axis=1)[:length]
                parts.append(row)
            if parts:
                columns = np.concatenate(parts).view(np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(c)) for c in columns], ["shingle", *_POSTING]
                )

    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in ["shingle", *_POSTING]))


def _possible(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filter for two rows of ``_prefixes`` with one shingle."""

    def of(name: str) -> tuple[Column, Column]:
        return F.col(f"{x}.{name}"), F.col(f"{y}.{name}")

    def odd(names: list[str]) -> Column:
        return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in map(of, names)), F.lit(0))

    (m, n), (i, j), (own, other) = of("size"), of("pos"), of("alone")
    length = F.least(m, n) * 100 >= F.greatest(m, n) * percent
    # overlap * (100 + percent) >= (m + n) * percent says that the similarity is reached
    common = F.least(i - own, j - other) + F.least(m - i, n - j)
    position = common * (100 + percent) >= (m + n) * percent
    before = F.greatest(F.abs((i - own) - (j - other)), odd(_BEFORE))
    differ = own + other + before + odd(_AFTER)
    suffix = (m + n - differ) * (100 + percent) >= (m + n) * percent * 2
    return length & position & suffix


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, overlap`` of the stored pairs ``a, b`` whose full sets are similar enough."""
    total = pairs.count()
    for side, other in (("a", "b"), ("b", "a")):
        hot = hot_keys(count_keys(pairs.select("a", "b"), [side]), total, [side])
        named = sets.select(F.col("class").alias(side), F.col("shingles").alias(f"s_{side}"))
        # the pairs are few columns at first, and carry one set in the second join
        wide = pairs if side == "a" else joined
        joined = salted_join(wide, named, [side], F.col(other), hot=hot)
    overlap = F.size(F.array_intersect("s_a", "s_b"))
    either = F.size("s_a") + F.size("s_b") - overlap
    links = joined.select("a", "b", overlap.alias("overlap"), either.alias("either"))
    return stage(
        links.where("overlap * 100L >= either * %dL" % percent).select("a", "b", "overlap"), "links"
    )


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Add ``root``: the component so far, a class without links being its own."""
    return members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class")
    )


def _hub_pairs(index: DataFrame, percent: int) -> DataFrame:
    """``a, b``: each holder of a prefix shingle with the one that has the least of its own."""
    counts = index.groupBy("shingle").agg(
        F.count("*").alias("n"), F.min(F.struct("alone", F.struct(*_POSTING))).alias("hub")
    )
    hubs = stage(counts.where("n > 1").select("shingle", "n", F.col("hub.col2").alias("y")), "hubs")
    hot = hot_keys(hubs, index.count(), ["shingle"])
    left = index.select("shingle", F.struct(*_POSTING).alias("x"))
    met = salted_join(left, hubs.select("shingle", "y"), ["shingle"], F.col("x.class"), hot=hot)
    return (
        met.where((F.col("x.class") != F.col("y.class")) & _possible("x", "y", percent))
        .select(
            F.greatest("x.class", "y.class").alias("a"), F.least("x.class", "y.class").alias("b")
        )
        .distinct()
    )


def _pairs_across(index: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``a, b``: holders of one prefix shingle that are in different components.

    They are looked at two by two, and only those that pass all filters leave the join.
    """
    rooted = stage(_rooted(index, roots), "rooted")
    mixed = (
        rooted.groupBy("shingle")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        .where("low != high")
    )
    mixed = stage(mixed.select("shingle", "n"), "mixed")
    hot = hot_keys(mixed, rooted.count(), ["shingle"])
    open_ = stage(
        salted_join(rooted, mixed.select("shingle"), ["shingle"], F.col("class"), hot=hot), "open"
    )
    # both sides grow with a hot shingle here, so its holders are dealt into few parts
    hot = hot_keys(mixed, open_.count(), ["shingle"], PAIR_SHARES)
    row = F.struct("root", *_POSTING)
    x, y = open_.select("shingle", row.alias("x")), open_.select("shingle", row.alias("y"))
    met = salted_join(x, y, ["shingle"], F.col("x.class"), hot=hot)
    return (
        met.where((F.col("x.root") < F.col("y.root")) & _possible("x", "y", percent))
        .select(
            F.greatest("x.class", "y.class").alias("a"), F.least("x.class", "y.class").alias("b")
        )
        .distinct()
    )


def _classes(
    docs: DataFrame, id_col: str, text_col: str, words: int, percent: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, a row per document with its set's digest, and the distinct sets."""
    doc_id = F.col(f"`{id_col}`").cast("long")
    text = full_text(text_col)
    texts = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(_NO_ID)).alias("doc_ref"),
        F.xxhash64(text).alias("doc_key"),
        text.alias("text"),
    )
    rows = stage(_hashed(texts, words, percent), "hashed")
    classes = (
        rows.where("n_shingles > 0")
        .groupBy("n_shingles", "d1", "d2")
        .agg(
            F.min(F.struct("doc_ref", "doc_key")).alias("ref"),
            F.min("doc_id").alias("least_id"),
            F.count("*").alias("n"),
            F.any_value("front").alias("front"),
        )
        .withColumn("class", F.monotonically_increasing_id())
    )
    return texts, rows.drop("front", "doc_ref", "doc_key"), stage(classes, "classes")


def _links(
    texts: DataFrame, classes: DataFrame, words: int, percent: int
) -> DataFrame:
    """``a, b, overlap``: links between classes that connect all similar ones."""
    wanted = _candidates(classes, percent).join(classes, "class").select("class", "ref.*")
    met = texts.join(wanted, ["doc_ref", "doc_key"]).dropDuplicates(["doc_ref", "doc_key"])
    sets = stage(_sets(met.select("class", "text"), words), "sets")
    index = stage(_prefixes(_rare_first(sets, percent), percent), "prefixes")

    tried = stage(_hub_pairs(index, percent), "pairs")
    links = _confirmed(tried, sets, percent)
    roots = stage(components(links), "roots")
    across = stage(_pairs_across(index, roots, percent), "across")
    open_ = stage(across.join(tried, ["a", "b"], "left_anti"), "pairs")
    return links.union(_confirmed(open_, sets, percent))


def joined_sets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> tuple[DataFrame, DataFrame]:
    """Links between distinct sets, and which documents have which set.

    The first table is ``a, b, overlap``: numbers of linked sets and how many shingles they
    share. It connects all similar sets; of links within a component it may hold only some.
    The second is ``doc_id, n_shingles, set_id, component_id``, one row per row of ``docs``;
    ``set_id`` is null for a text without words. See ``similar_documents`` for the rules.
    """
    texts, rows, classes = _classes(docs, id_col, text_col, words, percent)
    links = stage(_links(texts, classes, words, percent), "all_links")
    same = ["n_shingles", "d1", "d2"]
    named = _rooted(classes.select("class", "least_id", "n", *same), components(links))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_set = stage(named.join(least, "root").select(*same, "class", "component_id", "n"), "of_set")
    hot = hot_keys(of_set, rows.count(), same)
    found = salted_join(
        rows, of_set.drop("n"), same, F.coalesce("doc_id", F.lit(_NO_ID)), "left", hot
    )
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.col("component_id")
    )
    return links, found.select(
        "doc_id", "n_shingles", F.col("class").alias("set_id"), component.alias("component_id")
    )


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A document's set holds its distinct shingles of ``words`` words; a text with fewer is
    one shingle, one without words, or null, has an empty set and is linked with nothing.
    ASCII letters are lower-cased; words are what stands between ASCII white space. Two
    documents link if they share ``percent`` of the shingles of both. ``component_id`` is
    the least id in the row's component, null ids apart, and null if all of them are. Rows
    with equal sets are linked, repeated rows too. Other columns are ignored; an empty
    table gives an empty result.
    """
    _, members = joined_sets(docs, id_col, text_col, words, percent)
    return members.drop("set_id")
