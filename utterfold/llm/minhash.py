"""Near duplicates by MinHash with tensored banding.

Two small collections of half keys are computed per document, each half key from two
minhashes. Every pair of a half key from either collection is one table's key: twelve
and twelve half keys make 144 tables of four minhashes each from 48 minhashes instead
of 576. Documents that meet in a table are candidates; a link counts only if the full
shingle sets confirm it.

Documents with the same shingle set are one class from the start, so exact and
reordered copies cost one row. A class whose half keys nobody shares leaves before the
tables are made. In each table members are compared with the table's least class. Who
then still shares a table with another component is compared across components, where
the rarest shingles of both sets agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text, join_on_document, stage
from .graph import components

#: Words of a shingle, and the least similarity of a link in percent.
WORDS, PERCENT = 5, 75
#: Half keys of each collection. A pair at 75 % similarity meets in no table with a
#: probability of 1e-4: both collections need one equal half key, each is equal with 0.56.
HALVES = 12
#: Candidates with fewer equal minhashes of the 48 are not compared in full. At 75 %
#: similarity 36 are expected; fewer than 20 have a probability under 1e-6.
LEAST_EQUAL = 20
#: A shingle in more sets than this is common and comes last in prefixes.
RARE = 8

_HASHES = 4 * HALVES
_NO_ID = -(2**63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's distinct word shingles, and minhashes of such sets."""

    #: Bytes that are hashed at once.
    PIECE = 1 << 20
    _BASE = 0x9E3779B97F4A7C15 | 1
    _STEP = np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, words: int = WORDS):
        self.words = words
        space = np.zeros(256, dtype=bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        self._space = space
        self._lower = np.arange(256, dtype=np.uint8)
        self._lower[65:91] += 32
        self._powers = self._inverses = np.ones(1, dtype=np.uint64)
        seeds = _mixed(np.arange(1, 2 * _HASHES + 1, dtype=np.uint64))
        self._xor, self._odd = seeds[:_HASHES, None], seeds[_HASHES:, None] | np.uint64(1)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, 2 * len(self._powers))
            inverse = pow(self._BASE, -1, 1 << 64)
            for name, base in (("_powers", self._BASE), ("_inverses", inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _word_hashes(self, raw: np.ndarray) -> np.ndarray:
        inside = ~self._space[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        self._grow(len(raw) + 1)
        letters = self._lower[raw].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(letters * self._powers[: len(raw)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self._inverses[starts]
        return _mixed(hashes + (ends - starts).astype(np.uint64))

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes; of a shorter text one for all its words."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + self.PIECE)
            while end < len(raw) and not self._space[raw[end]]:
                spaces = np.flatnonzero(self._space[raw[end : end + self.PIECE]])
                end = end + int(spaces[0]) if len(spaces) else min(len(raw), end + self.PIECE)
            parts.append(self._word_hashes(raw[at:end]))
            at = end
        words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        size = min(self.words, len(words))
        if not size:
            return words
        out = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for i in range(size):
            out = out * self._STEP + words[i : len(words) - size + 1 + i]
        return np.unique(_mixed(out + np.uint64(size)))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 4096):
            part = (shingles[None, at : at + 4096] ^ self._xor) * self._odd
            np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=1), out=least)
        return least


_SIGNED = (
    "doc_id long, doc_ref long, doc_key long, n_shingles long, d1 long, d2 long, "
    "halves array<long>, minima array<int>"
)


def _signed(texts: DataFrame) -> DataFrame:
    """Set size, a 128-bit digest of the set, half keys and minhashes per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        tag = _mixed(np.arange(2 * HALVES, dtype=np.uint64) + np.uint64(977))
        for batch in batches:
            n = len(batch)
            sizes = np.zeros(n, dtype=np.int64)
            digests = np.zeros((2, n), dtype=np.uint64)
            halves = np.zeros((n, 2 * HALVES), dtype=np.uint64)
            minima = np.zeros((n, _HASHES), dtype=np.uint64)
            for i, text in enumerate(batch["text"]):
                shingles = shingler.shingles(text.as_py())
                sizes[i] = len(shingles)
                digests[0, i] = shingles.sum(dtype=np.uint64)
                digests[1, i] = _mixed(shingles ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)
                minima[i] = shingler.minima(shingles)
            halves = _mixed(_mixed(minima[:, ::2] + tag) ^ minima[:, 1::2])

            def lists(values: np.ndarray, width: int, rows: int = n) -> pa.Array:
                offsets = np.arange(0, rows * width + 1, width, dtype=np.int32)
                return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))

            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["doc_ref"],
                    batch["doc_key"],
                    pa.array(sizes),
                    pa.array(digests[0].view(np.int64)),
                    pa.array(digests[1].view(np.int64)),
                    lists(halves.view(np.int64), 2 * HALVES),
                    lists((minima >> np.uint64(32)).astype(np.uint32).view(np.int32), _HASHES),
                ],
                [c.split()[0] for c in _SIGNED.split(", ")],
            )

    return texts.mapInArrow(run, _SIGNED)


def _sets(texts: DataFrame) -> DataFrame:
    """``class, shingles`` from ``class, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = [shingler.shingles(t.as_py()) for t in part["text"]]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part["class"], pa.ListArray.from_arrays(offsets, values)],
                    ["class", "shingles"],
                )

    return texts.mapInArrow(run, "class long, shingles array<long>")


def _tables(classes: DataFrame) -> DataFrame:
    """``key, class``: the tables that hold two classes or more."""
    halves = classes.select("class", F.posexplode("halves").alias("i", "half"))
    shared = halves.groupBy("i", "half").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    left = F.col("i") < HALVES
    sides = (
        halves.join(shared, ["i", "half"])
        .groupBy("class")
        .agg(
            F.collect_list(F.when(left, F.struct("i", "half"))).alias("u"),
            F.collect_list(F.when(~left, F.struct("i", "half"))).alias("v"),
        )
        .where((F.size("u") > 0) & (F.size("v") > 0))
    )
    rows = sides.select("class", "v", F.explode("u").alias("u")).select(
        "class", "u", F.explode("v").alias("v")
    )
    members = stage(
        rows.select(F.xxhash64("u.i", "u.half", "v.i", "v.half").alias("key"), "class"), "members"
    )
    full = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return stage(members.join(full, "key"), "tables")


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    signs = classes.select("class", "minima", "n_shingles")
    for side in ("a", "b"):
        pairs = pairs.join(
            signs.select(
                F.col("class").alias(side),
                F.col("minima").alias(f"m_{side}"),
                F.col("n_shingles").alias(f"n_{side}"),
            ),
            side,
        )
    equal = F.aggregate(
        F.zip_with("m_a", "m_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, e: s + e
    )
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    near = pairs.where((small * 100 >= large * PERCENT) & (equal >= LEAST_EQUAL))
    near = stage(near.select("a", "b"), "near_pairs")
    for side in ("a", "b"):
        near = near.join(
            sets.select(F.col("class").alias(side), F.col("shingles").alias(f"s_{side}")), side
        )
    both = F.size(F.array_intersect("s_a", "s_b"))
    either = F.size("s_a") + F.size("s_b") - both
    return stage(near.where(both * 100 >= either * PERCENT).select("a", "b"), "links")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Add ``root``: the component so far, a class without links being its own."""
    return members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class")
    )


def _prefix_pairs(sets: DataFrame) -> DataFrame:
    """``a, b``: classes of different ``root`` that share a shingle of their prefixes.

    All shingles are put in one order, rare ones first. Two sets with the least
    similarity or more share one of their first |set| - ceil(3/4 |set|) + 1 shingles, so
    this loses no link, while a passage that thousands of documents share comes last
    and pairs none of them.
    """
    counts = (
        sets.select(F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > RARE)
    )
    common = (
        sets.select("class", F.explode("shingles").alias("shingle"))
        .join(stage(counts, "common"), "shingle")
        .groupBy("class")
        .agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    )
    known = F.coalesce("common.shingle", F.array().cast("array<long>"))
    size = F.size("shingles")
    length = size - F.ceil(size * PERCENT / 100).cast("int") + 1
    ordered = F.concat(F.array_sort(F.array_except("shingles", known)), known)
    index = stage(
        sets.join(common, "class", "left").select(
            "class",
            "root",
            size.alias("size"),
            F.posexplode(F.slice(ordered, F.lit(1), length)).alias("pos", "shingle"),
        ),
        "prefixes",
    )
    shared = (
        index.groupBy("shingle")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low != high")
        .select("shingle")
    )
    index = index.join(shared, "shingle")
    x, y = index.alias("x"), index.alias("y")
    # At the first shingle that two sets share, all they have in common is still to come.
    # That holds for no later one, but a link passes at its first.
    to_come = F.least(F.expr("x.size - x.pos"), F.expr("y.size - y.pos"))
    enough = to_come * (100 + PERCENT) >= F.expr("x.size + y.size") * PERCENT
    return (
        x.join(
            y, (F.col("x.shingle") == F.col("y.shingle")) & F.expr("x.root < y.root") & enough
        )
        .select(
            F.greatest("x.class", "y.class").alias("a"), F.least("x.class", "y.class").alias("b")
        )
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, doc_key, n_shingles, component_id, kept`` for every row of ``docs``.

    ASCII letters are lower-cased; words are what stands between ASCII white space. A
    text of fewer words than a shingle is one shingle; one without words, or null, is
    linked with nothing. ``component_id`` is the least id in the row's component, null
    ids apart; a row with null id is kept if it is alone with null ids. Rows with equal
    sets are linked, repeated rows too. Other columns are ignored; an empty table gives
    an empty result. ``doc_key`` hashes the text, and tells rows with the same id apart.
    """
    text = full_text(text_col)
    doc_id = F.col(f"`{id_col}`").cast("long")
    texts = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(_NO_ID)).alias("doc_ref"),
        F.xxhash64(text).alias("doc_key"),
        text.alias("text"),
    )
    rows = stage(_signed(texts), "signed")
    same = ["n_shingles", "d1", "d2"]
    ref = F.struct("doc_ref", "doc_key")
    classes = (
        rows.where("n_shingles > 0")
        .groupBy(*same)
        .agg(
            F.min(ref).alias("ref"),
            F.min("doc_id").alias("least_id"),
            F.any_value("halves").alias("halves"),
            F.any_value("minima").alias("minima"),
        )
        .withColumn("class", F.monotonically_increasing_id())
    )
    classes = stage(classes, "classes")
    tables = _tables(classes)

    wanted = (
        tables.select("class").distinct().join(classes, "class").select("class", "ref.*")
    )
    met = texts.join(wanted, ["doc_ref", "doc_key"]).select("class", "text", "doc_ref", "doc_key")
    sets = stage(_sets(met.dropDuplicates(["doc_ref", "doc_key"]).select("class", "text")), "sets")

    hubs = tables.groupBy("key").agg(F.min("class").alias("b"))
    first = tables.join(hubs, "key").where("class != b").select(F.col("class").alias("a"), "b")
    tried = stage(first.distinct(), "pairs")
    links = _confirmed(tried, classes, sets)
    roots = stage(components(links), "roots")

    # Classes that share a table with another component may still link to it.
    members = _rooted(tables, roots)
    mixed = (
        members.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low != high")
        .select("key")
    )
    unsettled = stage(
        members.join(mixed, "key").select("class", "root").distinct(), "unsettled"
    )
    across = _prefix_pairs(sets.join(unsettled, "class")).join(tried, ["a", "b"], "left_anti")
    more = _confirmed(stage(across, "pairs"), classes, sets)
    roots = stage(components(links.union(more)), "roots")

    named = _rooted(classes.select("class", "least_id", *same), roots)
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_set = stage(named.join(least, "root").select(*same, "component_id"), "of_set")
    found = rows.select("doc_id", "doc_key", *same).join(of_set, same, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.col("component_id")
    )
    return found.select(
        "doc_id",
        "doc_key",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The kept rows of ``docs`` with all their columns: one document of each component."""
    found = near_duplicates(docs, id_col, text_col).where("NOT kept")
    # Copies grow with the documents, so the join is the same at every size.
    gone = found.select("doc_id", "doc_key").distinct().hint("merge")
    return join_on_document(docs, gone, "left_anti", id_col, text_col)
