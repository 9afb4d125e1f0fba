"""Phrases whose words stand together more often than their parts suggest.

Counts of phrases of one to five words are kept as sorted streams, as in external-memory
language-model estimation. A word is a code of eight bytes and a phrase the codes of its
words, so in byte order a phrase follows its own beginning: that is the prefix order.
The streams of all lengths are merged into one and read once in lockstep; the beginnings
of the current phrase, at most four, are what came last, and hand over their counts
(left counts), while each beginning sees its extensions pass by. The same stream, sorted
by the words read backwards (suffix order), gives the right counts and the extensions to
the left. No phrase is looked up, and a task holds five phrases at a time.

A phrase can be frequent only if both phrases it holds with one word less are. Phrases
are therefore counted length by length, and a bit sketch of those found frequent tells
which longer ones need counting at all. The sketch has a fixed size; a false alarm costs
a counted row and changes nothing. Each length is counted in rounds, every phrase in one
of them, so that only a part of the counts that most phrases never outlive is on disk.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import full_text, stage
from .minhash import Shingler, _mixed
from .skew import salted_join

#: Least number of occurrences, most words of a phrase, and phrases listed per language.
LEAST, LONGEST, LISTED = 100, 5, 2000
#: Language of documents that name none.
NO_LANG = "und"
#: Bits of a sketch; 8 MB are collected and broadcast for each length, at any size.
SKETCH_BITS = 1 << 26
#: Bytes of text coded together. A block's words are numbered, so it is a row of up to a
#: few megabytes, and few of them go into one file.
BLOCK_BYTES, BLOCKS_PER_FILE = 6 << 20, 4
#: Rounds in which the phrases of one length are counted.
ROUNDS = 3
#: Lists per language are made in so many parts first.
PARTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_NEW_PIECE = np.uint32(1 << 31)
_BUCKET = 1 << 15
_LONGS = pa.list_(pa.int64())


class WordCoder(Shingler):
    """Words of texts as 64-bit codes, and which of them begin a piece."""

    def __init__(self):
        super().__init__(1)
        self._space[:] = False
        self._space[[0x20, 0x09, *_BREAKS]] = True
        self._breaks = np.zeros(256, dtype=bool)
        self._breaks[list(_BREAKS)] = True

    def coded(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``codes, starts, ends`` of the words in lower-cased bytes, and breaks up to each byte."""
        edges = np.flatnonzero(np.diff(~self._space[raw], prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        self._grow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._powers[: len(raw)], out=sums[1:])
        codes = (sums[ends] - sums[starts]) * self._inverses[starts]
        codes = _mixed(codes + (ends - starts).astype(np.uint64))
        return codes, starts, ends, np.cumsum(self._breaks[raw])

    def stretches(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        """Cut between words, so that each stretch takes bounded memory to code."""
        at = 0
        while at < len(raw):
            end = min(len(raw), at + self.PIECE)
            while end < len(raw) and not self._space[raw[end]]:
                spaces = np.flatnonzero(self._space[raw[end : end + self.PIECE]])
                end = end + int(spaces[0]) if len(spaces) else min(len(raw), end + self.PIECE)
            yield raw[at:end]
            at = end


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))


def _slots(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Places in a sketch."""
    return (_mixed(hashes ^ _salt(lang)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)


def _hashed(words: Sequence[np.ndarray]) -> np.ndarray:
    """A hash per phrase, of whose words the arrays hold the first, second and so on."""
    out = np.zeros(len(words[0]), np.uint64)
    for codes in words:
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + codes
    return _mixed(out + np.uint64(len(words)))


def _phrases(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash for the ``n`` words from each position on."""
    return _hashed([codes[i : len(codes) - n + 1 + i] for i in range(n)])


def _block(coder: WordCoder, lang: str, texts: list[str]) -> list | None:
    """A row of ``_blocks``; no text's words continue another's piece."""
    joined = "\n".join(texts).encode("utf-8", "surrogatepass")
    raw = coder._lower[np.frombuffer(joined, np.uint8)]
    codes, begins, known = [], [], {}
    passed, last = 0, -1
    for part in coder.stretches(raw):
        found, starts, ends, breaks = coder.coded(part)
        if len(found):
            before = passed + breaks[starts]
            codes.append(found)
            begins.append(np.diff(before, prepend=last) > 0)
            last = before[-1]
            for i in np.unique(found, return_index=True)[1]:
                if (code := int(found[i])) not in known:
                    word = part[starts[i] : ends[i]].tobytes()
                    known[code] = word.decode("utf-8", "replace")
        passed += int(breaks[-1])
    if not codes:
        return None
    distinct, numbers, counts = np.unique(
        np.concatenate(codes), return_inverse=True, return_counts=True
    )
    marked = numbers.astype(np.uint32) | (np.concatenate(begins) * _NEW_PIECE)
    return [
        lang,
        marked.astype("<u4").tobytes(),
        [known[int(c)] for c in distinct],
        distinct.view(np.int64),
        counts.astype(np.int64),
    ]


def _blocks(texts: DataFrame) -> DataFrame:
    """``lang, numbers, words, codes, counts``: the texts of a language, coded.

    ``numbers`` holds four bytes per word: its place in the block's sorted ``codes``, and
    the highest bit where a piece begins. The other arrays have an item per distinct word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder()
        waiting: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def made(lang: str) -> Iterator[pa.RecordBatch]:
            row = _block(coder, lang, waiting.pop(lang))
            sizes.pop(lang)
            if row:
                kinds = [pa.string(), pa.binary(), pa.list_(pa.string()), *[_LONGS] * 2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], k) for x, k in zip(row, kinds, strict=True)],
                    ["lang", "numbers", "words", "codes", "counts"],
                )

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                name, value = lang.as_py(), text.as_py()
                waiting.setdefault(name, []).append(value)
                sizes[name] = sizes.get(name, 0) + len(value) + 1
                if sizes[name] >= BLOCK_BYTES:
                    yield from made(name)
                elif len(sizes) > 1 and sum(sizes.values()) >= 4 * BLOCK_BYTES:
                    yield from made(max(sizes, key=sizes.get))
        for name in list(waiting):
            yield from made(name)

    return texts.mapInArrow(
        run,
        "lang string, numbers binary, words array<string>, codes array<long>, counts array<long>",
    )


def _keys(rows: np.ndarray) -> pa.Array:
    """Codes, a phrase in each row, as bytes that sort like them."""
    n, width = rows.shape
    fixed = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(8 * width), n, [None, pa.py_buffer(rows.astype(">u8").tobytes())]
    )
    return fixed.cast(pa.binary())


def _slots_of(phrases: DataFrame, n: int) -> DataFrame:
    """``slot`` of each ``lang, key`` with phrases of ``n`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1 << 14):
                langs = np.array(batch["lang"][at : at + (1 << 14)].to_pylist(), object)
                keys = b"".join(batch["key"][at : at + (1 << 14)].to_pylist())
                hashes = _hashed(np.frombuffer(keys, ">u8").reshape(-1, n).T.astype(np.uint64))
                for lang in set(langs):
                    slots = _slots(hashes[langs == lang], lang)
                    yield pa.RecordBatch.from_arrays([pa.array(slots)], ["slot"])

    return phrases.select("lang", "key").mapInArrow(run, "slot long")


def _sketch(frequent: DataFrame, n: int) -> np.ndarray:
    """The bits of the frequent phrases' slots, as bytes of a fixed number."""
    slots = _slots_of(frequent, n)
    parts = slots.groupBy(F.shiftright("slot", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(_BUCKET - 1))).alias("bits")
    )
    bits = np.zeros(SKETCH_BITS // 8, np.uint8)
    size = _BUCKET // 8
    for row in parts.collect():
        at = row["bucket"] * size
        bits[at : at + size] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _longer(blocks: DataFrame, n: int, sketch: Broadcast, turn: int) -> DataFrame:
    """``lang, key, n``: phrases of ``n`` words whose two parts the sketch knows.

    A row counts a phrase within a block. ``turn`` is one of ``ROUNDS``; each phrase has
    its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sketch.value
        for batch in batches:
            for lang, numbers, codes in zip(*(batch[c] for c in range(3)), strict=True):
                name = lang.as_py()
                marked = np.frombuffer(numbers.as_py(), "<u4")
                words = np.asarray(codes.values).view(np.uint64)[marked & (_NEW_PIECE - 1)]
                if len(words) < n:
                    continue
                piece = np.cumsum(marked >= _NEW_PIECE)
                slots = _slots(_phrases(words, n - 1), name)
                alive = (known[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
                at = np.flatnonzero(alive[:-1] & alive[1:] & (piece[: 1 - n] == piece[n - 1 :]))
                if not len(at):
                    continue
                hashes = _phrases(words, n)[at]
                mine = (hashes >> np.uint64(48)) % np.uint64(ROUNDS) == np.uint64(turn)
                hashes, at = hashes[mine], at[mine]
                found, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                rows = words[at[first][:, None] + np.arange(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(found), pa.string()),
                        _keys(rows),
                        pa.array(counts.astype(np.int64)),
                    ],
                    ["lang", "key", "n"],
                )

    return blocks.select("lang", "numbers", "codes").mapInArrow(
        run, "lang string, key binary, n long"
    )


def _frequent(blocks: DataFrame, n: int, shorter: DataFrame, least: int) -> DataFrame:
    """``lang, key, a``: phrases of ``n`` words that occur ``least`` times or more.

    ``shorter`` holds those of one word less.
    """
    sketch = blocks.sparkSession.sparkContext.broadcast(_sketch(shorter, n - 1))
    found = [
        stage(
            _longer(blocks, n, sketch, turn)
            .groupBy("lang", "key")
            .agg(F.sum("n").alias("a"))
            .where(F.col("a") >= least),
            f"phrases_{n}",
        )
        for turn in range(ROUNDS)
    ]
    return functools.reduce(DataFrame.union, found)


def _lockstep(stream: DataFrame, side: str, others: list[str]) -> DataFrame:
    """Read the stream in the order of ``key``, all lengths at once.

    Adds ``side``, the counts of the phrases that ``key`` begins with, shortest first, and
    raises ``longer`` to the largest count of a phrase that goes on after ``key`` by one
    word. ``key`` comes out with its words reversed, ready for the other order. What
    begins with the same word is read by one task, a phrase at a time.
    """
    ranges = stream.repartitionByRange("lang", F.substring("key", 1, 8))
    ordered = ranges.sortWithinPartitions("lang", "key")
    carried = ["lang", "key", "a", "longer", *others]
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: list[list] = []
        done: list[tuple] = []

        def close() -> None:
            lang, key, *rest = begun.pop()
            back = b"".join(key[i : i + 8] for i in range(len(key) - 8, -1, -8))
            done.append((lang, back, *rest, [row[2] for row in begun]))

        def batch_of() -> pa.RecordBatch:
            arrow = [pa.string(), pa.binary(), *[pa.int64()] * 2, *[_LONGS] * (len(others) + 1)]
            columns = [
                pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), arrow, strict=True)
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [*carried, side])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in carried), strict=True):
                lang, key, a = row[:3]
                while begun and not (begun[-1][0] == lang and key.startswith(begun[-1][1])):
                    close()
                if len(key) != 8 * (len(begun) + 1):
                    raise ValueError("the stream lacks the beginning of a phrase")
                if begun:
                    begun[-1][3] = max(begun[-1][3], a)
                begun.append(list(row))
                if len(done) >= 1 << 14:
                    yield batch_of()
        while begun:
            close()
        if done:
            yield batch_of()

    schema = [f"{c} {kinds[c]}" for c in carried]
    return ordered.select(*carried).mapInArrow(run, ", ".join([*schema, f"{side} array<bigint>"]))


def _best_cut() -> Column:
    """The lowest-scoring cut of a phrase into two: score, words of the first part, counts.

    Scores are exact: products of two counts and a thousand fit 38 digits.
    """

    def wide(value: Column) -> Column:
        return value.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        left, right = F.get("lefts", k - 1), F.get("rights", F.size("lefts") - k)
        above = (F.col("a").cast("decimal(15,0)") * F.lit(1000)) * wide(F.col("n"))
        score = F.call_function("div", above, wide(left) * wide(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("lefts")), cut))


def phrase_counts(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lang, key, a`` of frequent phrases, ``lang, code, word`` and ``lang, n``."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG))
    texts = docs.select(lang.alias("lang"), full_text(text_col).alias("text"))
    blocks = stage(_blocks(texts), "blocks", BLOCKS_PER_FILE)
    words = blocks.select("lang", F.inline(F.arrays_zip("words", "codes", "counts")))
    counted = words.groupBy("lang", "codes").agg(
        F.sum("counts").alias("a"), F.min("words").alias("word")
    )
    in_block = F.aggregate("counts", F.lit(0).cast("long"), lambda total, x: total + x)
    totals = stage(blocks.groupBy("lang").agg(F.sum(in_block).alias("n")), "totals")
    code = F.unhex(F.lpad(F.hex("codes"), 16, "0"))
    vocabulary = stage(
        counted.where(F.col("a") >= least).select("lang", code.alias("key"), "a", "word"),
        "vocabulary",
    )
    current = vocabulary.drop("word")
    stream = current
    for n in range(2, longest + 1):
        current = _frequent(blocks, n, current, least)
        stream = stream.union(current)
    return (
        stream,
        vocabulary.select("lang", F.col("key").alias("code"), "word"),
        totals,
    )


def _spelled(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``phrases`` with ``key`` spelled out as ``phrase``."""
    rest = [c for c in phrases.columns if c not in ("lang", "key")]
    words = stage(
        phrases.select(
            "lang",
            "key",
            F.struct(*rest).alias("rest"),
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.col("size") - 1),
                    lambda i: F.substring(F.col("key"), i * 8 + 1, F.lit(8)),
                )
            ).alias("pos", "code"),
        ),
        "phrase_words",
    )
    return (
        salted_join(words, vocabulary, ["lang", "code"], F.col("key"))
        .groupBy("lang", "key", "rest")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
        .select("lang", F.array_join("words.word", " ").alias("phrase"), "rest.*")
    )


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    listed: int = LISTED,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    ASCII letters are lower-cased. Texts are cut into pieces at ``.,;:!?`` and line ends,
    pieces into words at spaces and tabs. A phrase is two to ``longest`` words of a piece
    that occur together ``a >= least`` times, overlaps included; ``n`` counts the words of
    the language. Cut in two, with ``l`` and ``r`` occurrences of the parts, it scores
    ``floor(1000 a n / (l r))``; the cut with the lowest score counts, the earliest if tied.
    A phrase that a longer one holds with the same count is left out. Lists are ordered by
    score and count, highest first, then by the phrase's bytes. Null text is empty, a null
    language is ``und``; texts without words add nothing, and an empty table gives an empty
    result. Repeated rows count each time. Other columns are ignored.
    """
    stream, vocabulary, totals = phrase_counts(docs, text_col, lang_col, least, longest)
    prefix = _lockstep(stream.withColumn("longer", F.lit(0).cast("long")), "lefts", [])
    both = _lockstep(stage(prefix, "prefix_order"), "rights", ["lefts"])
    scored = (
        stage(both, "suffix_order")
        .where((F.size("lefts") > 0) & (F.col("longer") < F.col("a")))
        .join(totals, "lang")
        .withColumn("cut", _best_cut())
    )
    size = (F.size("lefts") + 1).alias("size")
    found = stage(scored.select("lang", "key", size, "a", "cut.l", "cut.r", "n", "cut.score"), "scored")
    spelled = _spelled(found, vocabulary).drop("size")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    leading = (
        spelled.withColumn("part", part).withColumn("at", in_part).where(F.col("at") <= listed)
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (
        leading.drop("part", "at")
        .withColumn("rank", rank.cast("long"))
        .where(F.col("rank") <= listed)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
