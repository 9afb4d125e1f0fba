"""Byte-level BPE encoding and decoding.

A word's bytes form a doubly linked list of symbols. Mergeable neighbours wait in a
priority queue ordered by merge rank, then position. An entry whose symbols have
changed since it was queued is stale and skipped. Merging two symbols queues the new
pairs on either side. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text

#: Fixed values of the format: what counts as white space, and the pattern that cuts a
#: text into words before merging, for classes of letters and numbers.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = (
    "'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+"
    "| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
)
#: Words whose ids a worker remembers before it starts afresh.
_REMEMBERED = 1 << 19
#: A long text is cut into words in stretches of about so many characters.
_STRETCH = 1 << 20
#: Rows and characters that go back to Spark at once.
_ROWS, _CHARS = 256, 1 << 22


def _code_points(prop: str) -> str:
    """The members of a Unicode property in the basic plane, as ranges of a class."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    return "".join(
        f"\\u{ord(run[0][0]):04x}-\\u{ord(run[0][-1]):04x}"
        for run in regex.finditer(rf"{prop}+", plane)
    )


def word_patterns() -> tuple[re.Pattern, regex.Pattern]:
    """For texts of the basic plane, and for all.

    The first spells the classes out for the standard library's matcher, which is
    twice as fast on them. A task calls this once; a cache around it would make the
    function travel to the executors by its module's name.
    """
    basic = {"letters": _code_points(r"\p{L}"), "numbers": _code_points(r"\p{N}")}
    whole = {"letters": r"\p{L}", "numbers": r"\p{N}"}
    return (
        re.compile(WORDS.format(space=_SPACE, **basic)),
        regex.compile(WORDS.format(space=_SPACE, **whole)),
    )


class _Known(dict):
    """Ids of the words seen so far; merges a word it has not seen."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        ids = self.merge(word.encode("utf-8"))
        self[word] = packed = b"".join([i.to_bytes(4, "little") for i in ids])
        return packed


def byte_letters() -> dict[int, str]:
    """The format's letter for each byte.

    Printable Latin-1 stands for itself; the other bytes, in order, take the letters
    from code point 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class ByteBpe:
    """Encoder and decoder for a tokenizer description in JSON."""

    def __init__(self, description: str):
        spec = json.loads(description)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if (model["type"], cut["type"], cut["add_prefix_space"]) != ("BPE", "ByteLevel", False):
            raise ValueError("only byte-level BPE without prefix space is supported")
        if spec.get("normalizer") or any(model.get(k) for k in ("dropout", "ignore_merges")):
            raise ValueError("normalizers, dropout and ignore_merges are not supported")
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        vocab = model["vocab"]
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(
                (vocab[left], vocab[right]), (rank, vocab[left + right])
            )
        self.strings = {
            i: bytes(of_letter[c] for c in token)
            if all(c in of_letter for c in token)
            else token.encode()
            for token, i in vocab.items()
        }
        special = {}
        for token in spec.get("added_tokens", []):
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("added tokens with word or strip rules are not supported")
            special[token["content"]] = token["id"]
            self.strings[token["id"]] = token["content"].encode()
        self.special = special
        longest_first = sorted(special, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, longest_first)))
        self._basic_words, self._all_words = word_patterns()
        self._beyond_basic = re.compile("[\U00010000-\U0010ffff]")
        self._stretch_end = re.compile(rf"(?<=[^{_SPACE}])[{_SPACE}]")
        self._known = _Known(self.merge)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        symbols: list[int] = [self.byte_ids[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges, queue = self.merges, []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: a neighbour has been merged away
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, symbols[h], merged, found[1]))
        return [s for s in symbols if s >= 0]

    def _stretches(self, text: str) -> Iterator[str]:
        """Cut before white space that follows something else: no word spans that place."""
        at = 0
        while len(text) - at > _STRETCH:
            end = self._stretch_end.search(text, at + _STRETCH)
            if not end:
                break
            yield text[at : end.start()]
            at = end.start()
        yield text[at:] if at else text

    def _encode_plain(self, text: str) -> Iterator[bytes]:
        known = self._known
        for stretch in self._stretches(text):
            beyond = self._beyond_basic.search(stretch)
            words = (self._all_words if beyond else self._basic_words).findall(stretch)
            yield b"".join(map(known.__getitem__, words))
            if len(known) > _REMEMBERED:
                known.clear()

    def encode(self, text: str) -> bytes:
        """The ids of a text, each as four bytes, least first."""
        if not self.special:
            return b"".join(self._encode_plain(text))
        parts, at = [], 0
        for found in self._special.finditer(text):
            parts.extend(self._encode_plain(text[at : found.start()]))
            parts.append(self.special[found[0]].to_bytes(4, "little"))
            at = found.end()
        parts.extend(self._encode_plain(text[at:] if at else text))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join(
            [strings[i] for i in memoryview(ids).cast("I")]
        ).decode("utf-8", "replace")


def encode_and_decode(
    docs: DataFrame, description: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded`` for every row of ``docs``.

    ``description`` is the tokenizer's JSON; ``ids`` packs each id into four bytes,
    least first. Strings of added tokens inside a text become their ids. Null text is
    empty text and has no ids. Rows that repeat are encoded alike, an empty table
    gives an empty result, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(description)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(shared.value)
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string()]

        def packed(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "ids", "n_tokens", "decoded"],
            )

        for batch in batches:
            rows, chars = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py()
                ids = bpe.encode(text)
                rows.append((doc_id.as_py(), ids, len(ids) // 4, bpe.decode(ids)))
                chars += len(text)
                if len(rows) >= _ROWS or chars >= _CHARS:
                    yield packed(rows)
                    rows, chars = [], 0
            if rows:
                yield packed(rows)

    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), full_text(text_col).alias("text")
    )
    return texts.mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")
