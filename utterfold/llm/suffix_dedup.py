"""Repeated byte strings by a distributed merge sort of suffixes that knows prefixes.

A string of LENGTH bytes repeats where two suffixes agree that far. Not every suffix is
sorted: of the GRAM-byte grams of each string the one with the least hash is its anchor,
so equal strings have their anchors at the same place, and only suffixes at anchors are
sorted, each with the bytes before it that its strings need. Every string belongs to
exactly one anchor, so nothing is lost.

Each task sorts the suffixes of a few megabytes of text into a run, reduces equal ones to
the first, and writes the run front-coded: the length of the prefix shared with the
suffix before, and the rest. Runs are cut at common splitters and exchanged; for each
range a loser tree merges its pieces. The tree keeps for every loser the prefix it shares
with the last winner: unequal lengths decide a match without looking at the strings, and
equal ones compare from there on.

A phrase that very many texts hold in different surroundings would gather all of them at one
gram, in one task. Such grams are counted beforehand and kept out of the runs; the strings
at them become rows keyed by a digest, whose least place is found by aggregation.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text, stage

#: Bytes of a string that may stand only once, and of the grams its anchor is chosen from.
LENGTH, GRAM = 100, 32
#: Text bytes that one sorted run covers, and that one range of the merge gets.
RUN_BYTES, RANGE_BYTES = 12 << 20, 24 << 20
#: Suffixes that may meet at one gram in the merge. Counted are grams that as many
#: different suffixes of a run hold as the second number says.
CROWD, CROWD_IN_RUN = 20_000, 8
#: Least number of documents that the splitters are taken from, and suffixes of each; with
#: more ranges than that there is a document for each range.
SAMPLE_DOCS, SAMPLE_EACH = 2000, 8
_SPLIT = 16  # bytes of a splitter: fewer than a gram, so equal grams stay together

_SPAN = LENGTH - GRAM + 1  # grams of a string
_PIECE = 1 << 22
_INDEX = np.uint64((1 << 24) - 1)
_PLACES = np.dtype([("ref", "<i8"), ("key", "<i8"), ("pos", "<u4")])
_STRINGS = np.dtype(
    [("d1", "<u8"), ("d2", "<u8"), ("ref", "<i8"), ("key", "<i8"), ("start", "<u4")]
)
_MARKS = np.dtype([("ref", "<i8"), ("key", "<i8"), ("start", "<u4"), ("end", "<u4")])


# --- anchors -------------------------------------------------------------------------


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, by doubling."""
    base = 0x9E3779B97F4A7C15
    hashes, size = raw.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        step = min(size, GRAM - size)
        shift = np.uint64(pow(base, step, 1 << 64))
        hashes = hashes[: len(hashes) - step] * shift + hashes[step:] * np.uint64(size * 2 + 1)
        size += step
    hashes ^= hashes >> np.uint64(32)
    return hashes * np.uint64(0xD6E8FEB86659FD93)


def anchors(raw: np.ndarray, whole: bool = False) -> tuple[np.ndarray, ...]:
    """``pos, first, last, gram``: anchors, first and last start of their strings, gram hash.

    With ``whole`` also a hash of all bytes from the first start to the last end, the sum
    of the hashes of their grams.
    """
    found = []
    for at in range(0, max(len(raw) - LENGTH + 1, 0), _PIECE):
        part = raw[at : at + _PIECE + LENGTH - 1]
        hashes = _gram_hashes(part)
        least = (hashes & ~_INDEX) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width < _SPAN:
            step = min(width, _SPAN - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        pos = (least & _INDEX).astype(np.int64)
        turn = np.flatnonzero(np.diff(pos, prepend=-1))
        last = np.append(turn[1:], len(pos)) - 1
        row = [pos[turn] + at, turn + at, last + at, hashes[pos[turn]]]
        if whole:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
            row.append(sums[last + _SPAN] - sums[turn])
        found.append(row)
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return (empty, empty, empty, *[empty.astype(np.uint64)] * (1 + whole))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# --- runs ----------------------------------------------------------------------------


def _front_coded(keys: list[bytes], rights: list[int], places: np.ndarray) -> bytes:
    """Sorted keys as shared prefix lengths and rests, with the rest of each item."""
    n = len(keys)
    lengths = np.fromiter(map(len, keys), np.uint8, n)
    shared = np.zeros(n, dtype=np.uint8)
    for at in range(0, n, 1 << 15):
        part = keys[max(at - 1, 0) : at + (1 << 15)]
        width = max(map(len, part))
        table = np.array(part, dtype=f"S{width}").view(np.uint8).reshape(len(part), width)
        differ = table[1:] != table[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        start = at if at else 1
        limit = np.minimum(lengths[start : start + len(common)],
                           lengths[start - 1 : start - 1 + len(common)])
        shared[start : start + len(common)] = np.minimum(common, limit)
    rest = b"".join([k[s:] for k, s in zip(keys, shared.tolist(), strict=True)])
    head = np.array([n], dtype="<u4").tobytes()
    body = head + shared.tobytes() + lengths.tobytes() + bytes(rights) + places.tobytes() + rest
    return zstandard.compress(body, 1)


class _Run:
    """Reads a front-coded run."""

    def __init__(self, blob: bytes):
        body = zstandard.decompress(blob)
        self.n = n = int.from_bytes(body[:4], "little")
        self.shared, self.lengths = body[4 : 4 + n], body[4 + n : 4 + 2 * n]
        self.rights = body[4 + 2 * n : 4 + 3 * n]
        size = n * _PLACES.itemsize
        places = np.frombuffer(body, _PLACES, n, 4 + 3 * n)
        self.places = places.tolist()
        self.rest, self.at = body[4 + 3 * n + size :], 0
        self.i, self.key = -1, b""

    def advance(self) -> int:
        """Go to the next key; the length it shares with the one before, -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        shared = self.shared[self.i]
        end = self.at + self.lengths[self.i] - shared
        self.key = self.key[:shared] + self.rest[self.at : end]
        self.at = end
        return shared


def _shared_from(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix, known to be ``at`` bytes or more."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


def merged(blobs: list[bytes]) -> Iterator[tuple[int, bytes, int, tuple]]:
    """Shared prefix with the item before, key, right length and place, in key order."""
    runs = [_Run(b) for b in blobs]
    size = 1 << max(len(runs) - 1, 0).bit_length()
    shared = [r.advance() for r in runs] + [-1] * (size - len(runs))
    shared = [0 if s >= 0 else -1 for s in shared]
    tree = [0] * size  # the loser of each inner node; tree[0] is the winner

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser keeps what it shares with the winner."""
        sx, sy = shared[x], shared[y]
        if sx != sy:
            return (x, y) if sx > sy else (y, x)
        if sx < 0:
            return x, y
        a, b = runs[x].key, runs[y].key
        same = _shared_from(a, b, sx)
        if a[same:] <= b[same:]:
            shared[y] = same
            return x, y
        shared[x] = same
        return y, x

    winners = list(range(size))
    node = size
    while node > 1:
        node //= 2
        following = []
        for i in range(node):
            w, loser = play(winners[2 * i], winners[2 * i + 1])
            tree[node + i] = loser
            following.append(w)
        winners = following
    winner = winners[0]
    while shared[winner] >= 0:
        run = runs[winner]
        yield shared[winner], run.key, run.rights[run.i], run.places[run.i]
        shared[winner] = run.advance()
        node = (winner + size) >> 1
        while node:
            loser = tree[node]
            sw, sl = shared[winner], shared[loser]
            if sw < sl:
                tree[node], winner = winner, loser
            elif sw == sl:
                winner, tree[node] = play(winner, loser)
            node >>= 1


# --- repeats -------------------------------------------------------------------------


def _prefix(a: bytes, b: bytes) -> int:
    return _shared_from(a, b, 0)


def _repeats(group: list[tuple[bytes, int, tuple]]) -> Iterator[tuple[tuple, int, int]]:
    """``place, first, last`` of repeated strings, counted back from the anchor.

    The items share a gram. A string that starts l bytes before the anchor needs l equal
    bytes to the left and LENGTH - l to the right.
    """
    first: dict[tuple[bytes, int], tuple] = {}
    for key, right, place in group:
        known = first.get((key, right))
        if known is None:
            first[key, right] = place
        elif known != place:
            low, high = LENGTH - right, len(key) - right
            later = place
            if place < known:
                first[key, right], later = place, known
            yield later, low, high
    if len(first) == 1:
        return
    items = sorted(
        (place, key[:right], key[:right - len(key) - 1 : -1] if len(key) > right else b"")
        for (key, right), place in first.items()
    )
    if len(items) <= 4:
        for i, (place, right, left) in enumerate(items):
            for _, other_right, other_left in items[:i]:
                low = max(
                    LENGTH - _prefix(right, other_right),
                    LENGTH - len(right),
                    LENGTH - len(other_right),
                )
                high = _prefix(left, other_left)
                if low <= high:
                    yield place, low, high
        return
    seen: set[tuple[bytes, bytes]] = set()
    for place, right, left in items:
        begin = None
        low, high = LENGTH - len(right), len(left)
        for back in range(low, high + 1):
            string = (left[:back], right[: LENGTH - back])
            if string in seen:
                begin = back if begin is None else begin
            else:
                seen.add(string)
                if begin is not None:
                    yield place, begin, back - 1
                    begin = None
        if begin is not None:
            yield place, begin, high


def _packed(marks: list[tuple[int, int, int, int]]) -> bytes:
    return zstandard.compress(np.array(marks, dtype=_MARKS).tobytes(), 1)


class _Strings:
    """Strings at crowded grams, by digest, each reduced to its least place in the task.

    The other places are marked at once. A range of digests is a part of its own, so a
    phrase that a third of all texts hold is spread over all of them.
    """

    #: Strings and marks that are held at once.
    MOST = 200_000

    def __init__(self, parts: int):
        self.parts = parts
        self.waiting: list[tuple] = []
        self.first: dict[bytes, tuple[int, int, int]] = {}
        self.later: list[tuple[int, int, int, int]] = []

    def wait(self, ref: int, key: int, text: bytes, first: np.ndarray, last: np.ndarray) -> None:
        self.waiting.append((ref, key, text, first.tolist(), last.tolist()))

    def full(self) -> Iterator[tuple[int, bytes]]:
        """Digest what waits; ``part, blob`` of what has become too much to hold."""
        for ref, key, text, firsts, lasts in self.waiting:
            for a, b in zip(firsts, lasts, strict=True):
                for start in range(a, b + 1):
                    string = text[start : start + LENGTH]
                    digest = hashlib.blake2b(string, digest_size=16).digest()
                    place = (ref, key, start)
                    known = self.first.setdefault(digest, place)
                    if known != place:
                        if place < known:
                            self.first[digest], place = place, known
                        self.later.append((*place, place[2] + LENGTH))
                if len(self.first) + len(self.later) >= self.MOST:
                    yield from self.rest()
        self.waiting.clear()

    def rest(self) -> Iterator[tuple[int, bytes]]:
        rows = np.zeros(len(self.first), dtype=_STRINGS)
        digests = np.frombuffer(b"".join(self.first), "<u8").reshape(-1, 2)
        rows["d1"], rows["d2"] = digests[:, 0], digests[:, 1]
        places = np.array(list(self.first.values()), dtype=np.int64).reshape(-1, 3)
        rows["ref"], rows["key"], rows["start"] = places.T
        part = (rows["d1"] % np.uint64(self.parts)).astype(np.int64)
        for i in np.unique(part).tolist():
            blob = zstandard.compress(rows[part == i].tobytes(), 1)
            yield 2 * self.parts + i, blob
        if self.later:
            joined = _joined(self.later)
            yield self.parts + abs(joined[0][1]) % self.parts, _packed(joined)
        self.first, self.later = {}, []


def _later_strings(blobs: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Stretches of the strings of some digests that stand at an earlier place as well."""
    rows = np.concatenate([np.frombuffer(zstandard.decompress(b), dtype=_STRINGS) for b in blobs])
    rows = rows[np.lexsort([rows[c] for c in ("start", "key", "ref", "d2", "d1")])]
    begins = np.ones(len(rows), dtype=bool)
    begins[1:] = (rows["d1"][1:] != rows["d1"][:-1]) | (rows["d2"][1:] != rows["d2"][:-1])
    first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    again = np.zeros(len(rows), dtype=bool)
    for c in ("ref", "key", "start"):
        again |= rows[c] != rows[c][first]
    found = rows[again]
    ends = found["start"].astype(np.int64) + LENGTH
    return _joined(
        list(zip(*(found[c].tolist() for c in ("ref", "key", "start")), ends.tolist(), strict=True))
    )


class _Sorter:
    """Collects suffixes up to a run's size and yields the run's pieces."""

    def __init__(self, splitters: list[bytes], crowded: np.ndarray):
        self.splitters, self.crowded = splitters, crowded
        self.strings = _Strings(len(splitters) + 1)
        self.clear()

    def clear(self) -> None:
        self.keys: list[bytes] = []
        self.rights: list[int] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, ref: int, key: int, text: bytes) -> None:
        raw = np.frombuffer(text, dtype=np.uint8)
        pos, first, last, gram = anchors(raw)
        if len(self.crowded):
            near = np.minimum(np.searchsorted(self.crowded, gram), len(self.crowded) - 1)
            calm = self.crowded[near] != gram
            if not calm.all():
                self.strings.wait(ref, key, text, first[~calm], last[~calm])
            pos, first, last = pos[calm], first[calm], last[calm]
        end = last + LENGTH
        for p, a, b in zip(pos.tolist(), first.tolist(), end.tolist(), strict=True):
            self.keys.append(text[p:b] + text[a:p])
        self.rights.extend((end - pos).tolist())
        places = np.zeros(len(pos), dtype=_PLACES)
        places["ref"], places["key"], places["pos"] = ref, key, pos
        self.places.append(places)
        self.size += len(text)

    def run(self) -> Iterator[tuple[int, bytes]]:
        """``part, blob``: a piece per range; after the ranges come parts for repeats within
        the run, and after these parts for the strings at crowded grams.
        """
        yield from self.strings.full()
        yield from self.strings.rest()
        if not self.keys:
            self.clear()
            return
        places = np.concatenate(self.places)
        keys, rights = self.keys, self.rights
        self.clear()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        kept: list[int] = []
        marks: list[tuple[int, int, int, int]] = []
        before: dict[int, int] = {}  # of one key: right length to the index in ``kept``
        last = None
        for i in order:
            key, right = keys[i], rights[i]
            if key != last:
                before, last = {}, key
            at = before.get(right)
            if at is None:
                before[right] = len(kept)
                kept.append(i)
                continue
            j = kept[at]
            one, two = places[i].item(), places[j].item()
            if one == two:
                continue  # a repeated row is the same document
            if one < two:
                kept[at], one = i, two
            ref, doc_key, pos = one
            marks.append((ref, doc_key, pos - len(key) + right, pos + right))
        keys = [keys[i] for i in kept]
        rights = [rights[i] for i in kept]
        places = places[kept]
        parts = len(self.splitters) + 1
        cuts = [0, *(bisect_left(keys, s) for s in self.splitters), len(keys)]
        for part in range(parts):
            a, b = cuts[part], cuts[part + 1]
            if a < b:
                yield part, _front_coded(keys[a:b], rights[a:b], places[a:b])
        if marks:
            joined = _joined(marks)
            yield parts + zlib.crc32(keys[0]) % parts, _packed(joined)


def _joined(marks: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Marks sorted, those that touch within a document as one."""
    out: list[tuple[int, int, int, int]] = []
    for ref, key, start, end in sorted(marks):
        if out and out[-1][:2] == (ref, key) and start <= out[-1][3]:
            if end > out[-1][3]:
                out[-1] = (ref, key, out[-1][2], end)
        else:
            out.append((ref, key, start, end))
    return out


def _merge_range(blobs: list[bytes]) -> list[tuple[int, int, int, int]]:
    marks: list[tuple[int, int, int, int]] = []
    group: list[tuple[bytes, int, tuple]] = []

    def close() -> None:
        if len(group) > 1:
            for (ref, key, pos), low, high in _repeats(group):
                marks.append((ref, key, pos - high, pos - low + LENGTH))
        group.clear()

    for shared, key, right, place in merged(blobs):
        if shared < GRAM:
            close()
        group.append((key, right, place))
    close()
    return _joined(marks)


# --- crowded grams -------------------------------------------------------------------


def _crowded(texts: DataFrame) -> np.ndarray:
    """Hashes of the grams at which more than CROWD suffixes would meet in the merge.

    Suffixes that are equal within a run count once, as the run reduces them.
    """
    run_bytes, least = RUN_BYTES, CROWD_IN_RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        wholes: list[np.ndarray] = []
        size = 0

        def counts() -> Iterator[pa.RecordBatch]:
            gram = np.concatenate(grams)
            both = gram ^ (np.concatenate(wholes) * np.uint64(0x9E3779B97F4A7C15))
            found, n = np.unique(gram[np.unique(both, return_index=True)[1]], return_counts=True)
            often = n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))],
                ["gram", "n"],
            )

        for batch in batches:
            for value in batch["text"]:
                text = value.as_py().encode("utf-8", "surrogatepass")
                _, _, _, gram, whole = anchors(np.frombuffer(text, dtype=np.uint8), whole=True)
                grams.append(gram)
                wholes.append(whole)
                size += len(text)
                if size >= run_bytes:
                    yield from counts()
                    grams, wholes, size = [], [], 0
        if grams:
            yield from counts()

    counted = texts.select("text").mapInArrow(run, "gram long, n long")
    sums = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > CROWD)
    return np.array(sorted(r["gram"] for r in sums.collect()), dtype=np.int64).view(np.uint64)


# --- the operator --------------------------------------------------------------------


def _splitters(texts: DataFrame, parts: int) -> list[bytes]:
    """Bounds of ``parts`` ranges, from the suffixes of a bounded, fixed choice of documents."""
    if parts < 2:
        return []
    n = texts.count()
    share = min(1.0, max(SAMPLE_DOCS, parts) / max(n, 1))
    chosen = texts.where(
        F.pmod(F.xxhash64("doc_ref", "doc_key", F.lit("s")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                raw = text.as_py().encode("utf-8", "surrogatepass")
                pos = anchors(np.frombuffer(raw, dtype=np.uint8))[0]
                step = max(1, len(pos) // SAMPLE_EACH)
                out += [raw[p : p + _SPLIT] for p in pos[::step][:SAMPLE_EACH].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["s"])

    found = sorted(bytes(r[0]) for r in chosen.select("text").mapInArrow(run, "s binary").collect())
    if not found:
        return []
    return sorted({found[len(found) * i // parts] for i in range(1, parts)})


def _marks(texts: DataFrame) -> DataFrame:
    """``doc_ref, doc_key, start, end``: stretches covered by repeated strings."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splitters = _splitters(texts, max(1, -(-total // RANGE_BYTES)))
    parts = len(splitters) + 1
    crowded = _crowded(texts)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(splitters, crowded)

        def pieces(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            for part, blob in found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([blob], pa.binary())],
                    ["part", "blob"],
                )

        for batch in batches:
            for ref, key, text in zip(
                batch["doc_ref"], batch["doc_key"], batch["text"], strict=True
            ):
                sorter.add(
                    ref.as_py(), key.as_py(), text.as_py().encode("utf-8", "surrogatepass")
                )
                yield from pieces(sorter.strings.full())
                if sorter.size >= RUN_BYTES:
                    yield from pieces(sorter.run())
        yield from pieces(sorter.run())

    def marks_of(part: int, blobs: list[bytes]) -> np.ndarray:
        if part < parts:
            return np.array(_merge_range(blobs), dtype=_MARKS)
        if part >= 2 * parts:
            return np.array(_later_strings(blobs), dtype=_MARKS)
        return np.concatenate(
            [np.frombuffer(zstandard.decompress(b), dtype=_MARKS) for b in blobs]
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch["part"], batch["blob"], strict=True):
                pieces.setdefault(part.as_py(), []).append(blob.as_py())
        for part in sorted(pieces):
            marks = marks_of(part, pieces.pop(part))
            columns = [marks[c].astype(np.int64) for c in ("ref", "key", "start", "end")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["doc_ref", "doc_key", "start", "end"]
            )

    runs = texts.mapInArrow(sort, "part int, blob binary")
    schema = "doc_ref long, doc_key long, start long, end long"
    # every part is a partition of its own, so no task gets two ranges
    return runs.repartitionById(3 * parts, "part").mapInArrow(merge, schema)


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs``.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of LENGTH bytes that
    covers it also starts earlier: in a smaller id, or at an earlier place of the same
    document. Strings are judged on the input and do not cross documents; shorter texts
    stay whole. ``kept`` holds the bytes left, ``n_spans`` counts the stretches removed.
    A null id is least; of rows with one id and different texts the order is that of a
    hash of the text; rows that repeat both are one document. Other columns are ignored;
    an empty table gives an empty result.
    """
    text = full_text(text_col)
    doc_id = F.col(f"`{id_col}`").cast("long")
    texts = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(-(2**63))).alias("doc_ref"),
        F.xxhash64(text).alias("doc_key"),
        text.alias("text"),
    )
    marks = stage(_marks(texts.drop("doc_id")), "marks")
    spans = marks.groupBy("doc_ref", "doc_key").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    joined = texts.join(stage(spans, "spans"), ["doc_ref", "doc_key"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.binary()]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text, spans in zip(
                    part["doc_id"], part["text"], part["spans"], strict=True
                ):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    kept, at_byte, n = [], 0, 0
                    for a, b in _spans(spans.as_py()):
                        kept.append(raw[at_byte:a])
                        at_byte, n = b, n + 1
                    left = b"".join([*kept, raw[at_byte:]])
                    rows.append((doc_id.as_py(), len(raw), len(raw) - len(left), n, left))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names,
                )

    return joined.select("doc_id", "text", "spans").mapInArrow(cut, schema)


def _spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [
        (a, b) for _, _, a, b in _joined([(0, 0, s["start"], s["end"]) for s in spans or ()])
    ]
