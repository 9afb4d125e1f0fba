"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes.

A text's features are the character n-grams it holds, once each, hashed into a
fixed number of bins. Each is scaled by its log-count ratio, the logarithm of how
much more often it occurs in toxic training texts than in others, and a logistic
regression is fitted on the scaled features. Ratio and coefficient multiply to one
weight per bin, so a model is one array of fixed length, whatever the corpus.

The fit is L-BFGS on the driver; the executors add up the tasks' losses and gradients. It
searches in the space of the ratio-scaled features. Dividing them by their deviation
first, as MLlib does, makes rare bins as steep as telling ones and loses recall.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import full_text, stage

#: Lengths of the n-grams in characters.
SIZES = (3, 4, 5)
#: Bins are two to this power.
BITS = 17
#: About so many labelled rows train a model at most, in the shares the classes have.
TRAIN_ROWS = 1_000_000
#: N-grams in fewer training texts say nothing.
MIN_TEXTS = 4
#: Tasks at most that share the training rows. Each shuffles one gradient of all bins (1 MB)
#: per round, so their number is bounded, not left to the number of files.
FIT_TASKS = 64
#: Numbers of a gradient that travel together.
_NUMBERS = 1 << 15
#: Training texts whose bins are stored together.
_BLOCK = 64

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Characters that are hashed at once; a long text is walked in such pieces.
_PIECE = 1 << 18


def bins_of(text: str) -> np.ndarray:
    """The distinct bins of a text's n-grams, in no particular order."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    slots = np.zeros(1 << BITS, dtype=bool)
    overlap = max(SIZES) - 1
    for at in range(0, len(points), _PIECE):
        part = points[at : at + _PIECE + overlap].astype(np.uint64)
        grams = part
        for size in range(2, max(SIZES) + 1):
            if len(part) < size:
                break
            grams = grams[:-1] * _FACTOR + part[size - 1 :]
            if size in SIZES:
                mixed = (grams ^ (grams >> np.uint64(31))) * (_MIX + np.uint64(2 * size))
                slots[mixed >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(slots).astype(np.int32)


@dataclasses.dataclass(frozen=True)
class ToxicityModel:
    """One weight per bin and an intercept. A few hundred kilobytes at any scale."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        margin = self.intercept + float(self.weights[bins_of(text)].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500.0, 500.0))))


def _judged(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic``, one row per id; null ids or labels do not count."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )


def _oversampling(labels: DataFrame, rows: int) -> float:
    """Log of how much likelier ``training_ids`` with ``even`` takes a toxic id than another."""
    half = max(1, rows // 2)
    sizes = {r["toxic"]: r["count"] for r in _judged(labels).groupBy("toxic").count().collect()}
    taken = {c: min(1.0, half / sizes[c]) if sizes.get(c) else 1.0 for c in (0, 1)}
    return float(np.log(taken[1] / taken[0]))


def training_ids(labels: DataFrame, rows: int = TRAIN_ROWS, even: bool = False) -> DataFrame:
    """``doc_id, toxic``: all labelled ids, or about ``rows`` of them if there are more.

    Ids are taken by a hash that does not see the class, so classes keep their shares and
    the choice is the same at each run. With ``even`` at most ``rows`` are taken, at most
    half of them from either class. Null ids or labels do not count; an id with both
    labels is toxic.
    """
    one = _judged(labels)
    if even:
        order = [F.xxhash64("doc_id"), F.col("doc_id")]
        half = max(1, rows // 2)
        toxic = one.where("toxic = 1").orderBy(*order).limit(half)
        return toxic.union(one.where("toxic = 0").orderBy(*order).limit(half))
    n = one.count()
    if n <= rows:
        return one
    return one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def _features(texts: DataFrame) -> DataFrame:
    """``labels, sizes, gaps`` per block of training texts, each array as bytes.

    Bins of the block's texts follow each other, text number in the upper bits; stored are
    the gaps between them, byte plane by byte plane, which takes about a byte per bin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _BLOCK):
                part = batch.slice(at, _BLOCK)
                bins = [bins_of(t) for t in part["text"].to_pylist()]
                places = np.concatenate([b + (i << BITS) for i, b in enumerate(bins)])
                gaps = np.diff(places, prepend=0).astype("<u4")
                planes = gaps.view(np.uint8).reshape(-1, 4).T.tobytes()
                row = [
                    np.array(part["toxic"].to_pylist(), np.uint8).tobytes(),
                    np.array([len(b) for b in bins], "<u4").tobytes(),
                    zstandard.compress(planes, 1),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.binary()) for x in row], ["labels", "sizes", "gaps"]
                )

    return texts.mapInArrow(run, "labels binary, sizes binary, gaps binary")


def _blocks(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``labels, sizes, bins`` of each block that ``_features`` made."""
    for batch in batches:
        for labels, sizes, gaps in zip(*(batch[c] for c in range(3)), strict=True):
            planes = np.frombuffer(zstandard.decompress(gaps.as_py()), np.uint8).reshape(4, -1)
            places = np.cumsum(planes.T.copy().view("<u4").ravel(), dtype=np.int32)
            yield (
                np.frombuffer(labels.as_py(), np.uint8),
                np.frombuffer(sizes.as_py(), "<u4"),
                places & ((1 << BITS) - 1),
            )


def _summed(features: DataFrame, of_block: Callable, sizes: list[int]) -> list[np.ndarray]:
    """The arrays that ``of_block(labels, sizes, bins)`` gives, added up over all blocks.

    ``sizes`` are their lengths. Tasks send them in pieces, the executors add each piece up,
    and the driver gets every number once, however many tasks there are.
    """
    width = sum(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for block in _blocks(batches):
            total += np.concatenate(of_block(*block))
        for at in range(0, width, _NUMBERS):
            row = [pa.array([at]), pa.array([total[at : at + _NUMBERS]], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(row, ["at", "sums"])

    parts = features.coalesce(FIT_TASKS).mapInArrow(run, "at long, sums array<double>")
    added = parts.groupBy("at").agg(Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums"))
    total = np.zeros(width)
    for batch in added.select("at", vector_to_array("sums").alias("sums")).toArrow().to_batches():
        for at, sums in zip(batch["at"].to_pylist(), batch["sums"], strict=True):
            total[at : at + len(sums)] = sums.values.to_numpy()
    return np.split(total, np.cumsum(sizes)[:-1])


def _log_ratios(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Log-count ratio of each bin in ``p`` toxic and ``q`` other texts, 0 where too few hold it."""
    ratios = np.zeros(1 << BITS)
    enough = p + q >= MIN_TEXTS
    p, q = p[enough] + 1.0, q[enough] + 1.0
    if len(p):
        ratios[enough] = np.log(p / p.sum()) - np.log(q / q.sum())
    return ratios


def _least(
    f: Callable[[np.ndarray], tuple[float, np.ndarray]],
    x: np.ndarray,
    rounds: int,
    history: int = 10,
    tolerance: float = 1e-6,
) -> np.ndarray:
    """Where the convex ``f`` (value and gradient) is least, by L-BFGS from ``x``."""
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, shares = slope.copy(), []
        for s, y in reversed(steps):
            shares.append((s @ way) / (y @ s))
            way -= shares[-1] * y
        if steps:
            s, y = steps[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(float(np.linalg.norm(slope)), 1e-12)
        for (s, y), share in zip(steps, reversed(shares), strict=True):
            way += s * (share - (y @ way) / (y @ s))
        size, fall = 1.0, float(slope @ way)
        while True:
            there = x - size * way
            new_value, new_slope = f(there)
            if new_value <= value - 1e-4 * size * fall:
                break
            size /= 2
            if size < 1e-8:
                return x
        s, y = there - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-history:]
        settled = value - new_value <= tolerance * max(abs(value), 1e-3)
        x, value, slope = there, new_value, new_slope
        if settled:
            break
    return x


def _fitted(
    features: DataFrame, ratios: np.ndarray, texts: int, share: float, penalty: float, rounds: int
) -> tuple[np.ndarray, float]:
    """Weights per bin and intercept of the logistic regression on ratio-scaled bins."""
    context = features.sparkSession.sparkContext
    size = 1 << BITS

    def loss(point: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast((ratios * point[:-1], float(point[-1])))

        def of_block(labels: np.ndarray, sizes: np.ndarray, bins: np.ndarray) -> list[np.ndarray]:
            weights, intercept = shared.value
            margins = np.full(len(labels), intercept)
            held = sizes > 0
            if held.any():
                starts = (np.cumsum(sizes) - sizes)[held].astype(np.int64)
                margins[held] += np.add.reduceat(weights[bins], starts)
            sign = 2.0 * labels - 1.0
            losses = np.logaddexp(0.0, -sign * margins)
            errors = -sign / (1.0 + np.exp(np.clip(sign * margins, -500.0, 500.0)))
            slopes = np.bincount(bins, np.repeat(errors, sizes), size)
            return [slopes, np.array([losses.sum(), errors.sum()])]

        slopes, (total, errors) = _summed(features, of_block, [size, 2])
        shared.destroy()
        inner = point[:-1]
        value = float(total) / texts + penalty / 2 * float(inner @ inner)
        return value, np.append(ratios * slopes / texts + penalty * inner, errors / texts)

    start = np.append(np.zeros(size), np.log(share / (1 - share)))
    found = _least(loss, start, rounds)
    return ratios * found[:-1], float(found[-1])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = TRAIN_ROWS,
    max_iter: int = 100,
    penalty: float = 1e-3,
    even: bool = False,
) -> ToxicityModel:
    """Fit on the documents that ``labels`` (``doc_id, toxic``) marks.

    Only texts enter the features. Null text is empty text. Where the labels know
    one class only, or nothing, the model is that class's share for every text, one
    half without any label. All labelled rows train up to ``rows``, above it a choice in
    the same class shares. ``even`` draws the classes evenly, for labels of which next to
    none are toxic; the intercept then takes the uneven sampling back.
    """
    chosen = training_ids(labels, rows, even)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), full_text(text_col).alias("text"))
    # The list of ids is bounded by ``rows``, so the documents stay where they are.
    features = stage(_features(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")),
                     "features")

    def counts(labels: np.ndarray, sizes: np.ndarray, bins: np.ndarray) -> list[np.ndarray]:
        toxic = np.repeat(labels == 1, sizes)
        size = 1 << BITS
        return [
            np.bincount(bins[toxic], minlength=size),
            np.bincount(bins[~toxic], minlength=size),
            np.array([(labels == 1).sum(), len(labels)]),
        ]

    p, q, (toxic, n) = _summed(features, counts, [1 << BITS, 1 << BITS, 2])
    toxic, n = int(toxic), int(n)
    if toxic in (0, n):
        share = 0.5 if not n else (0.999 if toxic else 0.001)
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    weights, intercept = _fitted(features, _log_ratios(p, q), n, toxic / n, penalty, max_iter)
    if even:
        intercept -= _oversampling(labels, rows)
    return ToxicityModel(weights.astype(np.float32), intercept)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """The probability that a text is toxic. A text without n-grams gets the intercept's."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return score(text)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows no label is learned from: CRC of the id's text in fold 0. A null id counts as ''."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == 0


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The model is fitted on labelled rows that are not held out. Rows that repeat
    are scored alike; an empty table gives an empty result; other columns are ignored.
    """
    train = labels.where(~held_out("doc_id")).select("doc_id", "toxic")
    model = fit_toxicity(docs, train, id_col, text_col, rows)
    scored = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        held_out(id_col).alias("held_out"),
        toxicity_score(full_text(text_col), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that score under one half, with all their columns."""
    train = labels.where(~held_out("doc_id")).select("doc_id", "toxic")
    model = fit_toxicity(docs, train, id_col, text_col)
    return docs.where(toxicity_score(full_text(text_col), model) < 0.5)
