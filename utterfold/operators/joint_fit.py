"""One solver for many binary logistic regressions that share their features.

Every label's regression is a problem of its own, but all of them read the same rows.
So all are solved side by side: a pass over the rows gives the loss and the gradient of
every label that has not settled yet, each label takes its own L-BFGS step, and the
number of passes is that of the slowest label whatever the number of labels.

The problem is the one MLlib solves: mean log loss plus an L2 penalty on the coefficients
of features scaled to unit deviation, the intercept free. Rows are stored once as blocks
of sparse arrays. A task streams its blocks, a slice of the labels at a time, and adds up
their gradients; the tasks' sums are added in Spark, so the driver gets each number once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Most coefficients of a joint fit. A task holds two numbers for each and the driver about
#: two dozen, so the bound means 256 MB in a task.
MAX_COEFFICIENTS = 1 << 24
#: Rows of a block, labels worked on at once, and numbers that travel together.
BLOCK_ROWS, SLICE_LABELS, CHUNK = 512, 64, 1 << 16
HISTORY = 8

_BLOCK = (
    "ptr binary, held binary, place binary, val binary, label_ptr binary, label_idx binary"
)


def _narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes that hold them all."""
    most = numbers.max(initial=0)
    kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"
    return numbers.astype(kind).tobytes()


def _wide(stored: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of :func:`_narrow`."""
    kind = {1: "<u1", 2: "<u2", 4: "<u4"}[len(stored) // n] if n else "<u1"
    return np.frombuffer(stored, kind).astype(np.intp)


def _narrow_values(values: np.ndarray) -> bytes:
    """Values as they are, or in a byte each if all are whole and small, as counts are."""
    small = ((values >= 0) & (values < 256)).all() and (values == np.floor(values)).all()
    return values.astype("<u1" if small else "<f8").tobytes()


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of a column of lists, and how many each row has; null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), sizes.astype(np.int64)


def _stored_blocks(rows: DataFrame) -> DataFrame:
    """``features, labels`` as blocks: row starts, bins and values; starts and positive labels.

    A block names the bins it holds once, and each value by its bin's place among them. The
    blocks are dealt evenly, for the slowest task ends a pass.
    """
    positive = F.filter(
        F.transform("labels", lambda y, i: F.when(y > 0, i)), lambda i: i.isNotNull()
    )
    vector = F.unwrap_udt("features")
    every = F.sequence(F.lit(0), F.greatest(F.size(vector["values"]), F.lit(1)) - 1)
    plain = rows.select(
        F.coalesce(vector["indices"], F.slice(every, F.lit(1), F.size(vector["values"]))).alias(
            "indices"
        ),
        vector["values"].alias("values"),
        positive.alias("positive"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                all_bins, sizes = _rows_of(part["indices"])
                values, _ = _rows_of(part["values"])
                labels, label_sizes = _rows_of(part["positive"])
                used = values != 0
                row_of = np.repeat(np.arange(len(sizes)), sizes)[used]
                all_bins, values = all_bins[used], values[used]
                held, place = np.unique(all_bins, return_inverse=True)
                row = [
                    np.cumsum([0, *np.bincount(row_of, minlength=len(sizes))]).astype("<i8"),
                    held.astype("<i4"),
                    _narrow(place),
                    _narrow_values(values),
                    np.cumsum([0, *label_sizes]).astype("<i8"),
                    labels.astype("<i4"),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bytes(x)], pa.binary()) for x in row],
                    [c.split()[0] for c in _BLOCK.split(", ")],
                )

    cores = rows.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(plain.mapInArrow(run, _BLOCK).repartition(cores))


@dataclass
class _Block:
    """A block's rows: the bins that occur, and for each value which of them is its own."""

    n: int
    held: np.ndarray
    place: np.ndarray
    values: np.ndarray
    row_of: np.ndarray
    filled: np.ndarray
    starts: np.ndarray
    label_row: np.ndarray
    label_idx: np.ndarray

    @staticmethod
    def read(
        ptr: bytes, held: bytes, place: bytes, val: bytes, label_ptr: bytes, label_idx: bytes
    ) -> _Block:
        starts = np.frombuffer(ptr, "<i8")
        n = int(starts[-1])
        sizes = np.diff(starts)
        label_sizes = np.diff(np.frombuffer(label_ptr, "<i8"))
        return _Block(
            len(sizes),
            np.frombuffer(held, "<i4"),
            _wide(place, n),
            np.frombuffer(val, "<u1" if len(val) == n else "<f8").astype(np.float64),
            np.repeat(np.arange(len(sizes)), sizes),
            np.flatnonzero(sizes),
            starts[:-1][sizes > 0],
            np.repeat(np.arange(len(sizes)), label_sizes),
            np.frombuffer(label_idx, "<i4"),
        )

    @property
    def bins(self) -> np.ndarray:
        return self.held[self.place]

    @property
    def by_bin(self) -> np.ndarray:
        """The order of the values by their bins."""
        return np.argsort(self.place, kind="stable")

    @property
    def bin_starts(self) -> np.ndarray:
        """Where in that order each bin that occurs begins."""
        sizes = np.bincount(self.place, minlength=len(self.held))
        return np.cumsum(sizes) - sizes

    def margins(self, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
        """Labels by rows; ``weights`` has a row per label.

        Label by label, so that every step runs along memory.
        """
        out = np.repeat(intercepts[:, None], self.n, axis=1)
        if len(self.place):
            for own, found in zip(weights, out, strict=True):
                terms = own.take(self.held).take(self.place)
                terms *= self.values
                found[self.filled] += np.add.reduceat(terms, self.starts)
        return out

    def add_by_bin(self, per_row: np.ndarray, out: np.ndarray) -> None:
        """Add each row's numbers times its values to the rows' bins, label by label."""
        if len(self.place):
            for own, total in zip(per_row, out, strict=True):
                terms = own.take(self.row_of)
                terms *= self.values
                total[self.held] += np.bincount(self.place, terms, len(self.held))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            yield _Block.read(*row)


def _summed(
    blocks: DataFrame, sums_of: Callable[[Iterator[_Block]], Iterator[np.ndarray]], size: int
) -> np.ndarray:
    """The numbers that ``sums_of`` gives per task, ``size`` in all, added over the tasks.

    They travel in chunks, and a chunk's sums are added by the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest = 0, np.zeros(0)
        for part in sums_of(_blocks(batches)):
            rest = np.concatenate([rest, part])
            while len(rest) >= CHUNK:
                yield chunk(at, rest[:CHUNK])
                at, rest = at + 1, rest[CHUNK:]
        if len(rest):
            yield chunk(at, rest)

    def chunk(at: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([at]), pa.array([values], pa.list_(pa.float64()))], ["at", "sums"]
        )

    added = (
        blocks.mapInArrow(run, "at long, sums array<double>")
        .groupBy("at")
        .agg(Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums"))
        .select("at", vector_to_array("sums").alias("sums"))
    )
    total = np.zeros(size)
    for batch in added.toArrow().to_batches():
        for at, sums in zip(batch["at"].to_pylist(), batch["sums"], strict=True):
            values = sums.values.to_numpy()
            total[at * CHUNK : at * CHUNK + len(values)] = values
    return total


def _statistics(blocks: DataFrame, d: int, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, positives per label, and deviation per bin."""

    def sums_of(found: Iterator[_Block]) -> Iterator[np.ndarray]:
        sums, n, positives = np.zeros((d, 2)), 0, np.zeros(k)
        for block in found:
            n += block.n
            held, size = block.held, len(block.held)
            if size:
                sums[held, 0] += np.bincount(block.place, block.values, size)
                sums[held, 1] += np.bincount(block.place, block.values**2, size)
            positives += np.bincount(block.label_idx, minlength=k)
        yield np.concatenate([[n], positives, sums.ravel()])

    total = _summed(blocks, sums_of, 1 + k + 2 * d)
    n, positives, sums = int(total[0]), total[1 : 1 + k], total[1 + k :].reshape(d, 2)
    variance = (sums[:, 1] - sums[:, 0] ** 2 / max(n, 1)) / max(n - 1, 1)
    return n, positives, np.sqrt(np.maximum(variance, 0.0))


class _Problem:
    """Loss and gradient of the labels ``active`` at given points, one pass per call.

    A point is a row of scaled coefficients and, last, the intercept.
    """

    def __init__(self, blocks: DataFrame, n: int, deviation: np.ndarray, penalty: float):
        self.blocks, self.n, self.penalty = blocks, n, penalty
        self.inverse = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
        self.passes = 0

    def __call__(self, points: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.passes += 1
        d, k = len(self.inverse), len(active)
        raw = points[:, :d] * self.inverse
        shared = self.blocks.sparkSession.sparkContext.broadcast((raw, points[:, d].copy(), active))

        def sums_of(found: Iterator[_Block]) -> Iterator[np.ndarray]:
            weights, intercepts, labels = shared.value
            place = np.full(int(labels.max()) + 1, -1)
            place[labels] = np.arange(len(labels))
            slices = [
                (low, min(low + SLICE_LABELS, len(labels)))
                for low in range(0, len(labels), SLICE_LABELS)
            ]
            # per label the slopes of the bins, the slope of the intercept, and the loss
            sums = np.zeros((len(labels), d + 2))
            for block in found:
                at = np.full(len(block.label_idx), -1)
                known = block.label_idx < len(place)
                at[known] = place[block.label_idx[known]]
                for low, high in slices:
                    margins = block.margins(weights[low:high], intercepts[low:high])
                    inside = (at >= low) & (at < high)
                    truth = np.zeros(margins.shape)
                    truth[at[inside] - low, block.label_row[inside]] = 1.0
                    small = np.exp(-np.abs(margins))
                    share = np.where(margins >= 0, 1.0, small) / (1.0 + small)
                    differ = share - truth
                    total = sums[low:high]
                    block.add_by_bin(differ, total[:, :d])
                    total[:, d] += differ.sum(axis=1)
                    loss = np.maximum(margins, 0.0) + np.log1p(small) - truth * margins
                    total[:, d + 1] += loss.sum(axis=1)
            yield from sums

        total = _summed(self.blocks, sums_of, k * (d + 2)).reshape(k, d + 2) / self.n
        shared.destroy()
        slopes = total[:, : d + 1].copy()
        slopes[:, :d] = slopes[:, :d] * self.inverse + self.penalty * points[:, :d]
        return total[:, d + 1] + self.penalty / 2 * (points[:, :d] ** 2).sum(axis=1), slopes


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _directions(slopes: np.ndarray, history: list) -> np.ndarray:
    """L-BFGS steps for all rows at once; a pair with ``rho`` 0 in a row is unused there."""
    way, shares = slopes.copy(), []
    for s, y, rho in reversed(history):
        share = rho * _dots(s, way)
        way -= share[:, None] * y
        shares.append(share)
    scale = np.full(len(way), -1.0)
    for s, y, rho in reversed(history):
        fresh = (scale < 0) & (rho > 0)
        scale[fresh] = (_dots(s, y) / np.maximum(_dots(y, y), 1e-300))[fresh]
    first = scale < 0
    scale[first] = 1.0 / np.maximum(np.sqrt(_dots(slopes, slopes)), 1.0)[first]
    way *= scale[:, None]
    for (s, y, rho), share in zip(history, reversed(shares), strict=True):
        way += s * (share - rho * _dots(y, way))[:, None]
    return way


def solve_jointly(
    problem: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
    start: np.ndarray,
    max_iter: int,
    tolerance: float,
) -> np.ndarray:
    """The least points of independent convex problems, a row each, solved side by side.

    A row settles when its gradient is shorter than ``tolerance``, or when no step makes
    its value smaller; it then costs nothing more. ``max_iter`` bounds the passes.
    """
    x = start.copy()
    active = np.arange(len(x))
    if not len(active) or max_iter <= 0:
        return x
    value, slope = problem(x, active)
    history: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    way, size = _directions(slope, history), np.ones(len(x))
    for _ in range(max_iter):
        open_ = np.sqrt(_dots(slope, slope)) > tolerance
        open_ &= size > 1e-10
        if not open_.all():
            active, value, slope, way, size = (z[open_] for z in (active, value, slope, way, size))
            history = [tuple(z[open_] for z in pair) for pair in history]
        if not len(active):
            break
        there = x[active] - size[:, None] * way
        new_value, new_slope = problem(there, active)
        # rows whose value falls far enough move on, the others try half the step
        moved = new_value <= value - 1e-4 * size * _dots(slope, way) + 1e-15 * np.abs(value)
        s = np.where(moved[:, None], there - x[active], 0.0)
        y = np.where(moved[:, None], new_slope - slope, 0.0)
        product = _dots(s, y)
        rho = np.divide(1.0, product, out=np.zeros_like(product), where=product > 1e-18)
        x[active[moved]] = there[moved]
        value, slope = np.where(moved, new_value, value), np.where(moved[:, None], new_slope, slope)
        history = [*history, (s, y, rho)][-HISTORY:]
        new_way = _directions(slope, history)
        # a step that does not descend starts over from the gradient
        bad = _dots(new_way, slope) <= 0
        new_way[bad] = slope[bad]
        way = np.where(moved[:, None], new_way, way)
        size = np.where(moved, 1.0, size / 2)
    return x


def fit_joint(
    rows: DataFrame,
    n_labels: int,
    n_features: int,
    penalty: float,
    max_iter: int,
    tolerance: float = 1e-7,
    scale: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (labels by features), intercepts, and which labels were fitted.

    ``rows`` has ``features`` (a vector) and ``labels`` (multi-hot). With ``scale`` the
    coefficients are those of the features times their scale. A label that every row
    has, or none, is not fitted: its intercept comes from smoothed odds.
    """
    if n_labels * n_features > MAX_COEFFICIENTS:
        raise ValueError(
            f"{n_labels} labels with {n_features} features are more than {MAX_COEFFICIENTS} "
            "coefficients; lower n_features"
        )
    blocks = _stored_blocks(rows)
    n, positives, deviation = _statistics(blocks, n_features, n_labels)
    scale = np.ones(n_features) if scale is None else scale
    # a scale of 0 makes a feature constant
    deviation = np.where(scale == 0, 0.0, deviation)
    coefficients = np.zeros((n_labels, n_features))
    varied = (positives > 0) & (positives < n)
    intercepts = np.log((positives + 1) / (n - positives + 1))
    intercepts[varied] = np.log(positives[varied] / (n - positives[varied]))
    fitted = np.flatnonzero(varied)
    if len(fitted):
        start = np.zeros((len(fitted), n_features + 1))
        start[:, -1] = intercepts[fitted]
        problem = _Problem(blocks, n, deviation, penalty)

        def of_rows(points: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return problem(points, fitted[active])

        found = solve_jointly(of_rows, start, max_iter, tolerance)
        coefficients[fitted] = found[:, :-1] * problem.inverse / np.where(scale == 0, 1.0, scale)
        intercepts[fitted] = found[:, -1]
    return coefficients, intercepts, varied
