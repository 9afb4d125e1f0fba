"""Records of delimited files whose quoted fields may hold line breaks.

Large files are read as lines, in as many splits as Spark makes of them. Whether a line
break ends a record depends on the quotes before it, so a split cannot tell by itself
where its first record begins. But each line does one of four things to the two states a
line can begin in, outside or inside quotes, and what a split does follows from its lines.
The splits' effects, a few bytes each, are composed in file order, which gives the state
each split begins in. Then every split cuts its own records; the few that cross into the
next split are put together from their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a line does: bit 0 is set if it ends inside quotes when it began outside, bit 1 if
# it ends inside when it began inside.
_CLOSES, _SWAPS, _NOTHING = 0, 1, 2
_SPLIT = ["file", "split"]


def read_lines(reader, path: str) -> DataFrame:
    """``file, split, line`` of the splits that begin at byte ``split`` of a file.

    ``reader`` is ``spark.read`` with its options. Only a line feed ends a line.
    """
    return reader.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").alias("line"),
    )


def quote_effect(line: Column, separator: str) -> Column:
    """One of four numbers for what the quotes of a line do.

    A quote opens a field only as its first character; inside quotes a doubled quote is
    text; what stands between a closing quote and the next separator belongs to the field.
    """
    rest = f"[^{separator}]*+"
    quoted = '"[^"]*+(?:""[^"]*+)*+'
    fields = f'(?:(?:{quoted}"{rest}|[^"{separator}]{rest})?+{separator})*+'
    opens = rf"\A{fields}{quoted}\z"
    stays = rf'\A[^"]*+(?:""[^"]*+)*+(?:\z|"{rest}{separator}{fields}{quoted}\z)'
    found = line.rlike(opens).cast("int") + line.rlike(stays).cast("int") * 2
    return F.when(F.contains(line, F.lit('"')), found).otherwise(F.lit(_NOTHING))


def _bit(code: Column, state: Column) -> Column:
    return F.call_function("shiftright", code, state).bitwiseAND(F.lit(1))


def _after(lines: Column, begin: int) -> Column:
    """``state, opened, closed`` after the lines of a split that begins in state ``begin``.

    ``opened`` is the last line that went from outside to inside, ``closed`` the first
    that went back; ``lines`` holds ``at, code`` of those that do anything.
    """
    start = F.struct(
        F.lit(begin).alias("state"),
        F.lit(None).cast("long").alias("opened"),
        F.lit(None).cast("long").alias("closed"),
    )

    def step(so_far: Column, line: Column) -> Column:
        state = _bit(line.code, so_far.state)
        return F.struct(
            state.alias("state"),
            F.when((so_far.state == 0) & (state == 1), line["at"])
            .otherwise(so_far.opened)
            .alias("opened"),
            F.when(so_far.closed.isNull() & (so_far.state == 1) & (state == 0), line["at"])
            .otherwise(so_far.closed)
            .alias("closed"),
        )

    return F.aggregate(lines, start, step)


def splits_of(lines: DataFrame, separator: str) -> DataFrame:
    """``file, split, least, begins, ends, opened, closed``: each split's states, 1 for inside.

    ``least`` is its first line. A split is one task's rows, so only what its quotes do
    leaves the task.
    """
    code = quote_effect(F.col("line"), separator)
    acting = F.when(code != _NOTHING, F.struct("at", code.alias("code")))
    folded = (
        lines.groupBy(*_SPLIT)
        .agg(F.min("at").alias("least"), F.sort_array(F.collect_list(acting)).alias("acting"))
        .select(
            *_SPLIT,
            "least",
            _after(F.col("acting"), 0).alias("out"),
            _after(F.col("acting"), 1).alias("in"),
        )
    )
    swaps = (F.col("out.state") == 1) & (F.col("in.state") == 0)
    settles = F.col("out.state") == F.col("in.state")
    in_file = Window.partitionBy("file").orderBy("split")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(swaps.cast("int"))
    counted = folded.withColumn("turns", turns.over(in_file))
    # the last split that settles the state, and the swaps since then
    last = F.last(
        F.when(settles, F.struct(F.col("out.state").alias("state"), "turns")), ignorenulls=True
    ).over(before)
    since = F.coalesce(turns.over(before), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    begins = F.pmod(F.coalesce(last["state"], F.lit(0)) + since, F.lit(2)).cast("int")
    found = counted.withColumn("begins", begins)
    real = F.when(F.col("begins") == 0, F.col("out")).otherwise(F.col("in"))
    return found.select(*_SPLIT, "least", "begins", real.alias("real")).select(
        *_SPLIT,
        "least",
        "begins",
        F.col("real.state").alias("ends"),
        F.col("real.opened").alias("opened"),
        F.col("real.closed").alias("closed"),
    )


def _states(codes: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each line, and after all."""
    if not np.isin(codes, (_NOTHING, _SWAPS)).all():
        before = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            before[i] = state
            state = code >> state & 1
        return before, state
    turned = np.cumsum(codes == _SWAPS)
    before = (state + turned - (codes == _SWAPS)) & 1
    return before, int(state + turned[-1]) & 1


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``name, split, begins, code, line`` to records ``first, record``.

    Both ends of a split that belong to a record of two splits are left out.
    """
    here, state, first, waiting = None, 0, False, None

    for batch in batches:
        names, splits, begins, codes = (batch[c].to_numpy(False) for c in range(4))
        lines = batch["line"]
        turns = np.flatnonzero((names[1:] != names[:-1]) | (splits[1:] != splits[:-1])) + 1
        for low, high in zip([0, *turns], [*turns, len(batch)], strict=True):
            place = (int(names[low]), int(splits[low]))
            if place != here:
                here, state, waiting = place, int(begins[low]), None
                first = place[1] == 0
            before, state = _states(codes[low:high], state)
            starts = low + np.flatnonzero(before == 0)
            ends = np.append(starts[1:], high)
            done = []
            if waiting is not None:
                until = starts[0] if len(starts) else high
                waiting += lines.slice(low, until - low).to_pylist()
                if len(starts):
                    done.append("\n".join(waiting))
                    waiting = None
            if len(starts) and state:
                waiting = lines.slice(starts[-1], high - starts[-1]).to_pylist()
                starts, ends = starts[:-1], ends[:-1]
            if not done and (ends - starts == 1).all():
                found = lines.take(pa.array(starts))
            else:
                values = lines.slice(low, high - low).to_pylist()
                for start, end in zip((starts - low).tolist(), (ends - low).tolist(), strict=True):
                    done.append("\n".join(values[start:end]))
                found = pa.array(done, pa.string())
            if len(found):
                firsts = np.zeros(len(found), bool)
                firsts[0], first = first, False
                yield pa.RecordBatch.from_arrays([pa.array(firsts), found], ["first", "record"])


def _cut_lines(lines: DataFrame, separator: str, begins: Column) -> DataFrame:
    return lines.select(
        F.xxhash64("file").alias("name"),
        "split",
        begins.alias("begins"),
        quote_effect(F.col("line"), separator).alias("code"),
        "line",
    ).mapInArrow(_cut, "first boolean, record string")


def _crossing(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``first, record`` of the records that lie in two splits or more.

    One record at most ends in each of a split's sides, so little is moved.
    """
    touched = splits.where("begins = 1 OR ends = 1")
    head = (F.col("begins") == 1) & (F.col("closed").isNull() | (F.col("at") <= F.col("closed")))
    tail = (F.col("ends") == 1) & (F.col("at") >= F.col("opened"))
    parts = (
        lines.join(F.broadcast(touched), _SPLIT)
        .where(head | tail)
        .groupBy(*_SPLIT, (F.coalesce(tail, F.lit(False))).alias("opens"))
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"),
            F.max("closed").alias("closed"),
            F.min("least").alias("least"),
        )
    )
    order = Window.partitionBy("file").orderBy("split", "opens")
    numbered = parts.withColumn("nr", F.sum(F.col("opens").cast("int")).over(order))
    joined = numbered.groupBy("file", "nr").agg(
        F.array_sort(F.collect_list(F.struct("split", "opens", "lines", "least"))).alias("parts"),
        F.max(F.struct("split", "opens", F.col("closed").isNotNull().alias("closed"))).alias("last"),
    )
    record = F.array_join(F.flatten("parts.lines")["line"], "\n")
    shown = F.concat(F.lit("unclosed quote: "), F.substring(record, 1, 200))
    closed = F.when(
        F.col("last.opens") | ~F.col("last.closed"), F.raise_error(shown).cast("boolean")
    ).otherwise(F.lit(True))
    start = F.get("parts", F.lit(0))
    first = (start["split"] == 0) & (F.get(start["lines"], F.lit(0))["at"] == start["least"])
    return joined.where(closed).select(first.alias("first"), record.alias("record"))


def records(spark: SparkSession, path: str, separator: str, header: bool) -> DataFrame:
    """``record`` per record of the files; without the first of each file if it is a header.

    The files are scanned three times, each time by all splits in parallel: for the
    quotes, for the records, and for those that cross splits. What is broadcast has a row
    per split, as the driver's own list of tasks does.
    """
    lines = read_lines(spark.read, path).withColumn("at", F.monotonically_increasing_id())
    splits = splits_of(lines, separator)
    known = lines.join(F.broadcast(splits.select(*_SPLIT, "begins")), _SPLIT)
    inner = _cut_lines(known, separator, F.col("begins"))
    return _finished(inner.union(_crossing(lines, splits)), header)


def stream_records(
    reader, path: str, separator: str, header: bool, options: dict[str, str], n_fields: int
) -> DataFrame:
    """``record`` of streamed files, which Spark's CSV reader cuts.

    A batch of a stream sees each split once, so here a file is one task's, which reads it
    record by record whatever its size; the files of a batch are read in parallel. With a
    field more than records have none fits, and the reader hands out what it was parsing.
    """
    raw, fields = "_record", [f"_{i}" for i in range(n_fields + 1)]
    reader = reader.options(**options).option("header", header).option("multiLine", True)
    reader = reader.option("lineSep", "\n").option("columnNameOfCorruptRecord", raw)
    found = reader.schema(", ".join(f"{c} string" for c in [*fields, raw])).csv(path)
    more = F.concat(F.lit("more fields than columns: "), F.concat_ws(separator, *fields))
    shown = F.concat(F.lit("unclosed quote: "), F.substring(raw, 1, 200))
    open_ = quote_effect(F.col(raw), separator).bitwiseAND(F.lit(1)) == 1
    record = F.when(open_, F.raise_error(shown).cast("string")).otherwise(
        F.coalesce(F.col(raw), F.raise_error(more).cast("string"))
    )
    return _whole(found.select(record.alias("record")))


def _finished(found: DataFrame, header: bool) -> DataFrame:
    return _whole(found.where("NOT first") if header else found)


def _whole(found: DataFrame) -> DataFrame:
    record = F.regexp_replace("record", r"\r\z", "")
    return found.select(record.alias("record")).where("record <> ''")
