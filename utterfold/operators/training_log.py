"""Model selection over epoch logs ``run_id, epoch, metric, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = 4096


def _evaluations(log: DataFrame, metric: str, greater_is_better: bool) -> DataFrame:
    """``run_id, epoch, value, gain`` with one row per run and epoch; NaN is no result."""
    sign = 1.0 if greater_is_better else -1.0
    gain = F.col("value") * sign
    return (
        log.filter((F.col("metric") == metric) & F.col("value").isNotNull())
        .filter(~F.isnan("value"))
        .groupBy("run_id", "epoch")
        .agg(F.max(gain).alias("gain"))
        .select("run_id", "epoch", (F.col("gain") * sign).alias("value"), "gain")
    )


def select_best(log: DataFrame, metric: str, greater_is_better: bool = True) -> DataFrame:
    """``run_id, best_epoch, best_value``; the earliest epoch wins a tie."""
    evaluations = _evaluations(log, metric, greater_is_better)
    best = F.max(F.struct("gain", (-F.col("epoch")).alias("earliest"), "value")).alias("best")
    return (
        evaluations.groupBy("run_id")
        .agg(best)
        .select(
            "run_id",
            (-F.col("best.earliest")).alias("best_epoch"),
            F.col("best.value").alias("best_value"),
        )
    )


def early_stop_epoch(
    log: DataFrame, metric: str, patience: int = 3, greater_is_better: bool = True
) -> DataFrame:
    """``run_id, stop_epoch``: where training would have stopped.

    Training stops once ``patience`` evaluations in a row failed to beat the
    best so far. Runs that never reach that point are absent. A run may be
    longer than one task can hold: it is folded in blocks of epochs, and a few numbers
    per block decide. The log is read once.
    """
    if patience < 1:
        raise ValueError("patience must be at least 1")
    blocks = (
        _evaluations(log, metric, greater_is_better)
        .groupBy("run_id", F.floor(F.col("epoch") / _BLOCK).alias("block"))
        .agg(
            F.sort_array(F.collect_list(F.struct("epoch", "gain"))).alias("results"),
            F.max("gain").alias("best"),
            F.count("*").alias("n"),
        )
    )
    earlier = (
        Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    folded = blocks.select(
        "run_id",
        "block",
        "results",
        "n",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"),
        F.max("best").over(earlier).alias("best_before"),
    ).withColumn("state", _folded(F.col("results"), F.col("best_before"), patience))
    # counted from the start of the run
    since = F.max(F.col("first") + F.col("state.last_gain")).over(earlier)
    due = F.greatest(since + patience - F.col("first"), F.lit(0))
    carried = F.when(due < F.coalesce("state.first_gain", "n"), due)
    stop = F.coalesce(carried, F.col("state.failure"))
    return (
        folded.withColumn("stop", stop.cast("int"))
        .filter(F.col("stop").isNotNull())
        .select("run_id", F.get("results", F.col("stop"))["epoch"].alias("epoch"))
        .groupBy("run_id")
        .agg(F.min("epoch").alias("stop_epoch"))
    )


def _folded(results: Column, best: Column, patience: int) -> Column:
    """A block's part in the decision, given the best result before it.

    Positions in the block of its first and last gain, and of the first evaluation after a
    gain that is ``patience`` later without another; null where there is none. Blocks put
    together need no more than these.
    """
    nothing = F.lit(None).cast("int")
    start = F.struct(
        F.lit(0).alias("at"),
        best.alias("best"),
        nothing.alias("first_gain"),
        nothing.alias("last_gain"),
        nothing.alias("failure"),
    )

    def step(state: Column, result: Column) -> Column:
        at = state["at"]
        better = state["best"].isNull() | (result["gain"] > state["best"])
        late = at - state["last_gain"] >= patience
        return F.struct(
            (at + 1).alias("at"),
            F.greatest(state["best"], result["gain"]).alias("best"),
            F.coalesce(state["first_gain"], F.when(better, at)).alias("first_gain"),
            F.when(better, at).otherwise(state["last_gain"]).alias("last_gain"),
            F.coalesce(state["failure"], F.when(~better & late, at)).alias("failure"),
        )

    return F.aggregate(results, start, step)
