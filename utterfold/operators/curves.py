"""Areas under ROC and precision-recall curves, exact and without a global sort."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_before

POOLED = -1  # label_id of the curve over all labels taken together

_ROWS_PER_BUCKET = 1_000_000


def same_length(one: Column, other: Column) -> Column:
    """``one``, failing the query where the arrays differ in length."""
    differ = F.raise_error(F.lit("truth and prediction differ in length"))
    return F.when(F.size(one) == F.size(other), one).when(
        one.isNull() | other.isNull(), F.lit(None)
    ).otherwise(F.array(differ.cast("int")).cast("array<double>"))


def score_counts(df: DataFrame, truth_col: str, score_col: str) -> DataFrame:
    """``label_id, score, pos, neg`` of aligned truth and score arrays.

    Equal scores of a label collapse before the shuffle, so a score that many
    rows share is one row from here on.
    """
    pairs = F.zip_with(
        F.col(score_col),
        same_length(F.col(truth_col), F.col(score_col)),
        lambda s, t: F.struct(s.cast("double").alias("score"), (t > 0).alias("hit")),
    )
    return _collapse(df.select(F.posexplode(pairs).alias("label_id", "pair")))


def class_score_counts(df: DataFrame, truth_col: str, score_col: str) -> DataFrame:
    """As :func:`score_counts` for class ids: each class against the rest."""
    truth = F.col(truth_col)
    # exploding an expression, not a column: for a column Spark adds a filter on
    # its size and pushes it down, computing the scores a second time
    pairs = F.transform(
        F.col(score_col),
        lambda s, i: F.struct(s.cast("double").alias("score"), (truth == i).alias("hit")),
    )
    return _collapse(df.select(F.posexplode(pairs).alias("label_id", "pair")))


def _collapse(exploded: DataFrame) -> DataFrame:
    return exploded.groupBy("label_id", F.col("pair.score").alias("score")).agg(
        F.count_if(F.col("pair.hit")).alias("pos"), F.count_if(~F.col("pair.hit")).alias("neg")
    )


def _with_pooled(counts: DataFrame) -> DataFrame:
    pooled = counts.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return counts.unionByName(pooled.select(F.lit(POOLED).alias("label_id"), "score", "pos", "neg"))


def _bucketizer(counts: DataFrame, rows_per_bucket: int) -> Bucketizer | None:
    """Buckets rising along falling scores; none if a group fits one task.

    Bounds are approximate quantiles of the scores: they only balance the
    buckets, results do not depend on them.
    """
    n_buckets = -(-counts.count() // rows_per_bucket)
    if n_buckets <= 1:
        return None
    steps = [i / n_buckets for i in range(1, n_buckets)]
    bounds = counts.select((-F.col("score")).alias("falling")).approxQuantile(
        "falling", steps, 0.1 / n_buckets
    )
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    return Bucketizer(splits=splits, inputCol="falling", outputCol="bucket")


def ranking_curves(
    counts: DataFrame, pooled: bool = False, rows_per_bucket: int = _ROWS_PER_BUCKET
) -> DataFrame:
    """``label_id, n_pos, n_neg, auc, ap`` per label of a score table.

    ``pooled`` adds the curve over all labels under the id ``POOLED``. Tied
    scores count half in the ROC area and form one step of the precision-recall
    sum. Undefined areas are NaN: the ROC area without positives or without
    negatives, average precision without positives, both where a score is NaN.

    The table is read several times; pass it through ``cut_lineage`` first.
    """
    buckets = _bucketizer(counts.filter(~F.isnan("score")), rows_per_bucket)
    rows = _with_pooled(counts) if pooled else counts
    # NaN scores have no place in an order: they are put last and blank the label's areas
    rows = rows.withColumn("unranked", F.isnan("score")).withColumn(
        "score", F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    )
    # a null score has no rank
    rows = rows.filter(F.col("score").isNotNull()).withColumn("falling", -F.col("score"))
    if buckets:
        rows = buckets.transform(rows).withColumn("bucket", F.col("bucket").cast("int"))
    cumulative = running_before(
        rows,
        ["label_id"],
        "bucket" if buckets else None,
        [F.asc("falling")],
        sums={"pos_above": "pos", "neg_above": "neg"},
    )
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.col("pos_above").cast("double")
    reached = F.col("pos_above") + F.col("pos")
    precision = reached / (reached + F.col("neg_above") + F.col("neg"))
    areas = cumulative.groupBy("label_id").agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(neg * (above + pos / 2)).alias("wins"),
        F.sum(pos * precision).alias("steps"),
        F.max("unranked").alias("unranked"),
    )
    nan = F.lit(float("nan"))
    n_pos, n_neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return areas.select(
        "label_id",
        "n_pos",
        "n_neg",
        F.when(F.col("unranked"), nan)
        .otherwise(F.coalesce(F.try_divide("wins", n_pos * n_neg), nan))
        .alias("auc"),
        F.when(F.col("unranked"), nan)
        .otherwise(F.coalesce(F.try_divide("steps", n_pos), nan))
        .alias("ap"),
    )
