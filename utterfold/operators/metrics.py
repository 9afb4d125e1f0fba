"""Classification metrics as aggregations.

Every function returns the long form ``metric, value``. Undefined values are
NaN, never null; a precision, recall or overlap of 0/0 is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MULTICLASS, check_task
from ..functions import vectors as V
from ..session import cut_lineage
from . import curves

NAN = float("nan")


def _ratio(top: Column, bottom: Column, undefined: float = 0.0) -> Column:
    # null where the denominator is 0 or the group is empty
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(undefined))


def _long(row: DataFrame, names: Sequence[str]) -> DataFrame:
    values = row.select(*[F.col(n).cast("double").alias(n) for n in names])
    return values.unpivot([], list(names), "metric", "value")


# --- counts -----------------------------------------------------------------------


def confusion_counts(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """``true_id, pred_id, n``."""
    return df.groupBy(F.col(truth_col).alias("true_id"), F.col(pred_col).alias("pred_id")).agg(
        F.count("*").alias("n")
    )


def class_totals(confusion: DataFrame) -> DataFrame:
    """``label_id, tp, n_true, n_pred`` over the classes in truth or prediction."""
    margins = F.array(
        F.struct(
            F.col("true_id").alias("label_id"), F.col("n").alias("n_true"), F.lit(0).alias("n_pred")
        ),
        F.struct(
            F.col("pred_id").alias("label_id"), F.lit(0).alias("n_true"), F.col("n").alias("n_pred")
        ),
    )
    hit = F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(F.lit(0))
    return (
        confusion.select(hit.alias("hit"), F.inline(margins))
        .groupBy("label_id")
        # a hit shows up once per margin, count it with the truth only
        .agg(
            F.sum(F.when(F.col("n_true") > 0, F.col("hit")).otherwise(F.lit(0))).alias("tp"),
            F.sum("n_true").alias("n_true"),
            F.sum("n_pred").alias("n_pred"),
        )
    )


def label_counts(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """``label_id, tp, fp, fn, tn, support`` for multi-hot truth and prediction.

    All labels of the vectors appear, also those without support.
    """
    pairs = F.zip_with(
        curves.same_length(F.col(truth_col), F.col(pred_col)),
        F.col(pred_col),
        lambda t, p: F.struct((t > 0).alias("t"), (p > 0).alias("p")),
    )
    t, p = F.col("pair.t"), F.col("pair.p")
    return (
        df.select(F.posexplode(pairs).alias("label_id", "pair"))
        .groupBy("label_id")
        .agg(
            F.count_if(t & p).alias("tp"),
            F.count_if(~t & p).alias("fp"),
            F.count_if(t & ~p).alias("fn"),
            F.count_if(~t & ~p).alias("tn"),
            F.count_if(t).alias("support"),
        )
    )


# --- multiclass -------------------------------------------------------------------

_AVERAGES = ("micro", "macro", "weighted")

MULTICLASS_COUNT_METRICS = (
    "accuracy",
    *[f"{name}_{avg}" for avg in _AVERAGES for name in ("precision", "recall", "f1")],
    "f1",
    "balanced_accuracy",
    "cohen_kappa",
    "matthews_corrcoef",
)


def multiclass_counts_metrics(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """Every multiclass metric that needs the confusion counts only."""
    return metrics_of_confusion(confusion_counts(df, truth_col, pred_col))


def metrics_of_confusion(confusion: DataFrame) -> DataFrame:
    totals = class_totals(confusion)
    tp, t, p = (F.col(c).cast("double") for c in ("tp", "n_true", "n_pred"))
    precision, recall, f1 = _ratio(tp, p), _ratio(tp, t), _ratio(2 * tp, t + p)
    sums = totals.agg(
        F.sum(tp).alias("c"),
        F.sum(t).alias("s"),
        F.sum(t * p).alias("tp_margin"),
        F.sum(t * t).alias("tt"),
        F.sum(p * p).alias("pp"),
        *[F.avg(v).alias(f"{n}_macro") for n, v in _named(precision, recall, f1)],
        *[
            _ratio(F.sum(v * t), F.sum(t)).alias(f"{n}_weighted")
            for n, v in _named(precision, recall, f1)
        ],
        F.avg(F.when(t > 0, recall)).alias("balanced_accuracy"),
    )
    c, s = F.col("c"), F.col("s")
    accuracy = _ratio(c, s, NAN)
    chance = _ratio(F.col("tp_margin"), s * s, NAN)
    spread = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    row = sums.select(
        accuracy.alias("accuracy"),
        *[accuracy.alias(f"{n}_micro") for n in ("precision", "recall", "f1")],
        *[f"{n}_{a}" for a in ("macro", "weighted") for n in ("precision", "recall", "f1")],
        F.col("f1_weighted").alias("f1"),
        "balanced_accuracy",
        _ratio(accuracy - chance, 1 - chance, NAN).alias("cohen_kappa"),
        _ratio(c * s - F.col("tp_margin"), spread).alias("matthews_corrcoef"),
    )
    return _long(row, MULTICLASS_COUNT_METRICS)


def _named(*values: Column) -> list[tuple[str, Column]]:
    return list(zip(("precision", "recall", "f1"), values, strict=True))


def _pick(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    return metrics.filter(F.col("metric").isin(list(names)))


def accuracy(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    return _pick(multiclass_counts_metrics(df, truth_col, pred_col), ["accuracy"])


def precision_recall_f1(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """Micro, macro and weighted; ``f1``, the primary metric, is the weighted one."""
    kinds = ("precision", "recall", "f1")
    names = [n for n in MULTICLASS_COUNT_METRICS if n.split("_")[0] in kinds]
    return _pick(multiclass_counts_metrics(df, truth_col, pred_col), names)


def balanced_accuracy(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    return _pick(multiclass_counts_metrics(df, truth_col, pred_col), ["balanced_accuracy"])


def cohen_kappa(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    return _pick(multiclass_counts_metrics(df, truth_col, pred_col), ["cohen_kappa"])


def matthews_corrcoef(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    return _pick(multiclass_counts_metrics(df, truth_col, pred_col), ["matthews_corrcoef"])


def roc_auc_ovr(df: DataFrame, truth_col: str, logits_col: str) -> DataFrame:
    """One against the rest, weighted by support; NaN if a class lacks a side."""
    scored = df.select(
        F.col(truth_col).alias("truth"), V.softmax(F.col(logits_col)).alias("scores")
    )
    counts = cut_lineage(curves.class_score_counts(scored, "truth", "scores"))
    areas = curves.ranking_curves(counts)
    weight = F.col("n_pos").cast("double")
    row = areas.agg(_ratio(F.sum(F.col("auc") * weight), F.sum(weight), NAN).alias("roc_auc_ovr"))
    return _long(row, ["roc_auc_ovr"])


def _row_loss(truth: Column, logits: Column) -> Column:
    """Cross-entropy of a row, null without truth or logits; an id outside them is an error."""
    outside = (truth < 0) | (truth >= F.size(logits))
    message = F.concat(F.lit("class id outside the logits: "), truth.cast("string"))
    return F.when(outside, F.raise_error(message).cast("double")).otherwise(
        V.cross_entropy(logits, truth)
    )


def cross_entropy_loss(df: DataFrame, truth_col: str, logits_col: str) -> DataFrame:
    """Mean over the rows that have truth and logits, as in :func:`compute_metrics`."""
    row = df.agg(F.avg(_row_loss(F.col(truth_col), F.col(logits_col))).alias("loss"))
    return _long(row.select(F.coalesce("loss", F.lit(NAN)).alias("loss")), ["loss"])


# --- multilabel -------------------------------------------------------------------

MULTILABEL_COUNT_METRICS = (
    *[f"{name}_{avg}" for avg in _AVERAGES for name in ("precision", "recall", "f1", "jaccard")],
    "f1",
    "hamming_loss",
)


def multilabel_counts_metrics(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """Micro, macro and weighted metrics and the Hamming loss."""
    return metrics_of_label_counts(label_counts(df, truth_col, pred_col))


def metrics_of_label_counts(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    support = F.col("support").cast("double")

    def scores(tp: Column, fp: Column, fn: Column) -> list[tuple[str, Column]]:
        return [
            ("precision", _ratio(tp, tp + fp)),
            ("recall", _ratio(tp, tp + fn)),
            ("f1", _ratio(2 * tp, 2 * tp + fp + fn)),
            ("jaccard", _ratio(tp, tp + fp + fn)),
        ]

    row = counts.agg(
        *[v.alias(f"{n}_micro") for n, v in scores(F.sum(tp), F.sum(fp), F.sum(fn))],
        *[F.avg(v).alias(f"{n}_macro") for n, v in scores(tp, fp, fn)],
        *[
            _ratio(F.sum(v * support), F.sum(support)).alias(f"{n}_weighted")
            for n, v in scores(tp, fp, fn)
        ],
        _ratio(F.sum(fp + fn), F.sum(tp + fp + fn + tn), NAN).alias("hamming_loss"),
    )
    return _long(row.withColumn("f1", F.col("f1_micro")), MULTILABEL_COUNT_METRICS)


SAMPLE_METRICS = (
    "precision_samples",
    "recall_samples",
    "f1_samples",
    "jaccard_samples",
    "subset_accuracy",
)


def _row_overlap(truth: Column, pred: Column) -> list[Column]:
    """Per row: labels in both, in truth, in prediction."""
    hits = F.zip_with(truth, pred, lambda t, p: ((t > 0) & (p > 0)).cast("double"))
    return [
        V.array_sum(hits).alias("both"),
        V.array_sum(F.transform(truth, lambda x: (x > 0).cast("double"))).alias("t"),
        V.array_sum(F.transform(pred, lambda x: (x > 0).cast("double"))).alias("p"),
    ]


def _sample_averages() -> list[Column]:
    """Averages over the columns of :func:`_row_overlap`."""
    both, t, p = F.col("both"), F.col("t"), F.col("p")
    return [
        F.avg(_ratio(both, p)).alias("precision_samples"),
        F.avg(_ratio(both, t)).alias("recall_samples"),
        F.avg(_ratio(2 * both, t + p)).alias("f1_samples"),
        F.avg(_ratio(both, t + p - both)).alias("jaccard_samples"),
        F.avg(((both == t) & (both == p)).cast("double")).alias("subset_accuracy"),
    ]


def sample_metrics(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """Averages over rows and the share of rows with exactly the right labels."""
    overlap = df.select(*_row_overlap(F.col(truth_col), F.col(pred_col)))
    return _long(overlap.agg(*_sample_averages()), SAMPLE_METRICS)


def multilabel_precision_recall_f1(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    """Micro, macro, weighted and samples; ``f1``, the primary metric, is the micro one."""
    both = multilabel_counts_metrics(df, truth_col, pred_col).unionByName(
        sample_metrics(df, truth_col, pred_col)
    )
    return both.filter(F.col("metric").rlike("^(precision|recall|f1)(_|$)"))


def subset_accuracy(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    return _pick(sample_metrics(df, truth_col, pred_col), ["subset_accuracy"])


def hamming_loss(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    return _pick(multilabel_counts_metrics(df, truth_col, pred_col), ["hamming_loss"])


def jaccard(df: DataFrame, truth_col: str, pred_col: str) -> DataFrame:
    both = multilabel_counts_metrics(df, truth_col, pred_col).unionByName(
        sample_metrics(df, truth_col, pred_col)
    )
    return both.filter(F.col("metric").startswith("jaccard_"))


ROC_METRICS = ("roc_auc_micro", "roc_auc_macro", "roc_auc_weighted", "roc_auc")
AP_METRICS = (
    "avg_precision_micro",
    "avg_precision_macro",
    "avg_precision_weighted",
    "avg_precision",
)


def ranking_metrics(df: DataFrame, truth_col: str, score_col: str) -> DataFrame:
    """ROC areas and average precisions from one pass over the scores."""
    return metrics_of_scores(cut_lineage(curves.score_counts(df, truth_col, score_col)))


def metrics_of_scores(counts: DataFrame) -> DataFrame:
    areas = curves.ranking_curves(counts, pooled=True)
    pooled = F.col("label_id") == curves.POOLED
    single = ~pooled
    weight = F.col("n_pos").cast("double")
    nan = F.lit(NAN)
    # a label without positives weighs nothing, so its NaN must not count
    weighted_ap = _ratio(
        F.sum(F.when(single & (weight > 0), F.col("ap") * weight)),
        F.sum(F.when(single, weight)),
        NAN,
    )
    sums = areas.agg(
        F.bool_or(single & ((F.col("n_pos") == 0) | (F.col("n_neg") == 0))).alias("one_sided"),
        F.max(F.when(pooled, F.col("auc"))).alias("auc_micro"),
        F.avg(F.when(single, F.col("auc"))).alias("auc_macro"),
        _ratio(
            F.sum(F.when(single, F.col("auc") * weight)), F.sum(F.when(single, weight)), NAN
        ).alias("auc_weighted"),
        F.max(F.when(pooled, F.col("ap"))).alias("ap_micro"),
        F.avg(F.when(single, F.col("ap"))).alias("ap_macro"),
        weighted_ap.alias("ap_weighted"),
    )

    def roc(name: str) -> Column:
        return F.when(F.col("one_sided"), nan).otherwise(F.coalesce(F.col(name), nan))

    def ap(name: str) -> Column:
        return F.coalesce(F.col(name), nan)

    row = sums.select(
        *[roc(f"auc_{a}").alias(f"roc_auc_{a}") for a in _AVERAGES],
        roc("auc_micro").alias("roc_auc"),
        *[ap(f"ap_{a}").alias(f"avg_precision_{a}") for a in _AVERAGES],
        ap("ap_micro").alias("avg_precision"),
    )
    return _long(row, ROC_METRICS + AP_METRICS)


def roc_auc(df: DataFrame, truth_col: str, score_col: str) -> DataFrame:
    """All four values are NaN if any label lacks positives or negatives."""
    return _pick(ranking_metrics(df, truth_col, score_col), ROC_METRICS)


def average_precision(df: DataFrame, truth_col: str, score_col: str) -> DataFrame:
    """The macro value is NaN if a label has no positives; weighted ignores such labels."""
    return _pick(ranking_metrics(df, truth_col, score_col), AP_METRICS)


def _binary_loss(truth: Column, logits: Column) -> list[Column]:
    """Per row: summed loss and number of labels."""
    return [
        V.binary_cross_entropy(logits, truth).alias("row_loss"),
        F.size(logits).alias("row_labels"),
    ]


def _mean_loss() -> Column:
    return _ratio(F.sum("row_loss"), F.sum("row_labels"), NAN).alias("loss")


def binary_cross_entropy_loss(df: DataFrame, truth_col: str, logits_col: str) -> DataFrame:
    """Mean over all rows and labels."""
    losses = df.select(*_binary_loss(F.col(truth_col), F.col(logits_col)))
    return _long(losses.agg(_mean_loss()), ["loss"])


# --- everything -------------------------------------------------------------------


def compute_metrics(
    df: DataFrame,
    task: str,
    truth_col: str = "labels",
    logits_col: str = "logits",
    threshold: float = 0.5,
) -> DataFrame:
    """All metrics of a task from truth and logits, in two passes over them.

    Truth is a class id or a multi-hot vector. The evaluation loss is the row
    ``loss``. Write logits that are expensive to make to a table first.
    """
    check_task(task)
    slim = df.select(F.col(truth_col).alias("truth"), F.col(logits_col).alias("logits"))
    if task == MULTICLASS:
        # the loss rides along with the confusion counts
        confusion = (
            slim.withColumn("loss", _row_loss(F.col("truth"), F.col("logits")))
            .groupBy(F.col("truth").alias("true_id"), V.argmax(F.col("logits")).alias("pred_id"))
            .agg(
                F.count("*").alias("n"),
                F.sum("loss").alias("loss"),
                F.count("loss").alias("n_losses"),
            )
        )
        loss = confusion.agg(_ratio(F.sum("loss"), F.sum("n_losses"), NAN).alias("loss"))
        return (
            metrics_of_confusion(confusion.drop("loss", "n_losses"))
            .unionByName(roc_auc_ovr(slim, "truth", "logits"))
            .unionByName(_long(loss, ["loss"]))
        )
    scored = slim.withColumn("scores", V.sigmoid(F.col("logits")))
    truth, logits, pred = F.col("truth"), F.col("logits"), F.col("pred")
    by_row = (
        scored.withColumn("pred", V.binarize(F.col("scores"), threshold))
        .select(*_row_overlap(truth, pred), *_binary_loss(truth, logits))
        .agg(*_sample_averages(), _mean_loss())
    )
    counts = cut_lineage(curves.score_counts(scored, "truth", "scores"))
    predicted = F.col("score") > threshold

    def rows(kind: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(kind)).otherwise(F.lit(0)))

    by_label = counts.groupBy("label_id").agg(
        rows("pos", predicted).alias("tp"),
        rows("neg", predicted).alias("fp"),
        rows("pos", ~predicted).alias("fn"),
        rows("neg", ~predicted).alias("tn"),
        F.sum("pos").alias("support"),
    )
    return (
        metrics_of_label_counts(by_label)
        .unionByName(_long(by_row, (*SAMPLE_METRICS, "loss")))
        .unionByName(metrics_of_scores(counts))
    )
