"""Metrics over the scored vectors, and model selection over epoch logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import MULTICLASS, MULTILABEL
from ..functions import vectors as V
from ..operators import curves, training_log
from ..operators import metrics as M
from ..session import cut_lineage
from .base import EPOCHS, MULTILABEL as ML, SOFTMAX, big, epoch_log, query, r6, scored
from .base import scored_multilabel


def _multi(spark, folder):
    return scored(spark, folder).withColumn("pred", V.argmax(F.col("logits")))


def _labelled(spark, folder):
    rows = scored_multilabel(spark, folder).withColumn("scores", V.sigmoid(F.col("logits")))
    return rows.withColumn("pred", V.binarize(F.col("scores")))


def _rounded(metrics):
    return metrics.withColumn("value", r6("value"))


def _wanted(values: dict[str, str], source: str) -> str:
    """Long form of named scalar expressions over ``source``."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, round(({expr})::DOUBLE, 6) + 0.0 AS value FROM {source}"
        for name, expr in values.items()
    )


# --- multiclass -------------------------------------------------------------------

_CLASSES = f"""{SOFTMAX}, cls AS (
  SELECT c, count(*) FILTER (truth = c AND pred = c) AS tp,
         count(*) FILTER (truth = c) AS t, count(*) FILTER (pred = c) AS p
  FROM pred, (SELECT unnest(range(10)) AS c) GROUP BY c),
seen AS (SELECT c, tp::DOUBLE AS tp, t::DOUBLE AS t, p::DOUBLE AS p,
         coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(t, 0), 0) AS recall,
         coalesce(2 * tp / nullif(p + t, 0), 0) AS f1
  FROM cls WHERE t + p > 0),
tot AS (SELECT sum(tp) AS c, sum(t) AS s, sum(t * p) AS m, sum(t * t) AS tt, sum(p * p) AS pp
  FROM seen)"""

_ACCURACY = {"accuracy": "c / s"}
_PRF_TOT = {f"{n}_micro": "c / s" for n in ("precision", "recall", "f1")}
_PRF_SEEN = {
    f"{n}_{a}": f"avg({n})" if a == "macro" else f"sum({n} * t) / sum(t)"
    for a in ("macro", "weighted")
    for n in ("precision", "recall", "f1")
} | {"f1": "sum(f1 * t) / sum(t)"}
_BALANCED = {"balanced_accuracy": "avg(recall) FILTER (t > 0)"}
_KAPPA = {"cohen_kappa": "(c / s - m / (s * s)) / (1 - m / (s * s))"}
_MCC = {"matthews_corrcoef": "(c * s - m) / sqrt((s * s - pp) * (s * s - tt))"}


@query(
    "confusion_counts",
    f"""WITH {SOFTMAX} SELECT truth::BIGINT AS true_id, pred::BIGINT AS pred_id, count(*) AS n
    FROM pred GROUP BY 1, 2""",
)
def confusion(spark, folder):
    counts = M.confusion_counts(_multi(spark, folder), "truth", "pred")
    return counts.select(*big("true_id", "pred_id"), "n")


@query("accuracy", f"WITH {_CLASSES} {_wanted(_ACCURACY, 'tot')}")
def accuracy(spark, folder):
    return _rounded(M.accuracy(_multi(spark, folder), "truth", "pred"))


@query(
    "precision_recall_f1",
    f"WITH {_CLASSES} {_wanted(_PRF_TOT, 'tot')} UNION ALL {_wanted(_PRF_SEEN, 'seen')}",
)
def precision_recall_f1(spark, folder):
    return _rounded(M.precision_recall_f1(_multi(spark, folder), "truth", "pred"))


@query(
    "primary_metric_multiclass",
    f"WITH {_CLASSES} {_wanted({'f1': _PRF_SEEN['f1']}, 'seen')}",
)
def primary_multiclass(spark, folder):
    metrics = M.precision_recall_f1(_multi(spark, folder), "truth", "pred")
    return _rounded(metrics.filter("metric = 'f1'"))


@query("balanced_accuracy", f"WITH {_CLASSES} {_wanted(_BALANCED, 'seen')}")
def balanced_accuracy(spark, folder):
    return _rounded(M.balanced_accuracy(_multi(spark, folder), "truth", "pred"))


@query("cohen_kappa", f"WITH {_CLASSES} {_wanted(_KAPPA, 'tot')}")
def cohen_kappa(spark, folder):
    return _rounded(M.cohen_kappa(_multi(spark, folder), "truth", "pred"))


@query("matthews_corrcoef", f"WITH {_CLASSES} {_wanted(_MCC, 'tot')}")
def matthews_corrcoef(spark, folder):
    return _rounded(M.matthews_corrcoef(_multi(spark, folder), "truth", "pred"))


def _areas(rows: str, group: str, name: str) -> str:
    """Areas per ``group`` of ``rows(group, s, y)``: the kernel over distinct scores."""
    return f"""{name}_g AS (
      SELECT {group} AS k, s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM {rows}
      GROUP BY 1, 2),
    {name}_c AS (
      SELECT k, p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM {name}_g
      WINDOW w AS (PARTITION BY k ORDER BY s DESC)),
    {name} AS (
      SELECT k, sum(p) AS pos, sum(n) AS neg,
             sum(n * ((cp - p) + p / 2)) / nullif(sum(p) * sum(n), 0) AS auc,
             sum(p * cp / (cp + cn)) / nullif(sum(p), 0) AS ap
      FROM {name}_c GROUP BY k)"""


_OVR = f"""{SOFTMAX}, ovr AS (SELECT c, p AS s, (truth = c)::INT AS y FROM soft),
{_areas("ovr", "c", "per_class")}"""
_OVR_VALUE = {
    "roc_auc_ovr": "CASE WHEN min(pos) = 0 OR min(neg) = 0 THEN 'NaN'::DOUBLE "
    "ELSE sum(auc * pos) / sum(pos) END"
}


@query("roc_auc_ovr", f"WITH {_OVR} {_wanted(_OVR_VALUE, 'per_class')}")
def roc_auc_ovr(spark, folder):
    return _rounded(M.roc_auc_ovr(_multi(spark, folder), "truth", "logits"))


_CE = {"loss": "avg(ln(total) - own)"}
_CE_ROWS = """(SELECT vec_id, sum(exp(x)) AS total, max(x) FILTER (c = truth) AS own
  FROM soft GROUP BY vec_id)"""


@query("cross_entropy_loss", f"WITH {SOFTMAX} {_wanted(_CE, _CE_ROWS)}")
def cross_entropy_loss(spark, folder):
    return _rounded(M.cross_entropy_loss(_multi(spark, folder), "truth", "logits"))


@query(
    "compute_metrics_multiclass",
    f"""WITH {_CLASSES}, ovr AS (SELECT c, p AS s, (truth = c)::INT AS y FROM soft),
    {_areas("ovr", "c", "per_class")}
    {_wanted(_ACCURACY | _PRF_TOT | _KAPPA | _MCC, "tot")}
    UNION ALL {_wanted(_PRF_SEEN | _BALANCED, "seen")}
    UNION ALL {_wanted(_OVR_VALUE, "per_class")}
    UNION ALL {_wanted(_CE, _CE_ROWS)}""",
)
def compute_multiclass(spark, folder):
    return _rounded(M.compute_metrics(scored(spark, folder), MULTICLASS, "truth"))


# --- multilabel -------------------------------------------------------------------

_COUNTS = f"""{ML}, cnt AS (
  SELECT c, count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp,
         count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp,
         count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn,
         count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn
  FROM mlp GROUP BY c),
lab AS (SELECT *, tp + fn AS t,
         coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
         coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
         coalesce(tp / nullif(tp + fp + fn, 0), 0) AS jaccard
  FROM cnt),
per_row AS (SELECT vec_id, sum(y * p)::DOUBLE AS b, sum(y)::DOUBLE AS t, sum(p)::DOUBLE AS q,
         max(abs(y - p)) AS wrong
  FROM mlp GROUP BY vec_id)"""

_KINDS = ("precision", "recall", "f1", "jaccard")
_MICRO = {
    "precision_micro": "sum(tp) / sum(tp + fp)",
    "recall_micro": "sum(tp) / sum(tp + fn)",
    "f1_micro": "2 * sum(tp) / sum(2 * tp + fp + fn)",
    "jaccard_micro": "sum(tp) / sum(tp + fp + fn)",
}
_BY_LABEL = (
    _MICRO
    | {f"{n}_macro": f"avg({n})" for n in _KINDS}
    | {f"{n}_weighted": f"sum({n} * t) / sum(t)" for n in _KINDS}
)
_SAMPLES = {
    "precision_samples": "avg(coalesce(b / nullif(q, 0), 0))",
    "recall_samples": "avg(coalesce(b / nullif(t, 0), 0))",
    "f1_samples": "avg(coalesce(2 * b / nullif(t + q, 0), 0))",
    "jaccard_samples": "avg(coalesce(b / nullif(t + q - b, 0), 0))",
}
_F1 = {"f1": _MICRO["f1_micro"]}
_SUBSET = {"subset_accuracy": "avg(1 - wrong)"}
_HAMMING = {"hamming_loss": "sum(fp + fn) / sum(tp + fp + fn + tn)"}


def _only(values, *kinds):
    return {k: v for k, v in values.items() if k.split("_")[0] in kinds}


@query(
    "label_counts",
    f"""WITH {_COUNTS} SELECT c::BIGINT AS label_id, tp::BIGINT AS tp, fp::BIGINT AS fp,
    fn::BIGINT AS fn, tn::BIGINT AS tn, t::BIGINT AS support FROM lab""",
)
def label_counts(spark, folder):
    counts = M.label_counts(_labelled(spark, folder), "truth", "pred")
    return counts.select(*big(*counts.columns))


_PRF = ("precision", "recall", "f1")


@query(
    "multilabel_precision_recall_f1",
    f"""WITH {_COUNTS} {_wanted(_only(_BY_LABEL, *_PRF) | _F1, "lab")}
    UNION ALL {_wanted(_only(_SAMPLES, *_PRF), "per_row")}""",
)
def multilabel_prf(spark, folder):
    return _rounded(M.multilabel_precision_recall_f1(_labelled(spark, folder), "truth", "pred"))


@query("primary_metric_multilabel", f"WITH {_COUNTS} {_wanted(_F1, 'lab')}")
def primary_multilabel(spark, folder):
    metrics = M.multilabel_counts_metrics(_labelled(spark, folder), "truth", "pred")
    return _rounded(metrics.filter("metric = 'f1'"))


@query("subset_accuracy", f"WITH {_COUNTS} {_wanted(_SUBSET, 'per_row')}")
def subset_accuracy(spark, folder):
    return _rounded(M.subset_accuracy(_labelled(spark, folder), "truth", "pred"))


@query("hamming_loss", f"WITH {_COUNTS} {_wanted(_HAMMING, 'lab')}")
def hamming_loss(spark, folder):
    return _rounded(M.hamming_loss(_labelled(spark, folder), "truth", "pred"))


@query(
    "jaccard",
    f"""WITH {_COUNTS} {_wanted(_only(_BY_LABEL, "jaccard"), "lab")}
    UNION ALL {_wanted(_only(_SAMPLES, "jaccard"), "per_row")}""",
)
def jaccard(spark, folder):
    return _rounded(M.jaccard(_labelled(spark, folder), "truth", "pred"))


def _ranking(base: str) -> str:
    return f"""{base}, {_areas("mls", "c", "each")}, {_areas("mls", "-1", "pool")}"""


def _guarded(value: str) -> str:
    return (
        "CASE WHEN (SELECT min(least(pos, neg)) FROM each) = 0 THEN 'NaN'::DOUBLE "
        f"ELSE {value} END"
    )


_ROC_EACH = {
    "roc_auc_macro": _guarded("avg(auc)"),
    "roc_auc_weighted": _guarded("sum(auc * pos) / sum(pos)"),
}
_ROC_POOL = {name: _guarded("max(auc)") for name in ("roc_auc_micro", "roc_auc")}
_AP_EACH = {
    "avg_precision_macro": "CASE WHEN min(pos) = 0 THEN 'NaN'::DOUBLE ELSE avg(ap) END",
    "avg_precision_weighted": "sum(ap * pos) / sum(pos)",
}
_AP_POOL = {"avg_precision_micro": "max(ap)", "avg_precision": "max(ap)"}


@query(
    "roc_auc",
    f"WITH {_ranking(ML)} {_wanted(_ROC_EACH, 'each')} UNION ALL {_wanted(_ROC_POOL, 'pool')}",
)
def roc_auc(spark, folder):
    return _rounded(M.roc_auc(_labelled(spark, folder), "truth", "scores"))


@query(
    "average_precision",
    f"WITH {_ranking(ML)} {_wanted(_AP_EACH, 'each')} UNION ALL {_wanted(_AP_POOL, 'pool')}",
)
def average_precision(spark, folder):
    return _rounded(M.average_precision(_labelled(spark, folder), "truth", "scores"))


@query(
    "ranking_curves",
    f"""WITH {_ranking(ML)}
    SELECT k::BIGINT AS label_id, pos::BIGINT AS n_pos, neg::BIGINT AS n_neg,
           round(coalesce(auc, 'NaN'::DOUBLE), 6) AS auc, round(coalesce(ap, 'NaN'::DOUBLE), 6) AS ap
    FROM (FROM each UNION ALL FROM pool)""",
)
def ranking_curves(spark, folder):
    """Small buckets, so that the offsets between buckets are really used."""
    counts = cut_lineage(curves.score_counts(_labelled(spark, folder), "truth", "scores"))
    areas = curves.ranking_curves(counts, pooled=True, rows_per_bucket=500)
    return areas.select(
        *big("label_id", "n_pos", "n_neg"), r6("auc").alias("auc"), r6("ap").alias("ap")
    )


_BCE = {"loss": "avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x))))"}


@query("binary_cross_entropy_loss", f"WITH {ML} {_wanted(_BCE, 'mls')}")
def binary_cross_entropy_loss(spark, folder):
    return _rounded(M.binary_cross_entropy_loss(_labelled(spark, folder), "truth", "logits"))


@query(
    "compute_metrics_multilabel",
    f"""WITH {_ranking(_COUNTS)}
    {_wanted(_BY_LABEL | _F1 | _HAMMING, "lab")}
    UNION ALL {_wanted(_SAMPLES | _SUBSET, "per_row")}
    UNION ALL {_wanted(_ROC_EACH | _AP_EACH, "each")}
    UNION ALL {_wanted(_ROC_POOL | _AP_POOL, "pool")}
    UNION ALL {_wanted(_BCE, "mls")}""",
)
def compute_multilabel(spark, folder):
    rows = scored_multilabel(spark, folder)
    return _rounded(M.compute_metrics(rows, MULTILABEL, "truth"))


# --- epoch logs -------------------------------------------------------------------


@query(
    "select_best",
    f"""WITH {EPOCHS}
    SELECT run_id, list(epoch ORDER BY value DESC, epoch)[1]::BIGINT AS best_epoch,
           max(value) AS best_value FROM epochs GROUP BY run_id""",
)
def select_best(spark, folder):
    best = training_log.select_best(epoch_log(spark, folder), "mean_value")
    return best.select("run_id", *big("best_epoch"), "best_value")


@query(
    "select_best_lowest",
    f"""WITH {EPOCHS}
    SELECT run_id, list(epoch ORDER BY value, epoch)[1]::BIGINT AS best_epoch,
           min(value) AS best_value FROM epochs GROUP BY run_id""",
)
def select_best_lowest(spark, folder):
    best = training_log.select_best(epoch_log(spark, folder), "mean_value", False)
    return best.select("run_id", *big("best_epoch"), "best_value")


@query(
    "early_stop_epoch",
    f"""WITH {EPOCHS}, a AS (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i,
             max(value) OVER (PARTITION BY run_id ORDER BY epoch
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
      FROM epochs),
    b AS (SELECT *, max(CASE WHEN best IS NULL OR value > best THEN i END)
                 OVER (PARTITION BY run_id ORDER BY epoch) AS last FROM a)
    SELECT run_id, min(epoch)::BIGINT AS stop_epoch FROM b WHERE i - last >= 3 GROUP BY run_id""",
)
def early_stop_epoch(spark, folder):
    stops = training_log.early_stop_epoch(epoch_log(spark, folder), "mean_value")
    return stops.select("run_id", *big("stop_epoch"))
