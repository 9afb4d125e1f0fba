"""Fit, evaluate on the held-out splits, and keep the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MULTICLASS
from ..operators.metrics import compute_metrics
from ..operators.model import IntentModel, fit_multiclass, fit_multilabel, score
from ..session import cut_lineage
from ..sources.sinks import save_metrics
from .prepare import PreparedCorpus


def fit(corpus: PreparedCorpus, task: str, text_col: str = "text", **options) -> IntentModel:
    fitter = fit_multiclass if task == MULTICLASS else fit_multilabel
    return fitter(corpus.train, corpus.label_map, text_col, **options)


def evaluate(model: IntentModel, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All metrics of a labelled split. Logits are written once, then read by every pass."""
    logits = cut_lineage(score(labelled, model).select("labels", "logits"))
    return compute_metrics(logits, model.task, threshold=threshold)


def train_and_evaluate(
    corpus: PreparedCorpus,
    task: str,
    run_id: str,
    metrics_path: str | None = None,
    test: DataFrame | None = None,
    text_col: str = "text",
    **options,
) -> tuple[IntentModel, DataFrame]:
    """Fit on train; metrics ``run_id, split, metric, value`` for validation and test."""
    model = fit(corpus, task, text_col, **options)
    merged = None
    for split, labelled in (("eval", corpus.validation), ("test", test)):
        if labelled is None:
            continue
        metrics = evaluate(model, labelled)
        if metrics_path:
            save_metrics(metrics, run_id, split, metrics_path)
        part = metrics.select(
            F.lit(run_id).alias("run_id"), F.lit(split).alias("split"), "metric", "value"
        )
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        raise ValueError("nothing to evaluate: no validation split and no test set")
    return model, merged
