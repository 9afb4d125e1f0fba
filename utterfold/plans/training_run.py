"""A training run that leaves label map, model and metrics together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import CorpusConfig
from ..operators.model import IntentModel, load_model, save_model
from ..session import cut_lineage
from ..sources.publish import current, publish
from ..sources.sinks import load_label_map, load_metrics, save_label_map, save_metrics
from .prepare import PreparedCorpus, load_corpus, prepare
from .train_evaluate import train_and_evaluate


def run_training(
    spark: SparkSession,
    corpus: PreparedCorpus,
    task: str,
    run_id: str,
    root: str,
    test: DataFrame | None = None,
    text_col: str = "text",
    **options,
) -> tuple[IntentModel, DataFrame]:
    """Fit, evaluate, and publish everything below ``root`` as one version.

    A version holds the model, the label map it was trained with, and the metrics of every
    split. Readers see it when all of it is written; until then they see the last one.
    ``test`` must be encoded with the map of ``corpus``.
    """
    model, metrics = train_and_evaluate(
        corpus, task, run_id, test=test, text_col=text_col, **options
    )
    # the evaluation is computed once, then written per split and returned
    metrics = cut_lineage(metrics)
    splits = ["eval"] * (corpus.validation is not None) + ["test"] * (test is not None)

    def write(folder: str) -> None:
        save_label_map(corpus.label_map, f"{folder}/label_map")
        save_model(model, spark, f"{folder}/model")
        for split in splits:
            save_metrics(metrics.filter(metrics["split"] == split), run_id, split, f"{folder}/metrics")

    publish(spark, root, write)
    return model, metrics


def train_from_files(
    spark: SparkSession,
    config: CorpusConfig,
    run_id: str,
    root: str,
    test_config: CorpusConfig | None = None,
    row_id: str | None = None,
    **options,
) -> tuple[IntentModel, DataFrame, DataFrame | None]:
    """Read, prepare, fit, evaluate and publish; the test file goes by the training map.

    Returns the model, the metrics, and ``label, n_rows`` of test labels the map lacks.
    """
    corpus = prepare(load_corpus(spark, config), config, row_id=row_id)
    test = unseen = None
    if test_config is not None:
        prepared = prepare(load_corpus(spark, test_config), test_config, corpus.label_map, row_id)
        test, unseen = prepared.train, prepared.unseen
    model, metrics = run_training(
        spark, corpus, config.task, run_id, root, test, config.text_col, **options
    )
    return model, metrics, unseen


def load_run(spark: SparkSession, root: str) -> tuple[IntentModel, DataFrame, DataFrame]:
    """Model, label map and metrics of the latest complete run."""
    folder = current(spark, root)
    return (
        load_model(spark, f"{folder}/model"),
        load_label_map(spark, f"{folder}/label_map"),
        load_metrics(spark, f"{folder}/metrics"),
    )
