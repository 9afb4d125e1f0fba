"""From a file of texts to a file of predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.model import IntentModel, score
from ..operators.scoring import Scorer, names_array, predict_table
from ..session import cut_lineage
from ..sources.files import read_scoring_input
from ..sources.publish import publish
from ..sources.sinks import write_predictions


def score_file(
    spark: SparkSession,
    path: str,
    model: IntentModel | Callable[[], Scorer],
    out: str | None = None,
    text_col: str = "text",
    task: str | None = None,
    labels: Sequence[str] | None = None,
    threshold: float = 0.5,
    include_probabilities: bool = False,
    batch_size: int = 8,
) -> DataFrame:
    """The rows of a scoring file with their predictions, published below ``out`` if given.

    A fitted model knows its task and labels; for a user scorer they are given. Every row
    is scored, rows with an empty text too. The texts are scored once: what is written is
    what is returned.
    """
    if isinstance(model, IntentModel):
        task, labels = model.task, model.labels
    elif task is None or labels is None:
        raise ValueError("a user scorer needs task and labels")
    rows = read_scoring_input(spark, path, text_col)
    scored = score(rows, model, text_col, batch_size)
    found = predict_table(
        scored, task, names_array(labels), "logits", threshold, include_probabilities
    )
    if out is None:
        return found
    stored = cut_lineage(found)
    publish(spark, out, lambda folder: write_predictions(stored, folder))
    return stored
