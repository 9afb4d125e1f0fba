"""Scoring text and turning logits into predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MULTICLASS, check_task
from ..functions import ranking as R
from ..functions import vectors as V
from ..functions.text import clean_basic

# Error labels and the message for empty text.
TEXT_EMPTY = "TEXT_EMPTY"
TEXT_EMPTY_MESSAGE = '"text" is empty.'
INTERNAL_ERROR = "INTERNAL_ERROR"

ERROR_TYPE = "struct<label:string,message:string>"


class Scorer(Protocol):
    """What a pluggable model must offer: one row of logits per text."""

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def names_array(labels: Sequence[str]) -> Column:
    """Label names by id as a literal array, for a map already at hand."""
    if not labels:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(name) for name in labels])


def scores_of(logits: Column, task: str) -> Column:
    check_task(task)
    return V.softmax(logits) if task == MULTICLASS else V.sigmoid(logits)


def rank_predictions(
    df: DataFrame, task: str, names: Column, logits_col: str = "logits", out: str = "intents"
) -> DataFrame:
    """Add all (label, confidence) pairs per row, best first."""
    return (
        df.withColumn("_names", names)
        .withColumn("_scores", scores_of(F.col(logits_col), task))
        .withColumn(out, R.ranked(F.col("_scores"), F.col("_names")))
        .drop("_names", "_scores")
    )


def top_k(df: DataFrame, ranking_col: str = "intents", k: int = 3, digits: int = 4) -> DataFrame:
    """Keep the best ``k`` pairs of each ranking, confidence rounded."""
    return df.withColumn(ranking_col, R.top_k(F.col(ranking_col), k, digits))


def empty_text_error(text: Column) -> Column:
    """Error struct where nothing is left of the text after stripping, else null."""
    return F.when(
        clean_basic(text) == "",
        F.struct(F.lit(TEXT_EMPTY).alias("label"), F.lit(TEXT_EMPTY_MESSAGE).alias("message")),
    )


def gate_empty_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``error``: set for empty or whitespace-only text, else null."""
    return df.withColumn("error", empty_text_error(F.col(text_col)))


def score_with(
    df: DataFrame,
    factory: Callable[[], Scorer],
    text_col: str = "text",
    out: str = "logits",
    batch_size: int = 8,
    catch_errors: bool = False,
) -> DataFrame:
    """Add logits from a user scorer, built once per task and fed cleaned text.

    The scorer gets ``batch_size`` texts at once, empty ones too; refusing those is
    the service's business (:func:`answer_requests`). With ``catch_errors`` a failing
    batch is tried again row by row; rows that fail alone get null logits and a
    message in ``error_message``. Text of any other row is unaffected.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    cleaned = df.withColumn("_clean", clean_basic(F.col(text_col)))
    fields = [*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]
    if catch_errors:
        fields.append(T.StructField("error_message", T.StringType()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for frame in frames:
            texts = frame["_clean"].tolist()
            logits: list[list[float] | None] = [None] * len(texts)
            messages: list[str | None] = [None] * len(texts)
            for at in range(0, len(texts), batch_size):
                wanted = range(at, min(at + batch_size, len(texts)))
                try:
                    scorer = scorer or factory()
                    for i, row in _paired(scorer, texts, wanted):
                        logits[i] = row
                except Exception as problem:
                    if not catch_errors:
                        raise
                    for i in wanted:
                        try:
                            if scorer is None:
                                raise problem
                            logits[i] = _paired(scorer, texts, [i])[0][1]
                        except Exception as alone:
                            messages[i] = str(alone)
            scored = frame.drop(columns="_clean").assign(**{out: logits})
            yield scored.assign(error_message=messages) if catch_errors else scored

    return cleaned.mapInPandas(run, T.StructType(fields))


def _paired(
    scorer: Scorer, texts: Sequence[str], wanted: Sequence[int]
) -> list[tuple[int, list[float]]]:
    if not wanted:
        return []
    rows = [[float(x) for x in row] for row in scorer([texts[i] for i in wanted])]
    return list(zip(wanted, rows, strict=True))


def predict_table(
    df: DataFrame,
    task: str,
    names: Column,
    logits_col: str = "logits",
    threshold: float = 0.5,
    include_probabilities: bool = False,
) -> DataFrame:
    """Original columns plus predictions in place of the logits.

    Multiclass adds ``predicted_label`` (and ``predicted_score``); multilabel
    adds ``predicted_labels`` above the threshold (and the map
    ``predicted_scores``).
    """
    kept = [c for c in df.columns if c != logits_col]
    scored = df.withColumn("_scores", scores_of(F.col(logits_col), task)).withColumn(
        "_names", names
    )
    if task == MULTICLASS:
        best = R.decode_label(V.argmax(F.col("_scores")), F.col("_names"))
        added = [best.alias("predicted_label")]
        if include_probabilities:
            added.append(F.array_max("_scores").alias("predicted_score"))
        return scored.select(*kept, *added)
    scored = scored.withColumn("_pairs", R.above(F.col("_scores"), F.col("_names"), threshold))
    added = [F.col("_pairs.label").alias("predicted_labels")]
    if include_probabilities:
        added.append(F.map_from_entries("_pairs").alias("predicted_scores"))
    return scored.select(*kept, *added)


def answer_requests(
    scored: DataFrame,
    task: str,
    names: Column,
    id_col: str = "request_id",
    text_col: str = "text",
    logits_col: str = "logits",
    k: int = 3,
    digits: int = 4,
) -> DataFrame:
    """``request_id, intents, error`` for scored requests, batch or streaming.

    Exactly one of ``intents`` (at most ``k``) and ``error`` is set. A row without
    logits, or with one that is no number, answers with an internal error: the scorer's
    message if there is one. No such row stops the others.
    """
    message = (
        F.col("error_message") if "error_message" in scored.columns else F.lit(None).cast("string")
    )
    failed = F.when(
        F.col(logits_col).isNull() | F.exists(logits_col, lambda x: x.isNull() | F.isnan(x)),
        F.struct(
            F.lit(INTERNAL_ERROR).alias("label"),
            F.coalesce(message, F.lit("no scores")).alias("message"),
        ),
    )
    judged = scored.withColumn("error", F.coalesce(empty_text_error(F.col(text_col)), failed))
    ranked = top_k(rank_predictions(judged, task, names, logits_col), k=k, digits=digits)
    return ranked.select(
        id_col, F.when(F.col("error").isNull(), F.col("intents")).alias("intents"), "error"
    )
