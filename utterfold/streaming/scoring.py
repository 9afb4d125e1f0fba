"""Scoring a stream of requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import IntentModel
from ..operators.scoring import ERROR_TYPE, Scorer, answer_requests, names_array, score_with


def score_stream(
    requests: DataFrame, model: IntentModel, id_col: str = "request_id", text_col: str = "text"
) -> DataFrame:
    """Answer requests with a fitted model: three best intents or an error row.

    Stateless, so it takes a stream or a table and gives the same rows.
    """
    return answer_requests(
        model.transform(requests, text_col),
        model.task,
        names_array(model.labels),
        id_col,
        text_col,
    )


def score_stream_with(
    requests: DataFrame,
    factory: Callable[[], Scorer],
    task: str,
    labels: Sequence[str],
    id_col: str = "request_id",
    text_col: str = "text",
    batch_size: int = 8,
) -> DataFrame:
    """As :func:`score_stream` with a user scorer; a row it fails on becomes an error row."""
    scored = score_with(requests, factory, text_col, batch_size=batch_size, catch_errors=True)
    return answer_requests(scored, task, names_array(labels), id_col, text_col)


def replacing(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for ``foreachBatch`` that may see a batch more than once.

    Every batch has a partition of its own; a batch that is replayed after a crash
    replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("batch", F.lit(number).cast("bigint"))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch"
        ).json(path)

    return write


def write_answers_once(
    answers: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """As :func:`write_answers`, each request answered once whatever is replayed."""
    writer = answers.writeStream.foreachBatch(replacing(path))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, intents, error`` of what :func:`write_answers_once` left."""
    intents = "array<struct<label:string,confidence:double>>"
    schema = f"request_id string, intents {intents}, error {ERROR_TYPE}, batch bigint"
    return spark.read.schema(schema).json(path).drop("batch")


def write_answers(
    answers: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start writing answers as JSON; ``available_now`` ends after the data at hand."""
    writer = answers.writeStream.format("json").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
