import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from utterfold.config import MULTICLASS
from utterfold.operators import labels as L
from utterfold.operators.scoring import gate_empty_text, score_with
from utterfold.sources.files import read_corpus
from utterfold.streaming.corpus import stream_corpus
from utterfold.streaming.scoring import score_stream_with, write_answers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABELS = ["short", "long"]


class Length:
    def __call__(self, texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("cannot score boom")
        return [[-float(len(t)), float(len(t))] for t in texts]


class Broken:
    def __init__(self):
        raise RuntimeError("no model")


REQUESTS = [
    (1, "hello"), (2, ""), (3, " \t"), (4, None), (5, "boom"), (6, "ok"), (7, "fine again"),
]


def answers(df):
    return {r["request_id"]: (r["intents"], r["error"]) for r in df.collect()}


def check(got):
    assert set(got) == set(range(1, 8))
    for i in (2, 3, 4):
        assert got[i][0] is None
        assert tuple(got[i][1]) == ("TEXT_EMPTY", '"text" is empty.')
    assert got[5][0] is None
    assert tuple(got[5][1]) == ("INTERNAL_ERROR", "cannot score boom")
    for i in (1, 6, 7):
        assert got[i][1] is None
        assert [p["label"] for p in got[i][0]] == ["long", "short"]


def test_batch_and_stream_give_the_same_answers(spark, tmp_path):
    requests = spark.createDataFrame(REQUESTS, "request_id int, text string")
    batch = score_stream_with(requests, Length, MULTICLASS, LABELS, batch_size=3)
    check(answers(batch))
    source = str(tmp_path / "in")
    requests.repartition(3).write.json(source)
    stream = spark.readStream.schema(requests.schema).json(source)
    answered = score_stream_with(stream, Length, MULTICLASS, LABELS, batch_size=3)
    query = write_answers(answered, str(tmp_path / "out"), str(tmp_path / "progress"), True)
    query.awaitTermination()
    check(answers(spark.read.schema(answered.schema).json(str(tmp_path / "out"))))


def test_a_model_that_does_not_load_answers_with_errors(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "")], "request_id int, text string")
    got = answers(score_stream_with(requests, Broken, MULTICLASS, LABELS))
    assert got[1][1]["label"] == "INTERNAL_ERROR" and got[2][1]["label"] == "TEXT_EMPTY"


def test_scorer_errors_surface_in_batch_scoring(spark):
    rows = spark.createDataFrame([("boom",)], "text string")
    with pytest.raises(Exception, match="cannot score boom"):
        score_with(rows, Length).collect()
    with pytest.raises(ValueError):
        score_with(rows, Length, batch_size=0)


def test_gate(spark):
    df = gate_empty_text(spark.createDataFrame(REQUESTS, "request_id int, text string"))
    assert df.filter(F.col("error").isNotNull()).count() == 3


def test_streamed_corpus_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.tsv").write_text(f"text {i}\tA+B\nother {i}\tNA\n")
    stream = stream_corpus(spark, str(source), ["text", "label"], max_files_per_trigger=1)
    unpacked = L.unpack_labels(stream)
    query = (
        unpacked.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = L.unpack_labels(read_corpus(spark, str(source), "tsv", ["text", "label"]))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, batch.collect()))
    assert got.count() == 9
