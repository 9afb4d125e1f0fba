"""What grows with the data in round four: features, streams, fits and profiles."""

import random

import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from test_records import SETTING, delimited

from utterfold.functions import text as T
from utterfold.operators.joint_fit import _Block, _stored_blocks
from utterfold.operators.model import model_tokens
from utterfold.operators.one_scan import _items
from utterfold.registry import QUERIES
from utterfold.sources import files
from utterfold.streaming.corpus import stream_corpus


def documents(spark, folder, texts, lang="en"):
    rows = [(i, t, lang, "web") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{folder}/documents.parquet")


def test_features_are_summed_as_they_are_stored(spark, tmp_path):
    documents(spark, str(tmp_path), ["one two two", "two three", None, ""])
    df = QUERIES["featurize_counts"](spark, str(tmp_path))
    got = {r["doc_id"]: r["n_terms"] for r in df.collect()}
    assert got == {0: 2, 1: 2, 2: 0, 3: 0}
    # a dense array per document is as long as the vocabulary
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "unwrap_udt" in plan.lower() and "vector" not in plan.lower().replace("vectorudt", "")


def conversations(spark, texts):
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def test_requests_are_streamed_from_a_table_of_many_files(spark, tmp_path):
    turns = conversations(spark, ["a", "b", "c", "d"]).repartition(3)
    turns.write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    (tmp_path / "one").mkdir()
    frame = pd.DataFrame({"conv_id": [1], "turn": [0], "role": ["user"], "text": ["a"]})
    frame.to_parquet(tmp_path / "one" / "conversations.parquet")
    for folder, n in (("many", 4), ("one", 1)):
        df = QUERIES["score_stream_replayed"](spark, str(tmp_path / folder))
        got = {r["request_id"]: r["n_answers"] for r in df.collect()}
        assert got == {f"1-{i}": 1 for i in range(n)}


def drained(spark, rows, tmp_path, name):
    run = (
        rows.writeStream.format("parquet")
        .option("path", str(tmp_path / name))
        .option("checkpointLocation", str(tmp_path / f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(str(tmp_path / name))


@pytest.mark.parametrize("seed, kind", [(1, "csv"), (2, "tsv"), (5, "csv")])
def test_streamed_files_may_be_larger_than_a_split(spark, tmp_path, seed, kind):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        content, _ = delimited(seed + 10 * i, files.SEPARATORS[kind])
        extra = '\n\r\n151,"x\r\n\r\n""y""\n\n" z,"a"b"c\r\n152,six" tall,w\n'
        extra = extra.replace(",", files.SEPARATORS[kind])
        (folder / f"{i}.{kind}").write_text(content + extra, encoding="utf8", newline="")
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, "64")
    try:
        columns = ["i", "a", "b"]
        got = drained(spark, stream_corpus(spark, str(folder), columns, kind), tmp_path, "out")
        wanted = files.read_corpus(spark, str(folder), kind, columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
        headed = stream_corpus(spark, str(folder), columns, kind, header=True)
        assert drained(spark, headed, tmp_path, "headed").count() == wanted.count() - 3
    finally:
        spark.conf.set(SETTING, before)


@pytest.mark.parametrize("extra", ["c", "c,d", "c,d,e"])
def test_streamed_records_with_more_fields_fail(spark, tmp_path, extra):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f"a,b\na,b,{extra}\n")
    with pytest.raises(Exception, match="more fields than columns"):
        rows = stream_corpus(spark, str(tmp_path / "in"), ["x", "y"], "csv")
        drained(spark, rows, tmp_path, "out")


def test_tokens_of_a_long_text_are_those_of_its_beginning(spark):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " ", "cannot", "«", "»", "ΑΣ", "lemme", "gonna", "-", "a", "é"]
    texts = ["".join(rng.choices(parts, k=rng.choice([0, 5, 60, 200]))) for _ in range(300)]
    rows = [(t,) for t in [*texts, None, "x" * 500, "x" * 500 + " a b", "- " * 300 + "a b"]]
    df = spark.createDataFrame(rows, "text string")
    for n in (1, 3, 20):
        whole = T.truncate_tokens(T.tokens(T.clean_punct(T.clean_basic(F.col("text")))), n)
        got = model_tokens(F.col("text"), n)
        assert df.where(~got.eqNullSafe(whole)).count() == 0
        assert "substring_index" in df.select(got)._jdf.queryExecution().analyzed().toString()


def test_blocks_keep_the_order_of_their_bins(spark):
    rows = [(Vectors.sparse(9, {7: 1.0, 2: 2.0}), [1.0]), (Vectors.sparse(9, {2: 3.0}), [0.0])]
    stored = _stored_blocks(spark.createDataFrame(rows, ["features", "labels"]).coalesce(1))
    (row,) = stored.collect()
    block = _Block.read(*row)
    assert block.bins.tolist() == [2, 7, 2] and block.by_bin.tolist() == [0, 2, 1]
    assert block.bin_starts.tolist() == [0, 2]


def test_a_profile_splits_each_text_once(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "id int, text string, label string")
    items = str(_items(df, "text", F.col("label"), ["the"], (2, 3)))
    assert items.count("split(") == 1
