"""Records, scores and keys at their edges."""

import math

import pytest

from utterfold.operators import curves
from utterfold.operators import metrics as M
from utterfold.operators.model import term_weights
from utterfold.operators.scoring import score_with
from utterfold.operators.split import split_exact
from utterfold.sources import files, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def write(tmp_path):
    def _write(name, content):
        path = tmp_path / name
        path.write_text(content, encoding="utf8")
        return str(path)

    return _write


def test_quoted_breaks_in_scoring_input(spark, write):
    path = write("in.csv", 'id,text\n1,"hello\nworld"\n2,plain\n3\n')
    got = [("1", "hello\nworld"), ("2", "plain"), ("3", "")]
    assert rows(files.read_scoring_input(spark, path)) == got
    with pytest.raises(Exception, match="unclosed quote"):
        files.read_scoring_input(spark, path, multi_line=False).collect()
    with pytest.raises(Exception, match="more fields than columns"):
        files.read_scoring_input(spark, write("long.csv", "id,text\n1,a,b\n")).collect()


def test_predictions_with_breaks_come_back(spark, tmp_path):
    df = spark.createDataFrame([(" a\nb ", "x")], "text string, label string")
    path = str(tmp_path / "out")
    sinks.write_predictions(df, path)
    assert rows(files.read_scoring_input(spark, path)) == [(" a\nb ", "x")]


def test_metrics_of_a_run_are_replaced(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for value in (0.5, 0.25):
        one = spark.createDataFrame([("f1", value)], "metric string, value double")
        sinks.save_metrics(one, "r", "eval", path)
    assert rows(sinks.load_metrics(spark, path)) == [("r", "eval", "f1", 0.25)]


@pytest.mark.parametrize("per_bucket", [1, 1000])
def test_nan_score_blanks_its_label(spark, per_bucket):
    nan = float("nan")
    df = spark.createDataFrame(
        [([1, 1], [0.9, nan]), ([0, 0], [0.2, 0.4]), ([1, 0], [0.8, 0.1])],
        "truth array<int>, score array<double>",
    )
    counts = curves.score_counts(df, "truth", "score")
    got = {r["label_id"]: r for r in curves.ranking_curves(counts, True, per_bucket).collect()}
    assert got[0]["auc"] == 1.0 and got[0]["ap"] == 1.0
    assert all(math.isnan(got[i][c]) for i in (1, curves.POOLED) for c in ("auc", "ap"))


def test_arrays_of_unequal_length(spark):
    df = spark.createDataFrame([([1, 0], [1])], "t array<int>, p array<int>")
    with pytest.raises(Exception, match="differ in length"):
        M.label_counts(df, "t", "p").collect()
    with pytest.raises(Exception, match="differ in length"):
        curves.score_counts(df, "t", "p").collect()


def test_split_keys_do_not_run_together(spark):
    df = spark.createDataFrame([("a-b", "c"), ("a", "b-c")], "x string, y string")
    train, held = split_exact(df, 0.5, ["x", "y"])
    assert train.count() == held.count() == 1


def test_scorer_gets_empty_texts_in_one_batch(spark):
    class Length:
        def __call__(self, texts):
            return [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.createDataFrame([("",), ("abc",), (None,)], "text string").coalesce(1)
    got = [r["logits"] for r in score_with(df, Length, batch_size=2).collect()]
    assert got == [[0.0, 2.0], [3.0, 2.0], [0.0, 1.0]]


def test_term_weights(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id int, text string")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in term_weights(df).collect()}
    assert got[1, "a"] == pytest.approx(2 * math.log(2))
    assert got[2, "b"] == pytest.approx(math.log(4 / 3))
