import pytest
from pyspark.sql import functions as F

from utterfold.config import MULTICLASS, MULTILABEL, CorpusConfig
from utterfold.operators import labels as L
from utterfold.plans.prepare import load_corpus
from utterfold.sources import files, sinks

TSV = (
    "alpha\tA\nBeta In CAPS\tB+C\ngamma\tA\ndelta with tail  \tC+D+E\nepsilon\tB\nonly plus\t+\n"
    "no label\t\ntrailing plus\tF+\nleading plus\t+G\nsingle\tH\nagain\tA+C\n"
)


@pytest.fixture
def write(tmp_path):
    def _write(name, content):
        path = tmp_path / name
        path.write_text(content, encoding="utf8")
        return str(path)

    return _write


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tsv_without_header(spark, write):
    df = files.read_corpus(spark, write("a.tsv", TSV), columns=["text", "label"])
    assert df.columns == ["text", "label"]
    assert df.count() == 11
    got = dict(rows(df))
    assert got["Beta In CAPS"] == "B+C"
    assert got["no label"] is None
    assert got["delta with tail  "] == "C+D+E"


def test_csv_with_header_and_quotes(spark, write):
    path = write("a.CSV", 'text,label\n"one, ""two""",x\nthree,NA\n\nfour,none\n')
    assert rows(files.read_corpus(spark, path)) == [
        ("four", "none"), ('one, "two"', "x"), ("three", None),
    ]
    assert ("three", "NA") in rows(files.read_corpus(spark, path, na_tokens=None))


def test_line_breaks_inside_quotes(spark, write):
    path = write("a.csv", 'text,label\n"one\ntwo",x\n')
    assert rows(files.read_corpus(spark, path, multi_line=True)) == [("one\ntwo", "x")]


def test_json_lines(spark, write):
    content = '{"text": "a\\tb", "label": "x", "n": 1}\n{"text": "c"}\n'
    for name in ("a.json", "b.jsonl"):
        path = write(name, content)
        assert rows(files.read_corpus(spark, path, columns=["text", "label"])) == [
            ("a\tb", "x"), ("c", None),
        ]
    assert sorted(files.read_corpus(spark, path).columns) == ["label", "n", "text"]


def test_ragged_rows(spark, write):
    short = write("short.tsv", "a\tb\nonly text\n")
    assert rows(files.read_corpus(spark, short, columns=["t", "l"])) == [("a", "b"), ("only text", None)]
    long = write("long.tsv", "a\tb\na\tb\tc\n")
    with pytest.raises(Exception, match="more fields than columns"):
        files.read_corpus(spark, long, columns=["t", "l"]).count()
    with pytest.raises(Exception, match="more fields than columns"):
        files.read_corpus(spark, long, columns=["t", "l"]).select("t").collect()


def test_unknown_types(spark, write):
    with pytest.raises(ValueError):
        files.read_corpus(spark, write("a.parquet", ""))
    with pytest.raises(ValueError):
        files.read_corpus(spark, write("b.tsv", ""), file_type="xml")


def test_load_corpus(spark, write):
    config = CorpusConfig(
        write("a.tsv", TSV), columns=["text", "label"], task=MULTILABEL, unpack=True,
        null_label="empty",
    )
    df = load_corpus(spark, config)
    assert df.count() == 18
    assert df.filter("text = 'beta in caps'").count() == 2
    with pytest.raises(ValueError, match="label column"):
        load_corpus(spark, CorpusConfig(write("b.csv", "text,other\na,b\n")))


def test_scoring_input_keeps_empty_strings(spark, write):
    tsv = write("in.TSV", "id\ttext\n1\t\n2\tNA\n")
    assert rows(files.read_scoring_input(spark, tsv)) == [("1", ""), ("2", "NA")]
    other = write("in.txt", "id,text\n1,x\n")
    assert rows(files.read_scoring_input(spark, other)) == [("1", "x")]
    with pytest.raises(ValueError, match="text column"):
        files.read_scoring_input(spark, other, "body")


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [('say "hi", now', ["a", "b"], {"a": 0.5})],
        "text string, predicted_labels array<string>, predicted_scores map<string,double>",
    )
    path = str(tmp_path / "out")
    sinks.write_predictions(df, path)
    assert rows(files.read_scoring_input(spark, path)) == [('say "hi", now', '["a","b"]', '{"a":0.5}')]


def test_label_map_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",)], "label string")
    path = str(tmp_path / "map")
    sinks.save_label_map(L.build_label_map(df), path)
    assert rows(sinks.load_label_map(spark, path)) == [("a", 0), ("b", 1)]
    with pytest.raises(Exception, match="more than 1 labels"):
        sinks.load_label_map(spark, path, max_labels=1).collect()
    encoded = L.encode_multiclass(df, sinks.load_label_map(spark, path))
    assert rows(encoded) == [("a", 0), ("b", 1)]


def test_metrics_append_per_split(spark, tmp_path):
    path = str(tmp_path / "metrics")
    one = spark.createDataFrame([("f1", 0.5), ("auc", float("nan"))], "metric string, value double")
    sinks.save_metrics(one, "r", "eval", path)
    sinks.save_metrics(one, "r", "test", path)
    merged = sinks.load_metrics(spark, path)
    assert merged.columns == ["run_id", "split", "metric", "value"]
    assert merged.count() == 4
    assert merged.filter(F.isnan("value")).count() == 2


def test_training_set(spark, tmp_path):
    path = str(tmp_path / "set")
    train = spark.createDataFrame([("a", [1.0, 0.0])], "text string, labels array<float>")
    sinks.export_training_set({"train": train, "validation": train}, path, MULTILABEL, 2)
    back = sinks.load_training_set(spark, path)
    assert dict(back.dtypes) == {"text": "string", "labels": "array<float>", "split": "string"}
    assert back.filter("split = 'train'").count() == 1
    with pytest.raises(Exception, match="do not fit"):
        sinks.export_training_set({"train": train}, path, MULTILABEL, 3)
    single = spark.createDataFrame([("a", 5)], "text string, labels int")
    with pytest.raises(Exception, match="do not fit"):
        sinks.training_rows(single, MULTICLASS, 5).collect()
