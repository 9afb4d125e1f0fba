import pytest
from pyspark.sql import functions as F

from utterfold.config import MULTICLASS, MULTILABEL, CorpusConfig, validate_config
from utterfold.functions.ranking import decode_label
from utterfold.operators import labels as L
from utterfold.operators import profile as P
from utterfold.operators.cleanup import apply_cleanup, filter_combined
from utterfold.functions.text import clean_basic
from utterfold.sources.files import infer_file_type

ROWS = [
    ("alpha", "A"),
    ("Beta In CAPS", "B+C"),
    ("gamma", "A"),
    ("delta with tail  ", "C+D+E"),
    ("epsilon", "B"),
    ("only plus", "+"),
    ("no label", None),
    ("trailing plus", "F+"),
    ("leading plus", "+G"),
    ("single", "H"),
    ("again", "A+C"),
]

# Published label counts of a training and a test corpus.
TRAIN_COUNTS = {
    "flight": 3426, "airfare": 403, "ground_service": 235, "airline": 148, "abbreviation": 108,
    "aircraft": 78, "flight_time": 52, "quantity": 49, "distance": 20, "airport": 18, "city": 18,
    "ground_fare": 17, "flight+airfare": 17, "capacity": 16, "flight_no": 12, "meal": 6,
    "restriction": 5, "airline+flight_no": 2, "ground_service+ground_fare": 1,
    "airfare+flight_time": 1, "cheapest": 1, "aircraft+flight+flight_no": 1,
}
TEST_COUNTS = {
    "flight": 613, "airfare": 48, "ground_service": 36, "airline": 28, "abbreviation": 26,
    "capacity": 21, "airport": 13, "flight+airfare": 12, "distance": 10, "aircraft": 8,
    "flight_no": 8, "ground_fare": 7, "meal": 6, "city": 5, "quantity": 3, "day_name": 2,
    "flight_time": 1, "airfare+flight": 1, "flight+airline": 1, "flight_no+airline": 1,
}


def corpus(spark, counts):
    rows = [(f"{label} {i}", label) for label, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "text string, label string")


@pytest.fixture
def small(spark):
    return spark.createDataFrame(ROWS, "text string, label string")


def parts(df, text):
    return sorted(r["label"] for r in df.filter(F.col("text") == text).collect())


def test_unpack(small):
    got = L.unpack_labels(small, null_label="empty")
    assert got.count() == 18
    assert got.columns == ["text", "label"]
    assert filter_combined(got).count() == 0
    assert parts(got, "only plus") == ["", ""]
    assert parts(got, "trailing plus") == ["", "F"]
    assert parts(got, "leading plus") == ["", "G"]
    assert parts(got, "no label") == [""]
    assert parts(got, "delta with tail  ") == ["C", "D", "E"]


def test_null_label_stays_null_and_is_dropped(small):
    got = L.unpack_labels(small)
    assert got.count() == 18
    assert parts(got, "no label") == [None]
    cleaned = apply_cleanup(got, clean_basic, ["text"])
    assert cleaned.count() == 17
    assert parts(cleaned, "beta in caps") == ["B", "C"]
    assert parts(cleaned, "delta with tail") == ["C", "D", "E"]


@pytest.mark.parametrize("delim", ["|", ".", "\\E", "a+"])
def test_delimiter_is_literal(spark, delim):
    rows = [("1", "x"), ("2", f"x{delim}y"), ("3", f"x{delim}{delim}y")]
    df = spark.createDataFrame(rows, "text string, label string")
    got = L.unpack_labels(df, delim=delim)
    assert [parts(got, t) for t in "123"] == [["x"], ["x", "y"], ["", "x", "y"]]


def test_pipe_rows(spark):
    labels = ["A", "B|C", "A", "C|D|E", "B"]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(labels)], "text string, label string")
    assert L.unpack_labels(df, delim="|").count() == 8


def test_canonical(spark):
    df = spark.createDataFrame([("b+a",), ("a+b",), ("c",)], "label string")
    assert [r[0] for r in df.select(L.canonical_label(F.col("label"))).collect()] == ["a+b", "a+b", "c"]


def test_published_corpora(spark):
    train, test = corpus(spark, TRAIN_COUNTS), corpus(spark, TEST_COUNTS)
    assert (train.count(), test.count()) == (4634, 850)
    assert P.num_classes(train).first()[0] == 22
    assert P.imbalance(train).first()["imbalance_ratio"] == 3426.0
    assert P.imbalance(test).first()["imbalance_ratio"] == 613.0
    train_parts, test_parts = L.unpack_labels(train), L.unpack_labels(test)
    assert (train_parts.count(), test_parts.count()) == (4657, 865)
    base = L.build_label_map(train_parts)
    assert [r["label"] for r in base.orderBy("label_id").collect()][:3] == [
        "abbreviation", "aircraft", "airfare",
    ]
    assert base.count() == 17
    encoded_train, _ = L.prepare_labels(train_parts, MULTILABEL)
    encoded_test, _ = L.prepare_labels(test_parts, MULTILABEL, base)
    ones = F.aggregate("labels", F.lit(0.0), lambda a, x: a + x)
    assert encoded_train.agg(F.count("*"), F.sum(ones)).first()[:] == (4634, 4657.0)
    assert encoded_test.agg(F.count("*"), F.sum(ones)).first()[:] == (850, 863.0)
    assert encoded_test.filter(ones == 0).count() == 2
    assert encoded_test.filter(F.size("labels") != 17).count() == 0
    combined = L.build_label_map(train)
    kept, _ = L.prepare_labels(test, MULTICLASS, combined)
    assert kept.columns == ["text", "labels"]
    assert kept.count() == 845
    unseen = {r["label"]: r["n_rows"] for r in L.unseen_labels(test, combined).collect()}
    assert unseen == {
        "day_name": 2, "airfare+flight": 1, "flight+airline": 1, "flight_no+airline": 1,
    }


def test_label_map_bound(spark):
    df = spark.createDataFrame([(c,) for c in "abc"], "label string")
    assert L.build_label_map(df, max_labels=3).count() == 3
    with pytest.raises(Exception, match="more than 2 labels"):
        L.build_label_map(df, max_labels=2).collect()


def test_regroup_merges_equal_texts(spark):
    rows = [("t", "b"), ("t", "a"), ("t", "b"), ("u", None), (None, "x")]
    df = spark.createDataFrame(rows, "text string, label string")
    assert sorted(map(tuple, L.regroup_labels(df).collect())) == [("t", ["a", "b"]), ("u", [])]
    repeated = L.regroup_labels(df, repeats=True)
    whole = repeated.select("text", L.expand_repeats(F.col("label_list"), F.col("label_counts")))
    assert sorted(map(tuple, whole.collect())) == [("t", ["a", "b", "b"]), ("u", [])]


def test_decode(spark):
    label_map = spark.createDataFrame([("a", 0), ("c", 2)], "label string, label_id int")
    ids = spark.createDataFrame([(-1,), (0,), (1,), (2,), (3,)], "i int")
    named = ids.withColumn("names", L.label_names(label_map))
    got = [r[0] for r in named.select(decode_label(F.col("i"), F.col("names"))).collect()]
    assert got == ["UNKNOWN_-1", "a", "UNKNOWN_1", "c", "UNKNOWN_3"]


@pytest.mark.parametrize(
    ("settings", "message"),
    [
        ({"unpack": True, "label_col": None}, "label column"),
        ({"unpack": True, "delimiter": None}, "delimiter"),
        ({"unpack": True, "columns": ["a", "b"], "label_col": "c"}, "not among"),
        ({"task": MULTILABEL}, "unpack"),
        ({"task": "ranking"}, "unknown task"),
    ],
)
def test_config_errors(settings, message):
    with pytest.raises(ValueError, match=message):
        validate_config(CorpusConfig("x.tsv", **settings))


def test_multiclass_with_unpack_only_warns(caplog):
    validate_config(CorpusConfig("x.tsv", unpack=True))
    assert "multiclass" in caplog.text


def test_file_types():
    assert [infer_file_type(p) for p in ("a.TSV", "a.csv", "b.json", "b.JSONL")] == [
        "tsv", "csv", "json", "json",
    ]
    with pytest.raises(ValueError, match="extension"):
        infer_file_type("a.parquet")


def test_unknown_task_is_refused(small):
    with pytest.raises(ValueError, match="unknown task"):
        L.prepare_labels(small, "other")
