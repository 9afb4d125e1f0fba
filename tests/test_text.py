import string
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from utterfold.functions import text as T
from utterfold.operators import cleanup as C
from utterfold.operators.batches import map_batches, python_cleanup

CASES = [
    (None, "", ""),
    ("  Hello, World!\t", "hello, world!", "hello world"),
    ("a-b", "a-b", "ab"),
    ("x  y\nz", "x  y\nz", "x y z"),
    ("$5+3", "$5+3", "53"),
    ("a’b", "a’b", "a’b"),
    ("  Wide　", "wide", "wide"),
    ("\x1cmark\x1f", "mark", "mark"),
    ("   ", "", ""),
]


def run(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r[1:]) for r in df.select("i", *columns).orderBy("i").collect()]


def test_cleanup(spark):
    got = run(spark, [c[0] for c in CASES], T.clean_basic(F.col("s")), T.clean_punct(F.col("s")))
    assert got == [c[1:] for c in CASES]


def test_whitespace_is_what_python_strips():
    every = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(T.WHITESPACE) == every


def test_punctuation_is_the_ascii_set(spark):
    assert run(spark, [string.punctuation + "é"], T.clean_punct(F.col("s"))) == [("é",)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=string.printable + "éß’« 　\x1d", max_size=30), min_size=1, max_size=20))
def test_cleanup_equals_python(spark, values):
    drop = str.maketrans("", "", string.punctuation)
    expected = [
        (v.lower().strip(), " ".join(v.lower().translate(drop).split())) for v in values
    ]
    assert run(spark, values, T.clean_basic(F.col("s")), T.clean_punct(F.col("s"))) == expected


def test_tokens(spark):
    values = [
        "", "plain words", "i cannot go", "gonna wanna gotta gimme lemme", "cannots uncannot",
        "say «hi» there", "it’s", "wanna",
    ]
    assert [r[0] for r in run(spark, values, T.tokens(F.col("s")))] == [
        [],
        ["plain", "words"],
        ["i", "can", "not", "go"],
        ["gon", "na", "wan", "na", "got", "ta", "gim", "me", "lem", "me"],
        ["cannots", "uncannot"],
        ["say", "«", "hi", "»", "there"],
        ["it", "’", "s"],
        ["wan", "na"],
    ]
    assert [r[0] for r in run(spark, values, T.word_length(F.col("s")))] == [0, 2, 4, 10, 2, 5, 3, 2]
    exploded = run(spark, values, F.filter(T.raw_tokens(F.col("s")), lambda t: t != ""))
    assert exploded == run(spark, values, T.tokens(F.col("s")))


def test_kept_tokens_and_truncation(spark):
    values = ["the quick «fox» and the dog", "a the of"]
    assert [r[0] for r in run(spark, values, T.kept_tokens(F.col("s")))] == [["quick", "fox", "dog"], []]
    assert run(spark, values, T.kept_tokens(F.col("s"), words=[]))[1] == (["a", "the", "of"],)
    assert run(spark, values, T.truncate_tokens(T.tokens(F.col("s")), 2))[0] == (["the", "quick"],)
    with pytest.raises(ValueError):
        T.truncate_tokens(F.col("s"), 0)


def test_alnum_equals_python(spark):
    values = ["abc", "é1", "a_b", "½", "Ⅷ", "中文", "a’b", "", "٣", "é"]
    got = [r[0] for r in run(spark, values, T.is_alnum(F.col("s")))]
    assert got == [v.isalnum() for v in values]
    assert unicodedata.category("́") == "Mn"


def test_stopword_list():
    assert len(T.ENGLISH_STOPWORDS) == len(set(T.ENGLISH_STOPWORDS)) == 179
    assert {"would", "could", "like", "one"}.isdisjoint(T.ENGLISH_STOPWORDS)


def frame(spark):
    rows = [(" A ", "x", 1), (None, "Y", 2), ("B", None, 3)]
    return spark.createDataFrame(rows, "t string, u string, n int")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_apply_cleanup(spark):
    df = frame(spark)
    assert rows(C.apply_cleanup(df, T.clean_basic, ["t", "zzz"])) == [("", "Y", 2), ("a", "x", 1)]
    assert rows(C.apply_cleanup(df, T.clean_basic, ["u"], [0])) == [(" A ", "x", 1), ("B", "", 3)]
    assert rows(C.apply_cleanup(df, T.clean_basic, None, [1, 7, -1])) == [(" A ", "x", 1), ("B", "", 3)]
    assert rows(C.apply_cleanup(df, None)) == [(" A ", "x", 1)]


def test_drop_incomplete_counts_nan_as_missing(spark):
    rows_in = [(1.0, "a", [1]), (float("nan"), "b", [1]), (None, "c", [1]), (2.0, None, [1]), (3.0, "d", None)]
    df = spark.createDataFrame(rows_in, "`x.y` double, s string, a array<int>")
    assert [r["s"] for r in C.drop_incomplete(df).collect()] == ["a"]
    assert C.drop_incomplete(spark.range(2)).count() == 2


def test_cleaned_text_is_not_cleaned_again_to_test_it(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark).write.parquet(path)
    got = C.apply_cleanup(spark.read.parquet(path), T.clean_punct, ["t"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(regexp_replace(") == 1
    assert "IsNotNull(u)" in plan


@pytest.mark.parametrize("choice", [{"names": ["zzz"]}, {"indices": [9]}, {}])
def test_cleanup_without_valid_column_keeps_everything(spark, choice):
    df = frame(spark)
    assert C.apply_cleanup(df, T.clean_basic, **choice) is df


def test_python_cleanup(spark):
    got = C.apply_cleanup(frame(spark), python_cleanup(lambda s: (s or "?")[::-1]), ["t"])
    assert rows(got) == [(" A ", "x", 1), ("?", "Y", 2)]


def test_map_batches(spark):
    df = spark.range(10).repartition(2)
    sizes = map_batches(
        df, lambda part: part.assign(n=len(part))[["n"]].head(1), "n bigint", batch_size=3
    )
    assert sum(r["n"] for r in sizes.collect()) == 10
    assert max(r["n"] for r in sizes.collect()) <= 3
