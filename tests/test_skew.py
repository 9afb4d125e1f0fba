"""A third of all rows share one text, one label and one score."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from utterfold.config import MULTILABEL
from utterfold.operators import curves
from utterfold.operators import labels as L
from utterfold.operators import profile as P
from utterfold.operators.split import split_exact

HOT = "the hot text"
RNG = random.Random(4)
ROWS = [
    (i, HOT, "hot+" + RNG.choice("ab")) if i % 3 == 0 else
    (i, f"text {i % 97} {RNG.randrange(5)}", "+".join(RNG.sample("abcd", 2)))
    for i in range(3000)
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, "id bigint, text string, label string").repartition(7)


@pytest.fixture(scope="module")
def by_text():
    grouped = defaultdict(Counter)
    for _, text, label in ROWS:
        grouped[text].update(label.split("+"))
    return grouped


def test_hot_text_keeps_all_its_labels(corpus, by_text):
    parts = L.unpack_labels(corpus)
    got = {r["text"]: r for r in L.regroup_labels(parts, repeats=True).collect()}
    assert got.keys() == by_text.keys()
    for text, row in got.items():
        assert dict(zip(row["label_list"], row["label_counts"], strict=True)) == by_text[text]


def test_hot_text_arrives_collapsed(spark, corpus):
    """Before the shuffle a task holds at most one row per text, not one per occurrence."""
    plan = L.regroup_labels(L.unpack_labels(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set" in plan
    assert "partial_count" in P.term_counts(corpus, "id")._jdf.queryExecution().executedPlan().toString()


def test_multi_hot_of_skewed_texts(corpus, by_text):
    parts = L.unpack_labels(corpus)
    encoded, label_map = L.prepare_labels(parts, MULTILABEL)
    ids = {r["label"]: r["label_id"] for r in label_map.collect()}
    for row in encoded.collect():
        on = {i for i, x in enumerate(row["labels"]) if x}
        assert on == {ids[name] for name in by_text[row["text"]]}


def test_split_of_skewed_texts(corpus):
    train, validation = split_exact(corpus, 0.25, "id")
    assert (train.count(), validation.count()) == (2250, 750)


def test_terms_of_skewed_texts(corpus):
    words = Counter(w for _, text, _ in ROWS for w in text.split())
    got = {r["term"]: r["n"] for r in P.term_counts(corpus, "id").collect()}
    assert got == words


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 20])
def test_hot_score(spark, rows_per_bucket):
    rng = random.Random(9)
    rows = [
        ([float(rng.random() < 0.4)], [0.5 if i % 3 == 0 else round(rng.random(), 2)])
        for i in range(900)
    ]
    counts = curves.score_counts(spark.createDataFrame(rows, "t array<float>, s array<double>"), "t", "s")
    assert counts.count() <= 101
    row = curves.ranking_curves(counts, rows_per_bucket=rows_per_bucket).first()
    pos = [s[0] for t, s in rows if t[0]]
    neg = [s[0] for t, s in rows if not t[0]]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert row["auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_lengths_of_a_hot_class(corpus):
    lengths = P.length_counts(corpus.withColumn("label", F.lit("one")))
    assert lengths.agg(F.sum("n")).first()[0] == 2 * len(ROWS)
    assert P.length_box_by_class(lengths).count() == 2
