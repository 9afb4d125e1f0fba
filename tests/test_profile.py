import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterfold.operators import drift as D
from utterfold.operators import profile as P
from utterfold.plans.profile_report import run_profile
from utterfold.sources.sinks import save_profile

RNG = random.Random(11)
WORDS = ["flight", "the", "to", "boston", "cannot", "a", "x", "fare", "list", "é"]
TEXTS = [" ".join(RNG.choices(WORDS, k=RNG.randrange(0, 12))) for _ in range(60)] + ["", "b", "z"]
LABELS = [RNG.choice("pqr") for _ in TEXTS]
STOP = {"the", "to", "a"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, label) for i, (t, label) in enumerate(zip(TEXTS, LABELS, strict=True))]
    return spark.createDataFrame(rows, "id bigint, text string, label string").repartition(5)


def tokens(text):
    return text.replace("cannot", "can not").split()


def kept(text):
    return [t for t in tokens(text) if t not in STOP and t not in ("can", "not")]


def test_terms_follow_counter_order(corpus):
    terms = P.term_counts(corpus, "id", words=STOP | {"can", "not"})
    bag = [t for text in TEXTS for t in kept(text)]
    common = Counter(bag).most_common()
    got = P.top_terms(P.without_stopwords(terms), 5).orderBy("rank").collect()
    assert [(r["term"], r["n"]) for r in got] == common[:5]
    got = P.rare_terms(P.without_stopwords(terms), 5).orderBy("rank").collect()
    assert [(r["term"], r["n"]) for r in got] == common[:-6:-1]
    assert P.vocab_size(P.without_stopwords(terms)).first()[0] == len(common)


@pytest.mark.parametrize("n", [2, 3])
def test_ngrams_span_removed_stopwords(corpus, n):
    grams = Counter()
    for text in TEXTS:
        bag = kept(text)
        grams.update(" ".join(bag[i : i + n]) for i in range(len(bag) - n + 1))
    table = P.ngram_counts(corpus, "id", n, words=STOP | {"can", "not"})
    got = P.top_ngrams(table, 10).orderBy("rank").collect()
    assert [(r["term"], r["n"]) for r in got] == grams.most_common(10)
    assert table.agg(F.sum("n")).first()[0] == sum(grams.values())


def test_single_words_are_not_ngrams(corpus):
    with pytest.raises(ValueError):
        P.ngram_counts(corpus, "id", 1)


def test_row_ids_of_any_size(spark):
    big = 2**62
    rows = [(-big, "late early"), (big, "first"), (-big - 1, "early late")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = P.top_terms(P.term_counts(df, "id", words=()), 3).orderBy("rank").collect()
    assert [r["term"] for r in got] == ["early", "late", "first"]


def test_lengths_describe_like_numpy(corpus):
    lengths = P.length_counts(corpus)
    words = np.array([len(tokens(t)) for t in TEXTS])
    row = P.describe_length(lengths).filter("measure = 'word'").first()
    assert row["count"] == len(TEXTS)
    assert row["mean"] == pytest.approx(words.mean())
    assert row["std"] == pytest.approx(words.std(ddof=1))
    assert [row["min"], row["q25"], row["q50"], row["q75"], row["max"]] == [
        words.min(), *np.percentile(words, [25, 50, 75]), words.max(),
    ]
    bins = P.length_histogram(lengths).filter("measure = 'word'").orderBy("bin").collect()
    counts, edges = np.histogram(words, bins=50)
    assert [b["n"] for b in bins] == counts.tolist()
    assert [b["bin_start"] for b in bins] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_equal_lengths(spark):
    df = spark.createDataFrame([("abc", "x")] * 4, "text string, label string")
    bins = P.length_histogram(P.length_counts(df), 10).filter("measure = 'char' and n > 0").collect()
    assert [(b["n"], b["bin_start"]) for b in bins] == [(4, 3.0)]
    row = P.describe_length(P.length_counts(df.limit(1))).first()
    assert np.isnan(row["std"])


def test_boxes_like_matplotlib_defines_them(spark):
    sizes = [1, 2, 2, 3, 3, 3, 4, 4, 30]
    df = spark.createDataFrame([("x" * n, "k") for n in sizes], "text string, label string")
    box = P.length_box_by_class(P.length_counts(df)).filter("measure = 'char'").first()
    q25, q50, q75 = np.percentile(sizes, [25, 50, 75])
    assert (box["q25"], box["q50"], box["q75"]) == (q25, q50, q75)
    inside = [s for s in sizes if q25 - 1.5 * (q75 - q25) <= s <= q75 + 1.5 * (q75 - q25)]
    assert (box["whisker_low"], box["whisker_high"]) == (min(inside), max(inside))
    assert box["n_outliers"] == len(sizes) - len(inside)


def test_zipf_writes_every_rank_once(spark, monkeypatch):
    monkeypatch.setattr(P, "_RANKS_PER_CHUNK", 3)
    counts = [9, 5, 5, 2, 1, 1, 1, 1, 1, 1, 1]
    terms = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(counts)], "term string, n bigint")
    got = P.zipf(terms).orderBy("rank").collect()
    assert [(r["rank"], r["frequency"]) for r in got] == list(enumerate(counts, 1))
    assert got[2]["ideal"] == 3.0


def test_classes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "label string")
    assert [tuple(r) for r in P.label_distribution(df).collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert P.num_classes(df).first()[0] == 3
    assert P.imbalance(df).first()["imbalance_ratio"] == 2.0
    assert P.imbalance(df.filter("label = 'a'")).count() == 0
    zero = spark.createDataFrame([("a", 3), ("b", 0)], "label string, n bigint")
    assert P.imbalance_of(zero).first()["imbalance_ratio"] == float("inf")
    assert sorted(r["label"] for r in P.top_classes(df, k=2).collect()) == ["a", "a", "b"]
    assert [tuple(r) for r in P.class_order(df, k=2).orderBy("position").collect()] == [(1, "a"), (2, "b")]


def test_full_profile(corpus, tmp_path):
    report = run_profile(corpus, "id")
    assert len(report) == 18
    assert report["shape"].first()["n_rows"] == len(TEXTS)
    assert report["target_distribution"].agg(F.sum("n")).first()[0] == len(TEXTS)
    save_profile({k: report[k] for k in ("num_classes", "imbalance")}, "train", str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"num_classes", "imbalance"}
    assert set(run_profile(corpus, "id", deep=False)) < set(report)


def test_profile_drops_incomplete_rows_and_cleans(spark):
    rows = [(1, "Hello, hello!", "a"), (2, "x", None), (3, None, "b")]
    report = run_profile(spark.createDataFrame(rows, "id bigint, text string, label string"), "id")
    assert report["shape"].first()["n_rows"] == 2
    words = [tuple(r) for r in report["most_common_words"].collect()]
    assert words == [(1, "hello", 2)]
    assert {r["n_missing"] for r in report["missing_values"].collect()} == {0}


def test_drift(spark):
    a = spark.createDataFrame([("x",)] * 3 + [("y",)], "label string")
    b = spark.createDataFrame([("x",), ("z",)], "label string")
    got = {r["label"]: (r["n_a"], r["n_b"], r["status"]) for r in D.label_drift(a, b).collect()}
    assert got == {"x": (3, 1, "shared"), "y": (1, 0, "missing"), "z": (0, 1, "new")}
    shares = D.label_drift(a, b).agg(F.sum("share_a"), F.sum("share_b")).first()
    assert tuple(shares) == (1.0, 1.0)
    terms = [
        spark.createDataFrame(rows, "term string, n bigint")
        for rows in ([("p", 5), ("q", 3), ("r", 3)], [("q", 9), ("s", 1)])
    ]
    ranks = {r["term"]: (r["rank_a"], r["rank_b"]) for r in D.term_rank_change(*terms, 2).collect()}
    assert ranks == {"p": (1, None), "q": (2, 1), "s": (None, 2)}
    assert D.vocab_drift(*terms).first().asDict() == {
        "vocab_a": 3, "vocab_b": 2, "n_shared": 1, "n_only_a": 2, "n_only_b": 1,
    }
