"""Joint fits, exact leading n-grams, one-scan profiles, drift by side, label dictionaries."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from utterfold.config import MULTILABEL, CorpusConfig
from utterfold.operators import drift as D
from utterfold.operators import joint_fit as J
from utterfold.operators import labels as L
from utterfold.operators import model as M
from utterfold.operators import ngrams as N
from utterfold.operators import profile as P
from utterfold.operators.lookup import dictionary_join
from utterfold.plans.prepare import prepare
from utterfold.plans.profile_report import report_rows, run_profile


def labelled(spark, n, d, k, seed=3):
    """Sparse rows whose labels depend on some of the words."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(d)]
    weights = rng.normal(0, 2, (k, d)) * (rng.random((k, d)) < 0.2)
    rows = []
    for i in range(n):
        held = rng.choice(d, rng.integers(0, 9))
        margin = weights[:, held].sum(axis=1) + rng.normal(0, 1, k) - 0.5
        rows.append((i, " ".join(words[j] for j in held) or "none", [float(m > 0) for m in margin]))
    return spark.createDataFrame(rows, "id long, text string, labels array<float>").repartition(5)


def named(spark, k):
    return spark.createDataFrame([(f"l{i:04d}", i) for i in range(k)], "label string, label_id int")


def test_joint_fit_equals_separate_fits(spark):
    k = 4
    df = labelled(spark, 400, 30, k)
    model = M.fit_multilabel(df, named(spark, k), n_features=1 << 7, reg_param=1e-2, max_iter=400)
    features = model.features.transform(M.with_tokens(df))
    for i in range(k):
        train = features.select("features", F.get("labels", F.lit(i)).cast("double").alias("label"))
        alone = LogisticRegression(maxIter=1000, regParam=1e-2, tol=1e-12, family="binomial").fit(train)
        head = model.heads[i]
        assert np.abs(alone.coefficients.toArray() - head.coefficients).max() < 1e-4
        assert abs(alone.intercept - head.intercept) < 1e-4


def test_two_thousand_labels_take_as_many_passes_as_few(spark, monkeypatch):
    passes = {}
    run = J._Problem.__call__

    def counted(self, points, active):
        passes[len(passes_for)] = passes.get(len(passes_for), 0) + 1
        return run(self, points, active)

    passes_for = []
    monkeypatch.setattr(J._Problem, "__call__", counted)
    few = labelled(spark, 300, 24, 5)
    many = few.withColumn("labels", F.flatten(F.array_repeat("labels", 400)))
    small = M.fit_multilabel(few, named(spark, 5), n_features=1 << 6, reg_param=1e-2)
    passes_for.append("many")
    large = M.fit_multilabel(many, named(spark, 2000), n_features=1 << 6, reg_param=1e-2)
    assert passes[1] <= 1.3 * passes[0] + 3
    assert len(large.heads) == 2000
    for i in (0, 7, 1999):
        assert np.abs(large.heads[i].coefficients - small.heads[i % 5].coefficients).max() < 1e-3
    row = large.transform(few.limit(3)).select("logits").first()[0]
    assert len(row) == 2000


def test_joint_fit_edges(spark):
    df = spark.createDataFrame(
        [("a b", [1.0, 0.0]), ("", [1.0, 0.0]), ("c", [1.0, 0.0])], "text string, labels array<float>"
    )
    model = M.fit_multilabel(df, named(spark, 2), n_features=1 << 5)
    assert all(isinstance(h, float) for h in model.heads)
    assert [len(r[0]) for r in M.score(df, model).select("logits").collect()] == [2, 2, 2]
    one = df.withColumn("labels", F.array(F.when(F.col("text") == "c", 1.0).otherwise(0.0).cast("float")))
    single = M.fit_multilabel(one, named(spark, 1), n_features=1 << 5)
    scores = {r["text"]: r["logits"] for r in M.score(one, single).collect()}
    assert len(scores["c"]) == 1 and scores["c"][0] > max(scores["a b"][0], scores[""][0])
    with pytest.raises(ValueError, match="lower n_features"):
        J.fit_joint(None, 1 << 14, 1 << 14, 1e-3, 10)


def brute_grams(texts, n, top):
    counts, first = Counter(), {}
    for i, text in enumerate(texts):
        words = text.split()
        for p in range(len(words) - n + 1):
            gram = " ".join(words[p : p + n])
            counts[gram] += 1
            first.setdefault(gram, (i, p))
    order = sorted(counts, key=lambda g: (-counts[g], first[g]))[:top]
    return [(rank, g, counts[g]) for rank, g in enumerate(order, 1)]


@pytest.mark.parametrize("buckets, first", [(1 << 16, 16), (64, 1), (128, 2)])
def test_leading_ngrams_are_exact(spark, monkeypatch, buckets, first):
    """Also with so few buckets that many must be counted again."""
    monkeypatch.setattr(N, "BUCKETS", buckets)
    monkeypatch.setattr(N, "FIRST", first)
    rng = random.Random(buckets)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 40))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    bags = N.token_bags(df, "id", remove_stopwords=False)
    got = N.leading_ngrams(bags, (2, 3), 12)
    for n in (2, 3):
        rows = got.filter(F.col("size") == n).select("rank", "term", "n").collect()
        assert sorted(map(tuple, rows)) == brute_grams(texts, n, 12)
    few = N.leading_ngrams(bags.limit(0), (2,), 5)
    assert few.count() == 0
    all_ = N.leading_ngrams(bags, (2,), 1000).select("rank", "term", "n").collect()
    assert sorted(map(tuple, all_)) == brute_grams(texts, 2, 1000)
    with pytest.raises(ValueError):
        N.leading_ngrams(bags, (1,))


def test_profile_in_one_scan_equals_separate_analyses(spark):
    rows = [(3, "The cat sat", "x"), (1, "a cat's tail, the cat", "y"), (2, "", "x"), (9, "Ünïque wörds", None),
            (5, None, "x"), (7, "the the the", "")]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    report = run_profile(df, "id", clean=False)
    assert {r["column"]: r["n_missing"] for r in report["missing_values"].collect()} == {
        "id": 0, "text": 1, "label": 1,
    }
    assert {r["n_rows"] for r in report["shape"].collect()} == {6}
    lengths = P.length_counts(df.fillna("", ["text"]))
    want = sorted(map(tuple, P.describe_length(lengths).collect()))
    assert sorted(map(tuple, report["length_stats"].collect())) == want
    terms = P.without_stopwords(P.term_counts(df, "id"))
    want = [tuple(r) for r in P.top_terms(terms).orderBy("rank").collect()]
    assert [tuple(r) for r in report["most_common_words"].orderBy("rank").collect()] == want
    long = report_rows(report)
    assert long.columns == ["analysis", "key", "figure", "value"]
    assert long.select("analysis").distinct().count() == len(report) == 18


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [") + plan.count("LogicalRDD")


def test_drift_reads_one_frame_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = [("a", "x", "one two"), ("a", "y", "two three"), ("b", "x", "two"), ("b", "z", "four four")]
    spark.createDataFrame(rows, "side string, label string, text string").write.parquet(path)
    df = spark.read.parquet(path)
    terms = D.term_sides(df, words=())
    assert scans(terms) == 1 and scans(D.imbalance_drift_of(df)) == 1
    assert D.vocab_drift_of(terms).first().asDict() == {
        "vocab_a": 3, "vocab_b": 2, "n_shared": 1, "n_only_a": 2, "n_only_b": 1,
    }
    lengths = P.length_counts(df, label_col="side").withColumnRenamed("label", "side")
    drift = D.length_drift_of(lengths)
    assert scans(drift) == 1 or "Window" not in drift._jdf.queryExecution().optimizedPlan().toString()
    sums = {(r["measure"], r["statistic"]): (r["value_a"], r["value_b"]) for r in drift.collect()}
    assert sums["word", "max"] == (2.0, 2.0) and sums["char", "min"] == (7.0, 3.0)
    shares = {r["label"]: (r["share_a"], r["share_b"], r["status"]) for r in D.label_drift_of(df).collect()}
    assert shares == {"x": (0.5, 0.5, "shared"), "y": (0.5, 0.0, "missing"), "z": (0.0, 0.5, "new")}
    assert "Window" not in D.label_drift_of(df)._jdf.queryExecution().optimizedPlan().toString()


def test_dictionary_of_five_million_labels(spark):
    n = 5_000_000
    df = spark.range(n).select(F.concat(F.lit("l"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("label"))
    label_map = L.build_label_map(df)
    wrong = label_map.filter(F.substring("label", 2, 8).cast("int") != F.col("label_id"))
    assert label_map.count() == n and wrong.count() == 0
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "l00000042").otherwise(
            F.concat(F.lit("l"), F.lpad((F.col("id") * 499).cast("string"), 8, "0"))
        ).alias("label"),
        "id",
    )
    encoded = L.encode_multiclass(rows, label_map)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and "strategy=broadcast" not in plan.replace("copies", "", 0).split("_key")[-1]
    assert encoded.filter(F.col("label") == "l00000042").count() == 10_000
    assert encoded.filter(F.substring("label", 2, 8).cast("int") != F.col("labels")).count() == 0


def test_small_dictionaries_are_broadcast_and_names_may_hold_dots(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "`my.label` string, n int")
    label_map = L.build_label_map(rows, "my.label")
    assert sorted(map(tuple, label_map.collect())) == [("a", 0), ("b", 1)]
    encoded = L.encode_multiclass(rows, label_map, "my.label")
    assert encoded.columns == ["my.label", "n", "labels"]
    assert sorted(map(tuple, encoded.collect())) == [("a", 2, 0), ("b", 1, 1)]
    left = dictionary_join(rows, label_map, "my.label", "left", limit=0)
    assert sorted(map(str, left.collect())) == sorted(
        map(str, dictionary_join(rows, label_map, "my.label", "left").collect())
    )
    assert L.unpack_labels(rows, "my.label").count() == 3


def test_texts_are_grouped_by_content(spark):
    df = spark.createDataFrame(
        [("t", "a"), ("t", "b"), ("t", "a"), ("u", None), (None, "a"), ("", "b")], "text string, label string"
    )
    label_map = L.build_label_map(df)
    encoded = L.encode_with_content(df, label_map)
    keys = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_content" in keys and "Aggregate [text" not in keys
    got = {r["text"]: list(r["labels"]) for r in encoded.collect()}
    assert got == {"t": [1.0, 1.0], "u": [0.0, 0.0], "": [0.0, 1.0]}
    config = CorpusConfig("x", task=MULTILABEL, unpack=True, validation_ratio=0)
    prepared = prepare(df, config, label_map.filter("label = 'a'"))
    assert [tuple(r) for r in prepared.unseen.collect()] == [("b", 2)]
    assert prepared.train.columns == ["text", "labels"]


def test_publication_is_whole_or_not_seen(spark, tmp_path):
    from utterfold.sources import publish as Pub

    root = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        Pub.current(spark, root)

    def write(value, fails=False):
        def fill(folder):
            spark.range(1).select(F.lit(value).alias("v")).write.parquet(f"{folder}/part")
            if fails:
                raise RuntimeError("killed half way")

        return fill

    Pub.publish(spark, root, write(1))
    with pytest.raises(RuntimeError):
        Pub.publish(spark, root, write(2, fails=True))
    assert spark.read.parquet(f"{Pub.current(spark, root)}/part").first()["v"] == 1
    Pub.publish(spark, root, write(3))
    assert spark.read.parquet(f"{Pub.current(spark, root)}/part").first()["v"] == 3
    assert Pub.versions(spark, root).count() == 2


def test_training_run_and_scoring_of_files(spark, tmp_path):
    from utterfold.plans.score_file import score_file
    from utterfold.plans.training_run import load_run, train_from_files
    from utterfold.sources.files import read_scoring_input
    from utterfold.sources.publish import current

    topics = {"air": "plane wing", "sea": "ship sail"}
    lines = [f"{words} n{i}\t{'+'.join(sorted(set(names)))}" for i in range(60)
             for names in [list(topics)[: 1 + i % 2] if i % 3 else ["sea"]]
             for words in [" ".join(topics[n] for n in names)]]
    (tmp_path / "train.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "test.tsv").write_text("ship sail\tsea\nplane wing\tair+moon\n")
    (tmp_path / "in.csv").write_text('id,text\n1,"Ship\nsail"\n2,\n3,plane wing\n')
    common = {"columns": ["text", "label"], "task": MULTILABEL, "unpack": True}
    root = str(tmp_path / "run")
    model, metrics, unseen = train_from_files(
        spark, CorpusConfig(str(tmp_path / "train.tsv"), **common), "r1", root,
        CorpusConfig(str(tmp_path / "test.tsv"), validation_ratio=0, **common),
        n_features=1 << 8,
    )
    assert [tuple(r) for r in unseen.collect()] == [("moon", 1)]
    assert {r["split"] for r in metrics.select("split").distinct().collect()} == {"eval", "test"}
    again, label_map, stored = load_run(spark, root)
    assert list(again.labels) == ["air", "sea"] and label_map.count() == 2
    assert stored.count() == metrics.count()
    out = str(tmp_path / "predictions")
    found = score_file(spark, str(tmp_path / "in.csv"), again, out)
    got = {r["id"]: list(r["predicted_labels"]) for r in found.collect()}
    assert got["1"] == ["sea"] and got["3"] == ["air"] and set(got) == {"1", "2", "3"}
    written = read_scoring_input(spark, current(spark, out))
    assert {r["text"] for r in written.collect()} == {"Ship\nsail", "", "plane wing"}
    with pytest.raises(ValueError, match="task and labels"):
        score_file(spark, str(tmp_path / "in.csv"), lambda: None)


def test_loss_has_one_definition(spark):
    from utterfold.config import MULTICLASS
    from utterfold.operators import metrics as Me

    df = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.5, 2.0]), (None, [0.0, 1.0])], "labels int, logits array<double>"
    )
    one = Me.cross_entropy_loss(df, "labels", "logits").first()["value"]
    every = Me.compute_metrics(df, MULTICLASS).filter("metric = 'loss'").first()["value"]
    assert abs(one - every) < 1e-12
    bad = df.withColumn("labels", F.lit(2))
    for run in (lambda: Me.cross_entropy_loss(bad, "labels", "logits"), lambda: Me.compute_metrics(bad, MULTICLASS)):
        with pytest.raises(Exception, match="outside the logits"):
            run().collect()


def test_a_hundred_thousand_stopwords(spark, monkeypatch):
    texts = [f"the w{i % 700} w{i % 13} of{i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    words = [f"w{i}" for i in range(100_000)] + ["the"]
    frame = spark.createDataFrame([(w,) for w in words[:300] + ["the", "the"]], "word string")
    long = P.term_counts(df, "id", words=words)
    monkeypatch.setattr(P, "MAX_LITERAL_WORDS", 1 << 20)
    literal = P.term_counts(df, "id", words=words)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, literal.collect()))
    assert P.without_stopwords(long).filter("term RLIKE '^(w|the)'").count() == 0
    want = P.corpus_tokens(df, "id", words=words[:300] + ["the"]).collect()
    assert sorted(map(tuple, P.corpus_tokens(df, "id", words=frame).collect())) == sorted(map(tuple, want))
    monkeypatch.setattr(P, "MAX_LITERAL_WORDS", 10)
    assert sorted(map(tuple, P.corpus_tokens(df, "id", words=words[:300] + ["the"]).collect())) == sorted(
        map(tuple, want)
    )


def test_logits_that_are_no_numbers_are_answered_as_errors(spark):
    from utterfold.config import MULTICLASS
    from utterfold.operators.scoring import answer_requests, names_array

    rows = [("a", "x", [1.0, 2.0]), ("b", "x", [float("nan"), 1.0]), ("c", "x", None), ("d", " ", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "request_id string, text string, logits array<double>")
    got = {r["request_id"]: (r["error"] or {"label": None})["label"]
           for r in answer_requests(df, MULTICLASS, names_array(["p", "q"])).collect()}
    assert got == {"a": None, "b": "INTERNAL_ERROR", "c": "INTERNAL_ERROR", "d": "TEXT_EMPTY"}
