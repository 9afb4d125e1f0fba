import math
import random

import pytest
from pyspark.sql import functions as F

from utterfold.config import MULTICLASS, MULTILABEL
from utterfold.functions import ranking as R
from utterfold.functions import vectors as V
from utterfold.operators import curves
from utterfold.operators import metrics as M
from utterfold.operators import scoring as S


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def multilabel(spark, rows):
    return spark.createDataFrame(rows, "labels array<float>, logits array<double>")


def hot(k, *on):
    return [1.0 if i in on else 0.0 for i in range(k)]


def logits(k, *on):
    return [5.0 if i in on else -5.0 for i in range(k)]


def published(n, tp, fp, fn, exact, k=17):
    """Rows with these totals: misses first, some with a wrong label, then wrong extras."""
    wrong = n - exact
    both = fp + fn - wrong
    rows = []
    for i in range(fn):
        rows.append((hot(k, 0), logits(k, *([1] if i < both else []))))
    for _ in range(fp - both):
        rows.append((hot(k, 0), logits(k, 0, 1)))
    left = tp - (fp - both)
    doubles = left - exact
    for i in range(exact):
        on = (2, 3) if i < doubles else (2 + i % 15,)
        rows.append((hot(k, *on), logits(k, *on)))
    return rows


# Published figures of two evaluations.
@pytest.mark.parametrize(
    ("counts", "f1", "hamming", "subset", "precision", "recall", "jaccard"),
    [
        ((850, 839, 17, 24, 818), 0.9761489237929029, 0.002837370242214533, 0.9623529411764706,
         0.9801401869158879, 0.9721900347624566, 0.9534090909090909),
        ((927, 916, 10, 17, 910), 0.9854760623991393, 0.0017133066818960593, 0.9816612729234089,
         0.9892008639308856, 0.9817792068595927, 0.9713679745493107),
    ],
)
def test_published_counts(spark, counts, f1, hamming, subset, precision, recall, jaccard):
    got = values(M.compute_metrics(multilabel(spark, published(*counts)), MULTILABEL))
    assert got["f1"] == got["f1_micro"] == f1
    assert got["hamming_loss"] == hamming
    assert got["subset_accuracy"] == subset
    assert got["precision_micro"] == precision
    assert got["recall_micro"] == recall
    assert got["jaccard_micro"] == jaccard


def brute_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(pairs):
    total, area, last = sum(y for _, y in pairs), 0.0, 0.0
    for cut in sorted({s for s, _ in pairs}, reverse=True):
        taken = [y for s, y in pairs if s >= cut]
        recall = sum(taken) / total
        area += (recall - last) * sum(taken) / len(taken)
        last = recall
    return area


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 7, 1])
def test_curves_against_brute_force(spark, rows_per_bucket):
    rng = random.Random(5)
    k = 4
    rows = [
        ([float(rng.random() < 0.3) for _ in range(k)], [round(rng.random(), 1) for _ in range(k)])
        for _ in range(120)
    ]
    df = spark.createDataFrame(rows, "t array<float>, s array<double>")
    counts = curves.score_counts(df, "t", "s").persist()
    got = {r["label_id"]: r for r in curves.ranking_curves(counts, True, rows_per_bucket).collect()}
    for c in range(k):
        pairs = [(s[c], t[c]) for t, s in rows]
        assert got[c]["auc"] == pytest.approx(brute_auc(pairs))
        assert got[c]["ap"] == pytest.approx(brute_ap(pairs))
    pooled = [(s[c], t[c]) for t, s in rows for c in range(k)]
    assert got[curves.POOLED]["auc"] == pytest.approx(brute_auc(pooled))
    assert got[curves.POOLED]["ap"] == pytest.approx(brute_ap(pooled))
    counts.unpersist()


def test_reversed_scores_mirror_the_area(spark):
    rng = random.Random(1)
    rows = [([float(rng.random() < 0.5)], [rng.random()]) for _ in range(50)]
    df = spark.createDataFrame(rows, "t array<float>, s array<double>")
    turned = df.withColumn("s", F.transform("s", lambda x: -x))
    a, b = (curves.ranking_curves(curves.score_counts(d, "t", "s")).first()["auc"] for d in (df, turned))
    assert a + b == pytest.approx(1.0)


def test_label_without_positives(spark):
    rows = [(hot(2, 0), [1.0, -1.0]), (hot(2), [-2.0, -3.0]), (hot(2, 0), [0.5, -2.0])]
    got = values(M.compute_metrics(multilabel(spark, rows), MULTILABEL))
    for name in M.ROC_METRICS:
        assert math.isnan(got[name])
    assert math.isnan(got["avg_precision_macro"])
    assert got["avg_precision_weighted"] == 1.0
    assert got["avg_precision"] == got["avg_precision_micro"] == 1.0
    assert got["f1_macro"] == 0.5


def test_empty_truth_and_prediction(spark):
    rows = [(hot(2), logits(2)), (hot(2, 0), logits(2, 0))]
    got = values(M.sample_metrics(
        multilabel(spark, rows).withColumn("p", V.binarize(V.sigmoid(F.col("logits")))), "labels", "p"
    ))
    assert got["subset_accuracy"] == 1.0
    assert got["f1_samples"] == got["jaccard_samples"] == got["precision_samples"] == 0.5


def test_multiclass_micro_equals_accuracy(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), [rng.random() for _ in range(4)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "labels int, logits array<double>")
    got = values(M.compute_metrics(df, MULTICLASS))
    assert got["accuracy"] == got["f1_micro"] == got["precision_micro"] == got["recall_micro"]
    assert got["recall_weighted"] == pytest.approx(got["accuracy"])
    assert got["f1"] == got["f1_weighted"]
    # parts computed alone equal the whole
    alone = df.withColumn("p", V.argmax(F.col("logits")))
    for fn in (M.accuracy, M.balanced_accuracy, M.cohen_kappa, M.matthews_corrcoef):
        for name, value in values(fn(alone, "labels", "p")).items():
            assert value == pytest.approx(got[name])
    assert values(M.cross_entropy_loss(df, "labels", "logits"))["loss"] == pytest.approx(got["loss"])


def test_multiclass_edge_cases(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (0, [3.0, 1.0, 2.0])]
    got = values(M.compute_metrics(spark.createDataFrame(rows, "labels int, logits array<double>"), MULTICLASS))
    assert got["accuracy"] == 1.0
    assert math.isnan(got["cohen_kappa"])
    assert got["matthews_corrcoef"] == 0.0
    assert math.isnan(got["roc_auc_ovr"])


def test_predicted_class_outside_truth_counts_in_macro(spark):
    rows = [(0, 0), (0, 1), (2, 2)]
    got = values(M.precision_recall_f1(spark.createDataFrame(rows, "t int, p int"), "t", "p"))
    assert got["precision_macro"] == pytest.approx((1 + 0 + 1) / 3)
    assert got["recall_macro"] == pytest.approx((0.5 + 0 + 1) / 3)


def test_unknown_task(spark):
    with pytest.raises(ValueError, match="unknown task"):
        M.compute_metrics(spark.range(1), "regression")


def one(spark, column, row, schema):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def test_softmax_is_stable(spark):
    got = one(spark, V.softmax(F.col("x")), ([1000.0, 1000.0],), "x array<double>")
    assert got == [0.5, 0.5]
    loss = one(spark, V.cross_entropy(F.col("x"), F.col("y")), ([1000.0, 0.0], 1), "x array<double>, y int")
    assert loss == 1000.0


def test_threshold_is_strict_and_first_maximum_wins(spark):
    x = ([0.0, 1e-9, -1.0],)
    assert one(spark, V.binarize(V.sigmoid(F.col("x"))), x, "x array<double>") == [0, 1, 0]
    assert one(spark, V.argmax(F.col("x")), ([1.0, 3.0, 3.0],), "x array<double>") == 1


def test_multi_hot(spark):
    row, schema = ([3, 0, 9], 4), "ids array<int>, k int"
    assert one(spark, V.multi_hot(F.col("ids"), F.col("k")), row, schema) == [1.0, 0.0, 0.0, 1.0]
    assert one(spark, V.multi_hot(F.col("ids"), F.lit(0)), row, schema) == []


def test_ranking(spark):
    names = S.names_array(["a", "b"])
    ranked = one(spark, R.ranked(F.col("x"), names), ([0.5, 0.9, 0.5],), "x array<double>")
    assert [(r.label, r.confidence) for r in ranked] == [("b", 0.9), ("a", 0.5), ("UNKNOWN_2", 0.5)]
    top = one(spark, R.top_k(R.ranked(F.col("x"), names), 2), ([0.12345, 0.00005],), "x array<double>")
    assert [(r.label, r.confidence) for r in top] == [("a", 0.1235), ("b", 0.0001)]


def test_predict_table(spark):
    df = multilabel(spark, [(hot(3, 0), [0.0, 2.0, 1.0])]).withColumnRenamed("labels", "kept")
    names = S.names_array(["a", "b", "c"])
    got = S.predict_table(df, MULTILABEL, names, include_probabilities=True)
    assert got.columns == ["kept", "predicted_labels", "predicted_scores"]
    row = got.first()
    assert row["predicted_labels"] == ["b", "c"]
    assert set(row["predicted_scores"]) == {"b", "c"}
    assert S.predict_table(df, MULTILABEL, names, threshold=0.8).first()["predicted_labels"] == ["b"]
    single = S.predict_table(df, MULTICLASS, names)
    assert single.columns == ["kept", "predicted_label"]
    assert single.first()["predicted_label"] == "b"
