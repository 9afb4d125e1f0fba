import random

import pytest
from pyspark.sql import functions as F

from utterfold.config import MULTICLASS, MULTILABEL, CorpusConfig
from utterfold.functions.vectors import argmax
from utterfold.operators import labels as L
from utterfold.operators import model as M
from utterfold.plans.prepare import prepare
from utterfold.plans.train_evaluate import train_and_evaluate
from utterfold.sources.sinks import load_metrics

TOPICS = {"air": "plane wing flight", "sea": "ship sail wave", "rail": "train track coach"}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        labels = sorted(rng.sample(list(TOPICS), rng.choice([1, 1, 2])))
        words = [w for name in labels for w in rng.choices(TOPICS[name].split(), k=4)]
        rows.append((i, f"{' '.join(words)} n{i}", "+".join(labels)))
    return spark.createDataFrame(rows, "id bigint, text string, label string")


@pytest.mark.parametrize("vectorizer", ["count", "hash"])
def test_multiclass(spark, corpus, vectorizer):
    single = corpus.filter(~F.contains("label", F.lit("+")))
    label_map = L.build_label_map(single)
    encoded = L.encode_multiclass(single, label_map)
    model = M.fit_multiclass(encoded, label_map, vectorizer=vectorizer, n_features=1 << 10)
    scored = M.score(encoded, model).withColumn("pred", argmax(F.col("logits")))
    assert scored.filter("pred != labels").count() == 0
    assert scored.filter(F.size("logits") != 3).count() == 0
    assert set(scored.columns) == {*encoded.columns, "logits", "pred"}


def test_class_missing_from_training_still_gets_a_logit(spark, corpus):
    single = corpus.filter(~F.contains("label", F.lit("+")))
    label_map = L.build_label_map(single)
    encoded = L.encode_multiclass(single, label_map).filter("label != 'sea'")
    model = M.fit_multiclass(encoded, label_map, max_iter=10)
    row = M.score(encoded, model).select("logits").first()[0]
    assert len(row) == 3 and all(abs(x) < 1e6 for x in row)


def test_multilabel_with_constant_labels(spark, corpus, tmp_path):
    rows = L.unpack_labels(corpus)
    label_map = spark.createDataFrame(
        [("air", 0), ("never", 1), ("rail", 2), ("sea", 3)], "label string, label_id int"
    )
    encoded = L.encode_multilabel(rows, label_map)
    model = M.fit_multilabel(encoded, label_map, max_iter=30, n_features=1 << 10)
    assert [isinstance(h, float) for h in model.heads] == [False, True, False, False]
    assert model.heads[1] < -4
    scored = M.score(encoded, model)
    wrong = F.exists(F.zip_with("labels", "logits", lambda y, x: (y > 0) != (x > 0)), lambda b: b)
    assert scored.filter(wrong).count() == 0
    M.save_model(model, spark, str(tmp_path))
    loaded = M.load_model(spark, str(tmp_path))
    assert (loaded.task, list(loaded.labels)) == (MULTILABEL, ["air", "never", "rail", "sea"])
    both = M.score(scored.withColumnRenamed("logits", "before"), loaded)
    assert both.filter(F.col("before") != F.col("logits")).count() == 0


def test_label_ids_must_be_dense(spark, corpus):
    label_map = spark.createDataFrame([("air", 0), ("sea", 2)], "label string, label_id int")
    with pytest.raises(ValueError, match="without gaps"):
        M.fit_multiclass(corpus.withColumn("labels", F.lit(0)), label_map)


def test_featurize_drops_the_text(corpus):
    features, fitted = M.featurize(corpus, n_features=1 << 8)
    assert features.columns == ["id", "label", "features"]
    again, _ = M.featurize(corpus, pipeline=fitted)
    assert again.columns == features.columns
    with pytest.raises(ValueError):
        M.feature_pipeline("other")


def test_train_and_evaluate(spark, corpus, tmp_path):
    config = CorpusConfig("x.tsv", task=MULTILABEL, unpack=True)
    rows = L.unpack_labels(corpus)
    prepared = prepare(rows, config)
    assert prepared.train.count() == 120 and prepared.validation.count() == 30
    test = prepare(rows, CorpusConfig("x.tsv", task=MULTILABEL, unpack=True, validation_ratio=0),
                   prepared.label_map).train
    path = str(tmp_path / "metrics")
    model, metrics = train_and_evaluate(prepared, MULTILABEL, "run", path, test, max_iter=20)
    values = {(r["split"], r["metric"]): r["value"] for r in metrics.collect()}
    assert values["eval", "f1"] > 0.95 and values["test", "subset_accuracy"] > 0.95
    assert load_metrics(spark, path).count() == len(values)
    with pytest.raises(ValueError, match="row_id"):
        prepare(corpus, CorpusConfig("x.tsv", task=MULTICLASS))
