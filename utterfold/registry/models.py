"""Fitted models and streamed requests. Fits have no SQL; the letter scorer has."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..config import MULTICLASS, MULTILABEL, CorpusConfig
from ..functions.vectors import sigmoid, softmax
from ..operators import labels as L
from ..operators.model import (
    REG_PARAM,
    featurize,
    fit_multiclass,
    fit_multilabel,
    load_model,
    save_model,
    score,
    term_weights,
    with_tokens,
)
from ..plans.prepare import prepare
from ..plans.train_evaluate import train_and_evaluate
from ..session import cut_lineage, scratch_path
from ..streaming.scoring import score_stream, score_stream_with, write_answers
from .base import CORPUS, REQUESTS, corpus, documents, query, r6, requests, table
from .base import sql_clean_basic, sql_clean_punct, sql_tokens
from .scores import LETTER_SQL, LETTERS, LetterScorer


def _language_rows(spark, folder):
    return documents(spark, folder).select("doc_id", "text", F.col("lang").alias("label"))


def _parts(spark, folder):
    return L.unpack_labels(corpus(spark, folder, documents(spark, folder)))


def _language_model(spark, folder):
    rows = _language_rows(spark, folder)
    label_map = L.build_label_map(rows)
    return fit_multiclass(L.encode_multiclass(rows, label_map), label_map)


@query(
    "featurize",
    f"""WITH {CORPUS}, cleaned AS (
      SELECT doc_id, {sql_clean_punct(sql_clean_basic("text"))} AS text FROM corpus),
    words AS (SELECT doc_id, unnest(({sql_tokens("text")})[1:128]) AS term FROM cleaned),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    total AS (SELECT count(*) AS n FROM documents)
    SELECT doc_id, term, tf, round(tf * ln((n + 1) / (df + 1)), 6) + 0.0 AS weight
    FROM tf JOIN df USING (term), total""",
)
def features(spark, folder):
    """Every term of every document with its weight."""
    rows = _language_rows(spark, folder).select("doc_id", "text")
    return term_weights(rows).withColumn("weight", r6("weight"))


_WORD_TABLES = f"""{CORPUS}, cleaned AS (
      SELECT doc_id, {sql_clean_punct(sql_clean_basic("text"))} AS text FROM corpus),
    words AS (SELECT doc_id, unnest(({sql_tokens("text")})[1:128]) AS term FROM cleaned),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    total AS (SELECT count(*) AS n FROM documents)"""


@query(
    "featurize_counts",
    f"""WITH {_WORD_TABLES}
    SELECT d.doc_id, count(term) AS n_terms,
           round(coalesce(sum(tf * ln((n + 1) / (df + 1))), 0), 6) + 0.0 AS weight
    FROM documents d LEFT JOIN (tf JOIN df USING (term)) USING (doc_id), total GROUP BY d.doc_id""",
)
def features_of_counts(spark, folder):
    """Terms and total weight of each document in the feature vectors of a fit."""
    rows = _language_rows(spark, folder).select("doc_id", "text")
    features, _ = featurize(rows, vectorizer="count", n_features=1 << 20)
    plain = F.unwrap_udt("features")
    # the stored values are a document's terms; as a dense array it is as long as the vocabulary
    weight = F.aggregate(plain["values"], F.lit(0.0), lambda s, x: s + x)
    return features.select(
        "doc_id",
        # a term that every document holds weighs nothing and is stored all the same
        F.size(plain["values"]).cast("bigint").alias("n_terms"),
        r6(weight).alias("weight"),
    )


@query(
    "featurize_hash",
    f"""WITH {_WORD_TABLES} SELECT d.doc_id, coalesce(sum(tf), 0)::BIGINT AS n_tokens
    FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY d.doc_id""",
)
def features_of_hashes(spark, folder):
    """Hashed features keep every token, whichever bin it falls into."""
    rows = _language_rows(spark, folder).select("doc_id", "text")
    _, fitted = featurize(rows)
    counted = fitted.stages[0].transform(with_tokens(rows))
    total = F.aggregate(F.unwrap_udt("tf")["values"], F.lit(0.0), lambda s, x: s + x)
    return counted.select("doc_id", total.cast("bigint").alias("n_tokens"))


def _settled(rows, model, probabilities, label_map):
    """``label, settled``: whether the score equations of the label's regression hold.

    At the optimum the mean of (p - y) x plus the slope of the penalty is zero for every
    feature. It may be off by a hundredth of what a model without features leaves, so one
    that has only an intercept does not pass. ``rows`` has ``labels``, multi-hot.
    """
    # written once: four passes follow, and none of them cleans text again
    scored = with_tokens(cut_lineage(model.transform(rows)))
    found = cut_lineage(
        model.features.transform(scored).select(
            probabilities.alias("p"), "labels", F.unwrap_udt("features").alias("f")
        )
    )
    n = found.count()
    per_bin = found.select(
        "p",
        "labels",
        F.inline(F.arrays_zip(F.col("f.indices").alias("bin"), F.col("f.values").alias("x"))),
    )
    spread = per_bin.groupBy("bin").agg(
        ((F.sum(F.col("x") ** 2) - F.sum("x") ** 2 / n) / (n - 1)).alias("variance")
    )
    means = found.select(F.posexplode("labels").alias("label_id", "y")).groupBy("label_id").agg(
        F.avg("y").alias("share")
    )
    sums = (
        per_bin.select(
            "bin",
            "x",
            F.inline(
                F.zip_with(
                    F.transform("p", lambda p, i: F.struct(i.alias("label_id"), p.alias("p"))),
                    "labels",
                    lambda a, y: F.struct(a["label_id"].alias("label_id"), a["p"].alias("p"), y.alias("y")),
                )
            ),
        )
        .groupBy("label_id", "bin")
        .agg(
            F.sum(F.col("x") * (F.col("p") - F.col("y"))).alias("left"),
            F.sum(F.col("x") * F.col("y")).alias("xy"),
            F.sum("x").alias("x"),
        )
    )
    matrix = model.regression.coefficientMatrix.toArray()[: len(model.labels)]
    at = np.nonzero(matrix)
    weights = rows.sparkSession.createDataFrame(
        pd.DataFrame({"label_id": at[0].astype("int32"), "bin": at[1].astype("int32"), "w": matrix[at]})
    )
    joined = (
        sums.join(spread, "bin")
        .join(means, "label_id")
        .join(weights, ["label_id", "bin"], "left")
        .withColumn("w", F.coalesce("w", F.lit(0.0)))
    )
    off = F.abs(F.col("left") / n + REG_PARAM * F.col("variance") * F.col("w"))
    without = F.abs((F.col("x") * F.col("share") - F.col("xy")) / n)
    worst = joined.groupBy("label_id").agg(
        (F.max(off) <= 0.01 * F.max(without)).alias("settled")
    )
    return worst.join(label_map, "label_id").select("label", "settled")


def _mean_by_label(probabilities, label_map):
    """``label, share``: the mean probability of each label over all rows."""
    exploded = probabilities.select(F.posexplode("p").alias("label_id", "p"))
    means = exploded.groupBy("label_id").agg(F.round(F.avg("p"), 4).alias("share"))
    return means.join(label_map, "label_id").select("label", "share")


@query(
    "fit_multiclass",
    """SELECT lang AS label, round(count(*) / sum(count(*)) OVER (), 4) AS share, true AS settled
    FROM documents GROUP BY lang""",
)
def multiclass(spark, folder):
    """At the optimum the mean probability of a class is its share of the training rows,
    and the score equations of all features hold.
    """
    rows = _language_rows(spark, folder)
    label_map = L.build_label_map(rows)
    model = _language_model(spark, folder)
    encoded = L.encode_multiclass(rows, label_map)
    hot = F.transform(
        F.sequence(F.lit(0), F.lit(len(model.labels) - 1)),
        lambda i: (F.col("labels") == i).cast("double"),
    )
    settled = _settled(
        encoded.withColumn("labels", hot), model, softmax(F.col("logits")), label_map
    )
    logits = score(rows, model)
    shares = _mean_by_label(logits.select(softmax(F.col("logits")).alias("p")), label_map)
    return shares.join(settled, "label")


@query(
    "fit_multilabel",
    f"""WITH {CORPUS}, parts AS (
      SELECT text, unnest(string_split(label, '+')) AS label FROM corpus)
    SELECT label, round(count(DISTINCT text) / (SELECT count(DISTINCT text) FROM parts), 4) AS share,
           true AS settled
    FROM parts GROUP BY label""",
)
def multilabel(spark, folder):
    """As for one class per row, label by label."""
    rows = _parts(spark, folder)
    label_map = L.build_label_map(rows)
    encoded = cut_lineage(L.encode_multilabel(rows, label_map))
    model = fit_multilabel(encoded, label_map)
    settled = _settled(encoded, model, sigmoid(F.col("logits")), label_map)
    logits = score(encoded.select("text"), model)
    shares = _mean_by_label(logits.select(sigmoid(F.col("logits")).alias("p")), label_map)
    return shares.join(settled, "label")


def _same_answers(one, other):
    """``request_id, same`` for two sets of answers."""
    one = one.select("request_id", F.to_json(F.struct("intents", "error")).alias("one"))
    other = other.select("request_id", F.to_json(F.struct("intents", "error")).alias("other"))
    joined = one.join(other, "request_id", "full_outer")
    return joined.select("request_id", F.col("one").eqNullSafe(F.col("other")).alias("same"))


_ALL_SAME = f"WITH {REQUESTS} SELECT request_id, true AS same FROM requests"


@query("model_saved_and_loaded", _ALL_SAME)
def model_round_trip(spark, folder):
    """A loaded model answers every request as the fitted one did."""
    path = scratch_path(spark, "model")
    model = _language_model(spark, folder)
    save_model(model, spark, path)
    asked = requests(spark, folder)
    return _same_answers(score_stream(asked, model), score_stream(asked, load_model(spark, path)))


def _train(spark, folder, task, rows, row_id):
    config = CorpusConfig("unused", task=task, unpack=task == MULTILABEL)
    prepared = prepare(rows, config, row_id=row_id)
    _, metrics = train_and_evaluate(prepared, task, "run")
    return metrics.withColumn("value", r6("value"))


@query("train_and_evaluate_multiclass")
def train_multiclass(spark, folder):
    return _train(spark, folder, MULTICLASS, _language_rows(spark, folder), "doc_id")


@query("train_and_evaluate_multilabel")
def train_multilabel(spark, folder):
    return _train(spark, folder, MULTILABEL, _parts(spark, folder), None)


def request_stream(spark, folder):
    turns = table(spark, folder, "conversations")
    # one file or a folder of files; a pattern, for a plain path must be a folder
    path = f"{folder.rstrip('/')}/conversations[.]parquet"
    stream = spark.readStream.schema(turns.schema).parquet(path)
    return stream.filter(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), "text"
    )


def _drained(spark, answers):
    path = scratch_path(spark, "answers")
    write_answers(answers, path, scratch_path(spark, "progress"), True).awaitTermination()
    return spark.read.schema(answers.schema).json(path)


@query(
    "score_stream",
    f"""WITH {REQUESTS}
    SELECT request_id,
           CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN NULL
                ELSE (SELECT least(count(DISTINCT lang), 3) FROM documents) END AS n_intents,
           CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'TEXT_EMPTY'
                END AS error,
           true AS ordered
    FROM requests""",
)
def stream_model(spark, folder):
    """Per request the number of intents, the error, and whether they fall in confidence."""
    model = _language_model(spark, folder)
    answers = _drained(spark, score_stream(request_stream(spark, folder), model))
    confidences = F.col("intents.confidence")
    falling = F.coalesce(confidences == F.sort_array(confidences, asc=False), F.lit(True))
    return answers.select(
        "request_id",
        F.when(F.col("intents").isNotNull(), F.size("intents")).cast("bigint").alias("n_intents"),
        F.col("error.label").alias("error"),
        falling.alias("ordered"),
    )


@query("score_stream_equals_batch", _ALL_SAME)
def stream_equals_batch(spark, folder):
    """The streamed answers are the batch answers."""
    model = _language_model(spark, folder)
    streamed = _drained(spark, score_stream(request_stream(spark, folder), model))
    return _same_answers(streamed, score_stream(requests(spark, folder), model))


@query(
    "score_stream_with_user_scorer",
    f"""{LETTER_SQL}, p AS (
      SELECT request_id, c, x, exp(x) / sum(exp(x)) OVER (PARTITION BY request_id) AS p,
             row_number() OVER (PARTITION BY request_id ORDER BY x DESC, c) AS rank FROM long)
    SELECT request_id, rank, {list(LETTERS)}[c] AS label, round(p, 4) AS confidence
    FROM p WHERE rank <= 3""",
)
def stream_scorer(spark, folder):
    answers = score_stream_with(
        request_stream(spark, folder), LetterScorer, MULTICLASS, LETTERS, batch_size=64
    )
    exploded = _drained(spark, answers).select(
        "request_id", F.posexplode("intents").alias("at", "item")
    )
    return exploded.select(
        "request_id",
        (F.col("at") + 1).cast("bigint").alias("rank"),
        F.col("item.label").alias("label"),
        F.col("item.confidence").alias("confidence"),
    )
