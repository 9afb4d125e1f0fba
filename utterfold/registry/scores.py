"""Score arithmetic, ranking, prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import MULTICLASS, MULTILABEL
from ..functions import vectors as V
from ..operators import scoring as S
from .base import LOGITS, MULTILABEL as ML, REQUESTS, SOFTMAX, query, r6, requests, scored
from .base import scored_multilabel

_NAMES = [f"intent_{i}" for i in range(9)]  # one label short: the last is unknown
_NAME = "CASE WHEN c < 9 THEN 'intent_' || c ELSE 'UNKNOWN_' || c END"


def _long(df, col):
    exploded = df.select("vec_id", F.posexplode(col).alias("c", "value"))
    return exploded.select("vec_id", F.col("c").cast("bigint").alias("c"), r6("value").alias("value"))


@query(
    "softmax",
    f"WITH {SOFTMAX} SELECT vec_id, c::BIGINT AS c, round(p, 6) AS value FROM soft",
)
def softmax(spark, folder):
    return _long(scored(spark, folder), V.softmax(F.col("logits")))


@query(
    "sigmoid",
    f"""WITH {LOGITS}
    SELECT vec_id, c::BIGINT AS c, round(1 / (1 + exp(-x)), 6) AS value FROM logit""",
)
def sigmoid(spark, folder):
    return _long(scored(spark, folder), V.sigmoid(F.col("logits")))


@query("argmax", f"WITH {SOFTMAX} SELECT vec_id, pred::BIGINT AS pred FROM pred")
def argmax(spark, folder):
    return scored(spark, folder).select(
        "vec_id", V.argmax(F.col("logits")).cast("bigint").alias("pred")
    )


@query(
    "binarize",
    f"WITH {ML} SELECT vec_id, c::BIGINT AS c, p::DOUBLE AS value FROM mlp",
)
def binarize(spark, folder):
    rows = scored_multilabel(spark, folder)
    return _long(rows, V.binarize(V.sigmoid(F.col("logits"))))


def _ranked_rows(df):
    # outer: no inferred filter on the size, which would rank every row twice
    exploded = df.select("vec_id", F.posexplode_outer("intents").alias("at", "item"))
    return exploded.select(
        "vec_id",
        (F.col("at") + 1).cast("bigint").alias("rank"),
        F.col("item.label").alias("label"),
        F.col("item.confidence").alias("confidence"),
    )


@query(
    "rank_predictions",
    f"""WITH {SOFTMAX}
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, c) AS rank,
           {_NAME} AS label, round(p, 6) AS confidence FROM soft""",
)
def rank_predictions(spark, folder):
    ranked = S.rank_predictions(scored(spark, folder), MULTICLASS, S.names_array(_NAMES))
    return _ranked_rows(ranked).withColumn("confidence", r6("confidence"))


@query(
    "rank_predictions_multilabel",
    f"""WITH {ML}
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, c) AS rank,
           {_NAME} AS label, round(s, 6) AS confidence FROM mls""",
)
def rank_predictions_multilabel(spark, folder):
    rows = scored_multilabel(spark, folder)
    ranked = S.rank_predictions(rows, MULTILABEL, S.names_array(_NAMES))
    return _ranked_rows(ranked).withColumn("confidence", r6("confidence"))


@query(
    "top_three",
    f"""WITH {SOFTMAX}, r AS (
      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, c) AS rank FROM soft)
    SELECT vec_id, rank, {_NAME} AS label, round(p, 4) AS confidence FROM r WHERE rank <= 3""",
)
def top_three(spark, folder):
    ranked = S.rank_predictions(scored(spark, folder), MULTICLASS, S.names_array(_NAMES))
    return _ranked_rows(S.top_k(ranked))


@query(
    "predict_table_multiclass",
    f"""WITH {SOFTMAX}
    SELECT vec_id, truth::BIGINT AS truth, {_NAME} AS predicted_label,
           round(p, 6) AS predicted_score
    FROM soft JOIN pred USING (vec_id, truth) WHERE c = pred""",
)
def predict_multiclass(spark, folder):
    predicted = S.predict_table(
        scored(spark, folder).drop("v"),
        MULTICLASS,
        S.names_array(_NAMES),
        include_probabilities=True,
    )
    return predicted.select(
        "vec_id",
        F.col("truth").cast("bigint").alias("truth"),
        "predicted_label",
        r6("predicted_score").alias("predicted_score"),
    )


@query(
    "predict_table_multilabel",
    f"""WITH {ML}, named AS (SELECT *, {_NAME} AS name FROM mlp)
    SELECT vec_id,
           coalesce(string_agg(name, ',' ORDER BY c) FILTER (p = 1), '') AS predicted_labels,
           round(coalesce(sum(s) FILTER (p = 1), 0), 6) AS total_score
    FROM named GROUP BY vec_id""",
)
def predict_multilabel(spark, folder):
    predicted = S.predict_table(
        scored_multilabel(spark, folder).drop("truth"),
        MULTILABEL,
        S.names_array(_NAMES),
        include_probabilities=True,
    )
    return predicted.select(
        "vec_id",
        F.array_join("predicted_labels", ",").alias("predicted_labels"),
        r6(V.array_sum(F.map_values("predicted_scores"))).alias("total_score"),
    )


# --- a user scorer ----------------------------------------------------------------

LETTERS = ("a", "e", "i", "o", "u")


class LetterScorer:
    """Logits by how often each vowel occurs: a scorer with known answers."""

    def __call__(self, texts):
        return [[10.0 * text.count(x) / len(text) for x in LETTERS] for text in texts]


_LETTER_LOGITS = ", ".join(
    f"10.0::DOUBLE * (length(t) - length(replace(t, '{x}', ''))) / length(t)" for x in LETTERS
)
LETTER_SQL = f"""WITH {REQUESTS},
clean AS (SELECT request_id, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS t FROM requests),
wide AS (SELECT request_id, [{_LETTER_LOGITS}] AS x FROM clean),
long AS (SELECT request_id, unnest(x) AS x, generate_subscripts(x, 1) AS c FROM wide)"""


@query(
    "score_with_user_scorer",
    f"{LETTER_SQL} SELECT request_id, c::BIGINT AS c, round(x, 6) AS logit FROM long",
)
def score_with_user_scorer(spark, folder):
    rows = S.score_with(requests(spark, folder), LetterScorer, batch_size=64)
    exploded = rows.select("request_id", F.posexplode("logits").alias("at", "x"))
    return exploded.select(
        "request_id", (F.col("at") + 1).cast("bigint").alias("c"), r6("x").alias("logit")
    )
