"""MLlib intent classifiers over word features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MULTICLASS, MULTILABEL
from ..functions import text as T
from ..functions.vectors import bind
from ..session import cut_lineage
from .joint_fit import fit_joint
from .scoring import Scorer, score_with

# Every label has its own coefficients on the driver, so a model has few labels
# next to what a label map may hold.
MAX_MODEL_LABELS = 10_000
#: Penalty of a fit: half of it times the squared coefficients of features of unit deviation.
REG_PARAM = 1e-3


#: Characters per wanted token that are cleaned first, before the whole text.
_FIRST_CHARS = 10


def model_tokens(text: Column, max_tokens: int = 128) -> Column:
    """The word tokens a model sees: both cleanups, then truncation.

    No cleanup or token reaches across a space, so the tokens up to a space are the first
    ones of the text. A long text is cleaned whole only if its beginning holds too few.
    """

    def words(part: Column) -> Column:
        return T.truncate_tokens(T.tokens(T.clean_punct(T.clean_basic(part))), max_tokens)

    size = _FIRST_CHARS * max_tokens
    head = F.substring(text, 1, size)
    partial = F.length(F.substring_index(head, " ", -1))
    whole = F.substring(head, F.lit(1), F.length(head) - partial)
    long = bind(words(whole), lambda w: F.when(F.size(w) == max_tokens, w).otherwise(words(text)))
    return F.when(F.length(text) > size, long).otherwise(words(text))


def feature_pipeline(
    vectorizer: str = "hash", n_features: int = 1 << 16, min_df: float = 1.0
) -> Pipeline:
    """Tokens to TF-IDF.

    ``hash`` keeps every token, in one of ``n_features`` bins, without a vocabulary.
    ``count`` holds the ``n_features`` most frequent terms on the driver and leaves
    out the rest.
    """
    if vectorizer == "count":
        counts = CountVectorizer(
            inputCol="tokens", outputCol="tf", vocabSize=n_features, minDF=min_df
        )
    elif vectorizer == "hash":
        counts = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=n_features)
    else:
        raise ValueError("vectorizer must be 'count' or 'hash'")
    return Pipeline(stages=[counts, IDF(inputCol="tf", outputCol="features")])


def with_tokens(df: DataFrame, text_col: str = "text", max_tokens: int = 128) -> DataFrame:
    return df.withColumn("tokens", model_tokens(F.col(text_col), max_tokens))


def term_weights(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 128
) -> DataFrame:
    """``id, term, tf, weight``: TF-IDF as a table, one row per document and term.

    The whole vocabulary takes part and stays distributed. ``weight`` is
    ``tf * ln((n + 1) / (df + 1))`` for n documents of which df hold the term.
    """
    tokens = df.select(id_col, F.explode(model_tokens(F.col(text_col), max_tokens)).alias("term"))
    tf = cut_lineage(tokens.groupBy(id_col, "term").agg(F.count("*").alias("tf")))
    n = df.count()
    idf = tf.groupBy("term").agg(F.log(F.lit(n + 1) / (F.count("*") + 1)).alias("idf"))
    return tf.join(idf, "term").select(
        id_col, "term", "tf", (F.col("tf") * F.col("idf")).alias("weight")
    )


def featurize(
    df: DataFrame,
    text_col: str = "text",
    max_tokens: int = 128,
    pipeline: PipelineModel | None = None,
    **options,
) -> tuple[DataFrame, PipelineModel]:
    """Replace the text by ``features``; returns the fitted pipeline too."""
    tokens = with_tokens(df, text_col, max_tokens)
    fitted = pipeline or feature_pipeline(**options).fit(tokens.select("tokens"))
    return fitted.transform(tokens).drop(text_col, "tokens", "tf"), fitted


@dataclass(frozen=True)
class JointHead:
    """A label's row of the regression that gives all margins."""

    regression: LogisticRegressionModel
    row: int

    @property
    def coefficients(self) -> np.ndarray:
        return self.regression.coefficientMatrix.toArray()[self.row]

    @property
    def intercept(self) -> float:
        return float(self.regression.interceptVector[self.row])


@dataclass
class IntentModel:
    """A fitted feature pipeline, its classifier and the labels it stands for.

    ``regression`` gives a margin per label. ``heads`` is that regression for a multiclass
    model; a multilabel one has a head per label, a number where the logit is fixed.
    """

    task: str
    labels: Sequence[str]
    features: PipelineModel
    heads: Sequence[LogisticRegressionModel | JointHead | float]
    max_tokens: int = 128
    text_col: str = field(default="text")
    regression: LogisticRegressionModel | None = None

    def __post_init__(self) -> None:
        if self.regression is None:
            self.regression = self.heads[0]

    def transform(
        self, df: DataFrame, text_col: str | None = None, out: str = "logits"
    ) -> DataFrame:
        """Add one logit per label; batch or streaming, no Python worker involved."""
        column = text_col or self.text_col
        scored = self.features.transform(with_tokens(df, column, self.max_tokens))
        # one product gives all margins; a lone label has an empty row beside it
        margins = vector_to_array(F.col("_raw"))
        logits = F.slice(margins, 1, len(self.labels))
        scored = self.regression.transform(scored)
        return scored.withColumn(out, logits).drop("tokens", "tf", "features", "_raw")


def _label_list(label_map: DataFrame) -> list[str]:
    """Labels by id. Bounded: a longer map is refused before anything is fitted."""
    rows = label_map.select("label_id", "label").limit(MAX_MODEL_LABELS + 1).collect()
    if len(rows) > MAX_MODEL_LABELS:
        raise ValueError(f"a model takes at most {MAX_MODEL_LABELS} labels")
    ordered = sorted((row["label_id"], row["label"]) for row in rows)
    if [i for i, _ in ordered] != list(range(len(ordered))):
        raise ValueError("label ids must run from 0 without gaps")
    return [label for _, label in ordered]


def _regression(max_iter: int, reg_param: float) -> LogisticRegression:
    # only raw scores are used; an empty name switches the other columns off
    return LogisticRegression(
        featuresCol="features",
        probabilityCol="",
        predictionCol="",
        rawPredictionCol="_raw",
        maxIter=max_iter,
        regParam=reg_param,
        tol=1e-7,
    )


def _training_features(
    df: DataFrame, text_col: str, max_tokens: int, options: dict
) -> tuple[DataFrame, PipelineModel]:
    """Counts, features and fitted pipeline.

    The truncated tokens are all a fit needs of the text; they are written once
    and every pass of the fit reads them instead of cleaning text again.
    """
    tokens = cut_lineage(
        df.select("labels", model_tokens(F.col(text_col), max_tokens).alias("tokens"))
    )
    fitted = feature_pipeline(**options).fit(tokens)
    return fitted.transform(tokens).select("tf", "features", "labels"), fitted


def fit_multiclass(
    df: DataFrame,
    label_map: DataFrame,
    text_col: str = "text",
    max_iter: int = 300,
    reg_param: float = REG_PARAM,
    max_tokens: int = 128,
    **options,
) -> IntentModel:
    """Multinomial logistic regression on ``(text, labels)`` with integer labels."""
    labels = _label_list(label_map)
    features, pipeline = _training_features(df, text_col, max_tokens, options)
    # the map fixes the number of classes, also when the data lack the last one
    nominal = {"ml_attr": {"type": "nominal", "vals": labels}}
    label = F.col("labels").cast("double").alias("label", metadata=nominal)
    train = features.select("features", label)
    head = _regression(max_iter, reg_param).setFamily("multinomial").fit(train)
    return IntentModel(MULTICLASS, labels, pipeline, [head], max_tokens, text_col)


def fit_multilabel(
    df: DataFrame,
    label_map: DataFrame,
    text_col: str = "text",
    max_iter: int = 300,
    reg_param: float = REG_PARAM,
    max_tokens: int = 128,
    **options,
) -> IntentModel:
    """One binary logistic regression per label over shared features, all fitted together.

    The number of passes over the data does not depend on the number of labels; at most
    ``max_iter`` are made. A label that is always or never present gets a fixed logit from
    its smoothed odds instead of a fit.
    """
    labels = _label_list(label_map)
    features, pipeline = _training_features(df, text_col, max_tokens, options)
    # a feature is a count times its bin's weight; counts take an eighth of the room
    counts = features.select(F.col("tf").alias("features"), "labels")
    coefficients, intercepts, fitted = fit_joint(
        counts,
        len(labels),
        _n_features(pipeline),
        reg_param,
        max_iter,
        scale=pipeline.stages[1].idf.toArray(),
    )
    regression = _regression_of(df.sparkSession, coefficients, intercepts)
    heads = [
        JointHead(regression, i) if fitted[i] else float(intercepts[i]) for i in range(len(labels))
    ]
    return IntentModel(MULTILABEL, labels, pipeline, heads, max_tokens, text_col, regression)


def _n_features(pipeline: PipelineModel) -> int:
    counts = pipeline.stages[0]
    return counts.getNumFeatures() if isinstance(counts, HashingTF) else len(counts.vocabulary)


def _regression_of(
    spark: SparkSession, coefficients: np.ndarray, intercepts: np.ndarray
) -> LogisticRegressionModel:
    """A regression that gives these margins as its raw scores.

    MLlib has no constructor for given coefficients, but a fit of no iterations ends where
    it begins, and it begins within the bounds it is given.
    """
    k, d = coefficients.shape
    rows = max(k, 2)
    padded, offsets = np.zeros((rows, d)), np.zeros(rows)
    padded[:k], offsets[:k] = coefficients, intercepts
    matrix = DenseMatrix(rows, d, padded.ravel(order="F"))
    nominal = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(rows)]}}
    # every feature must vary, or its coefficient becomes zero
    two = spark.createDataFrame(
        [(Vectors.sparse(d, {}), 0.0), (Vectors.dense(np.ones(d)), 1.0)],
        ["features", "label"],
    ).withColumn("label", F.col("label").alias("label", metadata=nominal))
    start = _regression(0, 0.0).setFamily("multinomial").setStandardization(False)
    start.setLowerBoundsOnCoefficients(matrix).setUpperBoundsOnCoefficients(matrix)
    start.setLowerBoundsOnIntercepts(Vectors.dense(offsets))
    start.setUpperBoundsOnIntercepts(Vectors.dense(offsets))
    return start.fit(two)


_META = (
    "task string, max_tokens int, text_col string, "
    "fixed array<struct<head:int,logit:double>>"
)


def save_model(model: IntentModel, spark: SparkSession, path: str) -> None:
    """Pipeline, regression, labels and task below one folder."""
    root = path.rstrip("/")
    model.features.write().overwrite().save(f"{root}/features")
    model.regression.write().overwrite().save(f"{root}/regression")
    fixed = [(i, head) for i, head in enumerate(model.heads) if isinstance(head, float)]
    rows = [(i, label) for i, label in enumerate(model.labels)]
    spark.createDataFrame(rows, "label_id int, label string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{root}/label_map")
    spark.createDataFrame(
        [(model.task, model.max_tokens, model.text_col, fixed)], _META
    ).write.mode("overwrite").json(f"{root}/meta")


def load_model(spark: SparkSession, path: str) -> IntentModel:
    root = path.rstrip("/")
    meta = spark.read.schema(_META).json(f"{root}/meta").first()
    labels = _label_list(spark.read.schema("label_id int, label string").json(f"{root}/label_map"))
    regression = LogisticRegressionModel.load(f"{root}/regression")
    fixed = {row["head"]: row["logit"] for row in meta["fixed"] or []}
    heads: list = [regression]
    if meta["task"] == MULTILABEL:
        heads = [fixed.get(i, JointHead(regression, i)) for i in range(len(labels))]
    return IntentModel(
        meta["task"],
        labels,
        PipelineModel.load(f"{root}/features"),
        heads,
        meta["max_tokens"],
        meta["text_col"],
        regression,
    )


def score(
    df: DataFrame,
    model: IntentModel | Callable[[], Scorer],
    text_col: str | None = None,
    batch_size: int = 8,
) -> DataFrame:
    """Add logits from a fitted model, or from a user scorer given by its factory.

    ``batch_size`` is the number of texts a user scorer gets at once; a fitted
    model stays in the JVM and has no batches.
    """
    if isinstance(model, IntentModel):
        return model.transform(df, text_col)
    return score_with(df, model, text_col or "text", batch_size=batch_size)
