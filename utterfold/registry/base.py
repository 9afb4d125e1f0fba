"""How registered queries are declared, and the views they share.

A query reads the driver tables below a folder; the SQL next to it says the same
in DuckDB's dialect. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where SQL can say it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(col: Column | str) -> Column:
    """Rounded double, without a negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), 6) + F.lit(0.0)


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def joined(col: Column | str, separator: str = " ") -> Column:
    """An array as text, for comparison."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(col, lambda x: x.cast("string")), separator)


# --- driver tables ----------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, shared among all cores: the small files are one row group each."""
    return spread(table(spark, folder, "documents"), "doc_id")


def with_label(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Replace ``lang`` by the combined label of each document."""
    labels = table(spark, folder, "labels")
    label = F.concat_ws(
        "+",
        F.col("lang"),
        F.when(F.col("quality") == 1, F.lit("good")),
        F.when(F.col("toxic") == 1, F.lit("toxic")),
    )
    kept = [c for c in rows.columns if c != "lang"]
    return rows.join(labels, "doc_id", "left").select(*kept, label.alias("label"))


def corpus(spark: SparkSession, folder: str, source: DataFrame | None = None) -> DataFrame:
    """``doc_id, text, label``."""
    source = source or table(spark, folder, "documents")
    return with_label(spark, folder, source.select("doc_id", "text", "lang"))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text, label`` with punctuation removed."""
    rows = corpus(spark, folder, documents(spark, folder))
    return rows.withColumn("text", T.clean_punct(F.col("text")))


def cleaned_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text`` with punctuation removed: no join where no label is needed."""
    return documents(spark, folder).select(
        "doc_id", T.clean_punct(F.col("text")).alias("text")
    )


def unpacked(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.labels import unpack_labels

    return unpack_labels(corpus(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, truth, logits``: each vector times the mean vector of each class."""
    vectors = table(spark, folder, "embeddings")
    vectors = vectors.withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    means = vectors.groupBy("label").agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("v")))).alias("row")
    )
    # ten class rows of fixed width
    matrix = means.agg(F.array_sort(F.collect_list(F.struct("label", "row")))["row"]).scalar()
    with_matrix = vectors.withColumn("matrix", matrix)
    logits = V.bind(
        F.col("v"),
        lambda v: F.transform(
            "matrix", lambda row: r6(V.array_sum(F.zip_with(v, row, lambda a, b: a * b)))
        ),
    )
    return with_matrix.select("vec_id", F.col("label").alias("truth"), logits.alias("logits"), "v")


def scored_multilabel(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, truth, logits`` with multi-hot truth of one or two labels.

    Logits are standardised per row, so a label is predicted when it exceeds the
    row mean by one deviation.
    """
    base = scored(spark, folder)
    second = (F.get("v", F.lit(0)) > F.get("v", F.lit(1))) & (
        F.get("v", F.lit(2)) > F.get("v", F.lit(3))
    )
    ids = F.when(second, F.array("truth", (F.col("truth") + 1) % 10)).otherwise(F.array("truth"))

    def standardised(x: Column) -> Column:
        size = F.size(x)
        mean = V.array_sum(x) / size
        centred = V.bind(mean, lambda m: F.transform(x, lambda value: value - m))
        return V.bind(
            centred,
            lambda c: V.bind(
                F.sqrt(V.array_sum(F.transform(c, lambda d: d * d)) / (size - 1)),
                lambda std: F.transform(c, lambda d: r6(d / std - 1)),
            ),
        )

    return base.select(
        "vec_id",
        V.multi_hot(ids, F.lit(10)).alias("truth"),
        V.bind(F.col("logits"), standardised).alias("logits"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """``request_id, text``: what users said."""
    turns = table(spark, folder, "conversations").filter(F.col("role") == "user")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "text")


def epoch_log(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, epoch, metric, value``: daily mean value of each event type and user."""
    events = table(spark, folder, "events")
    return (
        events.groupBy(
            F.concat_ws("-", "event_type", "user_id").alias("run_id"),
            F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch"),
        )
        .agg(r6(F.avg("value")).alias("value"))
        .select("run_id", "epoch", F.lit("mean_value").alias("metric"), "value")
    )


# --- the same in SQL --------------------------------------------------------------

_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_clean_basic(col: str) -> str:
    return f"regexp_replace(lower(coalesce({col}, '')), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def sql_clean_punct(col: str) -> str:
    kept = f"regexp_replace(lower(coalesce({col}, '')), '[!-/:-@\\[-`{{-~]+', '', 'g')"
    return f"trim(regexp_replace({kept}, '{_SPACE}+', ' ', 'g'), ' ')"


def sql_tokens(clean: str) -> str:
    spaced = f"regexp_replace({clean}, '([«“‘„»”’])', ' \\1 ', 'g')"
    words = f"list_filter(string_split({spaced}, ' '), lambda t: t <> '')"
    return (
        f"flatten(list_transform({words}, lambda t: CASE t "
        "WHEN 'cannot' THEN ['can', 'not'] WHEN 'gimme' THEN ['gim', 'me'] "
        "WHEN 'gonna' THEN ['gon', 'na'] WHEN 'gotta' THEN ['got', 'ta'] "
        "WHEN 'lemme' THEN ['lem', 'me'] WHEN 'wanna' THEN ['wan', 'na'] ELSE [t] END))"
    )


def sql_list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


STOP = sql_list(T.ENGLISH_STOPWORDS)
ALNUM = "regexp_full_match({0}, '[\\p{{L}}\\p{{N}}]+')".format

CORPUS = """corpus AS (
  SELECT d.doc_id, d.text,
         concat_ws('+', d.lang, CASE WHEN l.quality = 1 THEN 'good' END,
                   CASE WHEN l.toxic = 1 THEN 'toxic' END) AS label
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

CLEANED = f"""{CORPUS}, cleaned AS (
  SELECT doc_id, label, {sql_clean_punct("text")} AS text FROM corpus)"""

TOKENS = f"""{CLEANED}, tok AS (
  SELECT doc_id, label, text, {sql_tokens("text")} AS toks FROM cleaned)"""

WORDS = f"""{TOKENS}, words AS (
  SELECT doc_id, label, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM tok),
bag AS (SELECT * FROM words WHERE {ALNUM("term")}),
kept AS (SELECT * FROM bag WHERE term NOT IN {STOP})"""

UNPACKED = f"""{CORPUS}, unpacked AS (
  SELECT doc_id, text, unnest(string_split(label, '+')) AS label FROM corpus)"""

LENGTHS = f"""{TOKENS}, lengths AS (
  SELECT label, 'char' AS measure, length(text) AS length FROM tok
  UNION ALL SELECT label, 'word', len(toks) FROM tok)"""

LOGITS = """vec AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i
  FROM embeddings),
means AS (SELECT label AS c, i, avg(v) AS m FROM vec GROUP BY label, i),
logit AS (
  SELECT vec_id, label AS truth, c, round(sum(v * m), 6) + 0.0 AS x
  FROM vec JOIN means USING (i) GROUP BY vec_id, label, c)"""

SOFTMAX = f"""{LOGITS}, soft AS (
  SELECT vec_id, truth, c, x,
         exp(x) / sum(exp(x)) OVER w AS p
  FROM logit WINDOW w AS (PARTITION BY vec_id)),
pred AS (SELECT vec_id, truth, list(c ORDER BY x DESC, c)[1] AS pred FROM logit GROUP BY vec_id, truth)"""

MULTILABEL = f"""{LOGITS}, two AS (
  SELECT vec_id, label, embedding[1] > embedding[2] AND embedding[3] > embedding[4] AS second
  FROM embeddings),
ml AS (
  SELECT g.vec_id, g.c,
         (g.c = t.label OR (t.second AND g.c = (t.label + 1) % 10))::INT AS y,
         round((x - avg(x) OVER w) / stddev_samp(x) OVER w - 1, 6) + 0.0 AS x
  FROM logit g JOIN two t USING (vec_id) WINDOW w AS (PARTITION BY g.vec_id)),
mls AS (SELECT vec_id, c, y, x, 1 / (1 + exp(-x)) AS s FROM ml),
mlp AS (SELECT *, (s > 0.5)::INT AS p FROM mls)"""

REQUESTS = """requests AS (
  SELECT conv_id || '-' || turn AS request_id, text FROM conversations WHERE role = 'user')"""

EPOCHS = """epochs AS (
  SELECT event_type || '-' || user_id AS run_id,
         date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch,
         round(avg(value), 6) + 0.0 AS value
  FROM events GROUP BY ALL)"""

SPLIT = """ordered AS (
  SELECT *, row_number() OVER (ORDER BY md5('42-' || doc_id)) AS nr, count(*) OVER () AS n
  FROM corpus),
sides AS (
  SELECT doc_id, text, label, CASE WHEN nr <= ceil(0.2 * n) THEN 'b' ELSE 'a' END AS side
  FROM ordered)"""
