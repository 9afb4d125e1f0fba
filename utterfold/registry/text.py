"""Cleanup, tokens, row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleanup as C
from ..operators.batches import python_cleanup
from .base import (
    ALNUM,
    CORPUS,
    REQUESTS,
    STOP,
    TOKENS,
    cleaned_texts,
    corpus,
    documents,
    joined,
    query,
    requests,
    sql_clean_basic,
    sql_clean_punct,
    table,
)
from ..operators.scoring import gate_empty_text


@query(
    "clean_basic",
    f"SELECT doc_id, {sql_clean_basic('text')} AS text FROM documents",
)
def clean_basic(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", T.clean_basic(F.col("text")).alias("text")
    )


@query(
    "clean_punct",
    f"SELECT doc_id, {sql_clean_punct('text')} AS text FROM documents",
)
def clean_punct(spark, folder):
    return documents(spark, folder).select(
        "doc_id", T.clean_punct(F.col("text")).alias("text")
    )


@query(
    "cleanup_by_name",
    f"SELECT doc_id, {sql_clean_basic('text')} AS text, {sql_clean_basic('source')} AS source "
    "FROM documents",
)
def cleanup_by_name(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return C.apply_cleanup(docs, T.clean_basic, names=["text", "source", "absent"], indices=[0])


@query(
    "cleanup_by_index",
    f"SELECT doc_id, {sql_clean_punct('text')} AS text FROM documents",
)
def cleanup_by_index(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return C.apply_cleanup(docs, T.clean_punct, indices=[1, 9])


@query(
    "cleanup_without_valid_column",
    "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def cleanup_without_valid_column(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id")
    rows = rows.join(table(spark, folder, "labels"), "doc_id", "left")
    return C.apply_cleanup(rows, T.clean_basic, names=["absent"])


@query(
    "cleanup_python_function",
    "SELECT doc_id, replace(lang, 'e', '3') AS lang FROM documents",
)
def cleanup_python_function(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return C.apply_cleanup(docs, python_cleanup(lambda s: s.replace("e", "3")), names=["lang"])


@query(
    "drop_incomplete",
    "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id) "
    "WHERE quality IS NOT NULL AND toxic IS NOT NULL",
)
def drop_incomplete(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id")
    rows = rows.join(table(spark, folder, "labels"), "doc_id", "left")
    return C.drop_incomplete(rows)


@query(
    "cast_label_to_string",
    "SELECT vec_id, label::VARCHAR AS label FROM embeddings",
)
def cast_label_to_string(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.col("label").cast("string"))


@query(
    "filter_combined",
    f"WITH {CORPUS} SELECT doc_id, label FROM corpus WHERE contains(label, '+')",
)
def filter_combined(spark, folder):
    return C.filter_combined(corpus(spark, folder)).select("doc_id", "label")


@query(
    "drop_unlabelled",
    "SELECT d.doc_id, quality AS labels FROM documents d JOIN labels l USING (doc_id) "
    "WHERE quality IS NOT NULL",
)
def drop_unlabelled(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id")
    rows = rows.join(table(spark, folder, "labels"), "doc_id", "left")
    return C.drop_unlabelled(rows.select("doc_id", F.col("quality").alias("labels")))


@query(
    "gate_empty_text",
    f"""WITH {REQUESTS}
    SELECT request_id,
           CASE WHEN {sql_clean_basic("text")} = '' THEN 'TEXT_EMPTY' END AS error_label,
           CASE WHEN {sql_clean_basic("text")} = '' THEN '"text" is empty.' END AS error_message
    FROM requests""",
)
def gate_empty(spark, folder):
    gated = gate_empty_text(requests(spark, folder))
    return gated.select(
        "request_id",
        F.col("error.label").alias("error_label"),
        F.col("error.message").alias("error_message"),
    )


@query(
    "tokens",
    f"WITH {TOKENS} SELECT doc_id, array_to_string(toks, ' ') AS tokens FROM tok",
)
def tokens(spark, folder):
    return cleaned_texts(spark, folder).select("doc_id", joined(T.tokens(F.col("text"))).alias("tokens"))


@query(
    "kept_tokens",
    f"""WITH {TOKENS}
    SELECT doc_id, array_to_string(list_filter(toks, lambda t: {ALNUM("t")}
                                               AND t NOT IN {STOP}), ' ') AS tokens
    FROM tok""",
)
def kept_tokens(spark, folder):
    return cleaned_texts(spark, folder).select(
        "doc_id", joined(T.kept_tokens(F.col("text"))).alias("tokens")
    )


@query(
    "token_tests",
    f"""WITH {TOKENS}, words AS (SELECT unnest(toks) AS token FROM tok)
    SELECT {ALNUM("token")} AS alnum, token IN {STOP} AS stopword, count(*) AS n
    FROM words GROUP BY 1, 2""",
)
def token_tests(spark, folder):
    exploded = cleaned_texts(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return exploded.groupBy(
        T.is_alnum(F.col("token")).alias("alnum"), T.is_stopword(F.col("token")).alias("stopword")
    ).agg(F.count("*").alias("n"))


@query(
    "truncate_tokens",
    f"WITH {TOKENS} SELECT doc_id, array_to_string(toks[1:128], ' ') AS tokens FROM tok",
)
def truncate_tokens(spark, folder):
    return cleaned_texts(spark, folder).select(
        "doc_id", joined(T.truncate_tokens(T.tokens(F.col("text")))).alias("tokens")
    )


@query(
    "text_lengths",
    f"""WITH {TOKENS}
    SELECT doc_id, length(text)::BIGINT AS chars, len(toks)::BIGINT AS words FROM tok""",
)
def text_lengths(spark, folder):
    text = F.col("text")
    return cleaned_texts(spark, folder).select(
        "doc_id",
        T.char_length(text).cast("bigint").alias("chars"),
        T.word_length(text).cast("bigint").alias("words"),
    )


@query(
    "request_cleanup",
    f"WITH {REQUESTS} SELECT request_id, {sql_clean_basic('text')} AS text FROM requests",
)
def request_cleanup(spark, folder):
    return requests(spark, folder).withColumn("text", T.clean_basic(F.col("text")))
