"""Whole plans: files in, published results out; and rows that operators must change."""

from __future__ import annotations

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..config import MULTICLASS, CorpusConfig
from ..functions.text import clean_punct, tokens
from ..operators import labels as L
from ..plans.prepare import prepare
from ..plans.score_file import score_file
from ..plans.training_run import load_run, run_training
from ..session import scratch_path
from ..sources import files
from ..sources.publish import current
from ..streaming.scoring import read_answers, replacing, score_stream_with, write_answers_once
from .base import CORPUS, REQUESTS, big, corpus, documents, joined, query, r6, requests
from .base import sql_clean_punct
from .base import sql_tokens, table
from .labels import _MAP
from .models import request_stream
from .scores import LETTER_SQL, LETTERS, LetterScorer


@query(
    "score_file",
    f"""{LETTER_SQL}, p AS (
      SELECT request_id, c, exp(x) / sum(exp(x)) OVER (PARTITION BY request_id) AS p,
             row_number() OVER (PARTITION BY request_id ORDER BY x DESC, c) AS rank FROM long)
    SELECT request_id, text, {list(LETTERS)}[c] AS predicted_label, round(p, 6) AS predicted_score
    FROM p JOIN requests USING (request_id) WHERE rank = 1""",
)
def score_requests_file(spark, folder):
    """A file of requests scored, published as a file, and read back."""
    path, out = scratch_path(spark, "requests") + ".csv", scratch_path(spark, "scored")
    asked = requests(spark, folder)
    asked.write.options(**files.csv_options(",")).option("header", True).csv(path)
    score_file(
        spark, path, LetterScorer, out, task=MULTICLASS, labels=LETTERS,
        include_probabilities=True, batch_size=64,
    )
    return files.read_scoring_input(spark, current(spark, out)).select(
        "request_id", "text", "predicted_label", r6("predicted_score").alias("predicted_score")
    )


@query(
    "training_run_published",
    f"""WITH docs AS (SELECT lang AS label FROM documents), {_MAP("docs")},
    names AS (SELECT unnest(['eval', 'test']) AS split)
    SELECT label, label_id::BIGINT AS label_id, split, true AS scored FROM map, names""",
)
def training_run(spark, folder):
    """Label map and splits of a published run; its model gives each class a logit."""
    rows = documents(spark, folder).select("doc_id", "text", F.col("lang").alias("label"))
    config = CorpusConfig("unused", task=MULTICLASS)
    prepared = prepare(rows, config, row_id="doc_id")
    root = scratch_path(spark, "run")
    run_training(spark, prepared, MULTICLASS, "run", root, prepared.validation, max_iter=20)
    model, label_map, metrics = load_run(spark, root)
    scored = model.transform(rows).agg(
        (F.min(F.size("logits")) == len(model.labels)).alias("scored")
    )
    splits = metrics.select("split").distinct()
    # one row, and as many as there are splits
    return label_map.select("label", *big("label_id")).join(splits).join(scored)


@query(
    "reader_by_extension",
    f"""WITH {CORPUS}, kinds AS (SELECT unnest(['TSV', 'csv', 'JSONL']) AS kind)
    SELECT kind, md5(text) AS text_md5, label FROM corpus, kinds""",
)
def reader_by_extension(spark, folder):
    """The same corpus under three extensions, read without naming a type."""
    rows = corpus(spark, folder).select("text", "label")
    merged = None
    for kind, separator in (("TSV", "\t"), ("csv", ","), ("JSONL", None)):
        path = f"{scratch_path(spark, 'corpus')}.{kind}"
        if separator is None:
            rows.write.json(path)
        else:
            rows.write.options(**files.csv_options(separator)).csv(path)
        found = files.read_corpus(spark, path, columns=["text", "label"], na_tokens=None)
        part = found.select(F.lit(kind).alias("kind"), F.md5("text").alias("text_md5"), "label")
        merged = part if merged is None else merged.unionByName(part)
    return merged


class MoodyScorer(LetterScorer):
    """Fails on texts of odd length."""

    def __call__(self, texts):
        for text in texts:
            if len(text) % 2:
                raise ValueError(f"odd length {len(text)}")
        return super().__call__(texts)


_BLANK = "chr(32) || chr(9) || chr(160)"


@query(
    "answers_with_errors",
    f"""WITH asked AS (
      SELECT conv_id || '-' || turn AS request_id,
             CASE conv_id % 3 WHEN 0 THEN {_BLANK} WHEN 1 THEN '' ELSE text END AS text
      FROM conversations WHERE role = 'user'),
    clean AS (SELECT *, regexp_replace(lower(text), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g') AS t
              FROM asked)
    SELECT request_id,
           CASE WHEN t = '' THEN 'TEXT_EMPTY' WHEN length(t) % 2 = 1 THEN 'INTERNAL_ERROR' END AS error,
           CASE WHEN t = '' THEN '"text" is empty.'
                WHEN length(t) % 2 = 1 THEN 'odd length ' || length(t) END AS message,
           CASE WHEN t <> '' AND length(t) % 2 = 0 THEN 3 END AS n_intents
    FROM clean""",
)
def answers_with_errors(spark, folder):
    """Blank requests and requests the scorer fails on get error rows, all others answers."""
    turns = table(spark, folder, "conversations").filter(F.col("role") == "user")
    third = F.col("conv_id") % 3
    asked = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.when(third == 0, " \t ").when(third == 1, "").otherwise(F.col("text")).alias("text"),
    )
    answers = score_stream_with(asked, MoodyScorer, MULTICLASS, LETTERS, batch_size=16)
    return answers.select(
        "request_id",
        F.col("error.label").alias("error"),
        F.col("error.message").alias("message"),
        F.when(F.col("intents").isNotNull(), F.size("intents")).cast("bigint").alias("n_intents"),
    )


@query(
    "score_stream_replayed",
    f"""WITH {REQUESTS} SELECT request_id, count(*) AS n_answers FROM requests GROUP BY request_id""",
)
def stream_replayed(spark, folder):
    """A streaming query that dies after writing a batch answers each request once."""
    path, progress = scratch_path(spark, "answers"), scratch_path(spark, "progress")
    answers = score_stream_with(
        request_stream(spark, folder), LetterScorer, MULTICLASS, LETTERS, batch_size=64
    )
    write = replacing(path)

    def dies(batch, number):
        write(batch, number)
        raise RuntimeError("killed after writing")

    first = answers.writeStream.foreachBatch(dies).option("checkpointLocation", progress)
    with contextlib.suppress(StreamingQueryException):
        first.trigger(availableNow=True).start().awaitTermination()
    write_answers_once(answers, path, progress, available_now=True).awaitTermination()
    found = read_answers(spark, path)
    return found.groupBy("request_id").agg(F.count("*").alias("n_answers"))


_SPOKEN = ("“Cannot” gonna", "lemme «wanna»")


@query(
    "tokens_of_contractions",
    f"""WITH spoken AS (
      SELECT doc_id, replace(replace(text, ' the ', ' {_SPOKEN[0]} '), ' of ', ' {_SPOKEN[1]} ') AS text
      FROM documents),
    cleaned AS (SELECT doc_id, {sql_clean_punct("text")} AS text FROM spoken)
    SELECT doc_id, array_to_string({sql_tokens("text")}, ' ') AS tokens FROM cleaned""",
)
def tokens_of_contractions(spark, folder):
    """Texts in which common words are replaced by contractions and typographic quotes."""
    rows = documents(spark, folder)
    text = F.col("text")
    for word, spoken in zip((" the ", " of "), _SPOKEN, strict=True):
        text = F.replace(text, F.lit(word), F.lit(f" {spoken} "))
    return rows.select("doc_id", joined(tokens(clean_punct(text))).alias("tokens"))


@query(
    "canonical_labels_unsorted",
    f"""WITH {CORPUS}
    SELECT doc_id, array_to_string(list_sort(string_split(label, '+')), '+') AS label,
           label <> array_to_string(list_reverse(string_split(label, '+')), '+') AS changed
    FROM corpus""",
)
def canonical_unsorted(spark, folder):
    """Labels with their parts the other way round, put in order again."""
    rows = corpus(spark, folder)
    backwards = F.array_join(F.reverse(F.split("label", r"\+")), "+")
    turned = rows.select("doc_id", "label", backwards.alias("backwards"))
    return turned.select(
        "doc_id",
        L.canonical_label(F.col("backwards")).alias("label"),
        (F.col("label") != F.col("backwards")).alias("changed"),
    )
