"""The queries of this subpackage and their SQL.

Each applies one operator, with the parameters meant for production, to its whole
table and derives the columns to compare from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat,
    collocations,
    decontaminate,
    exact_dedup,
    filter_audit,
    line_dedup,
    minhash,
    ngram_join,
    secret_scan,
    sharding,
    suffix_dedup,
    toxicity,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    held_out = toxicity.held_out("doc_id")
    found = secret_scan.scan(table(spark, folder, "documents"), held_out=held_out)
    return found.select(
        "doc_id",
        "start",
        F.char_length("candidate").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        held_out.alias("held_out"),
        "label",
        "score",
        "is_secret",
    )


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def tokenizer_description() -> str:
    """The JSON of the 50k byte-level tokenizer, read on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encode_and_decode(table(spark, folder, "documents"), tokenizer_description())
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        tricky.alias("text"),
    )
    pieces = chat.format_conversations(turns.union(extra))
    return chat.digest_conversations(pieces)


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.dedup_substrings(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # The SQL of this query judges runs by their number of lines alone.
    found = line_dedup.dedup_lines(table(spark, folder, "documents"), min_words=None)
    return found.select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256")
    )


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.interleaved_shards(table(spark, folder, "documents"), SHARDS)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents")).drop("doc_key")


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


_OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_OP5_SQL = """
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
    FROM range(2) t(i)
), marked AS (
    SELECT *,
           length(text) + length(text) - length(replace(replace(replace(
               text, '\\', ''), '<', ''), '[', '')) AS escaped,
           CASE role WHEN 'assistant' THEN 5 ELSE 8 END AS closing
    FROM turns
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT)
           AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), ''))
           AS loss_sha256,
       CAST(sum(9 + length(role) + 3 + escaped + closing) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_OP7_SQL = f"""
WITH docs AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), starts AS (
    SELECT doc_id, unnest(range(1, len(lines) - {line_dedup.WINDOW} + 2)) AS i, lines FROM docs
), ranked AS (
    SELECT doc_id, i,
           row_number() OVER (
               PARTITION BY lines[i : i + {line_dedup.WINDOW - 1}] ORDER BY doc_id, i
           ) AS nth
    FROM starts
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + {line_dedup.WINDOW})) AS p
    FROM ranked WHERE nth > 1
), per_line AS (
    SELECT l.doc_id, l.p, l.line, g.p IS NOT NULL AS out,
           lag(g.p) OVER (PARTITION BY l.doc_id ORDER BY l.p) IS NOT NULL AS out_before
    FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM docs) l
    LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p
)
SELECT doc_id,
       count(*) AS n_lines,
       count(*) FILTER (WHERE out) AS n_removed,
       count(*) FILTER (WHERE out AND NOT out_before) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT out), ''))
           AS kept_sha256
FROM per_line GROUP BY doc_id
"""

_WORDS_SQL = r"""
    list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')
"""

_OP10_SQL = f"""
WITH docs AS (
    SELECT doc_id, {_WORDS_SQL} AS words FROM documents
), items AS (
    SELECT item_id, {_WORDS_SQL} AS words FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, words[i : i + {decontaminate.WINDOW - 1}] AS w
    FROM (SELECT item_id, words,
                 unnest(range(1, greatest(len(words) - {decontaminate.WINDOW}, 0) + 2)) AS i
          FROM items WHERE len(words) > 0)
), lengths AS (
    SELECT DISTINCT len(w) AS n FROM item_windows
), doc_windows AS (
    SELECT doc_id, i, n, words[i : i + n - 1] AS w
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, lengths)
), hits AS (
    SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (w)
), per_doc AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), doc_items AS (
    SELECT doc_id, count(*) AS n_items,
           sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)))
               AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN per_doc USING (doc_id) LEFT JOIN doc_items USING (doc_id)
"""

_OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
    FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), grams AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
          FROM worded, range(1, 6) r(k) WHERE len(w) >= k)
    GROUP BY lang, k, phrase HAVING count(*) >= 100
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS ws FROM grams WHERE k >= 2
), inner_phrases AS (
    SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(f) AS longer
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, 5) r(m) WHERE m < k)
    GROUP BY ALL
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, n,
           (CAST(1000 AS HUGEINT) * c.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
    JOIN totals USING (lang)
    JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : cut], ' ')
    JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1 : c.k], ' ')
), best AS (
    SELECT * FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
    SELECT best.* FROM best LEFT JOIN inner_phrases i USING (lang, phrase)
    WHERE coalesce(100 * i.longer < 100 * a, true)
)
SELECT lang, row_number() OVER by_score AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept
WINDOW by_score AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER by_score <= 2000
"""

_OP13_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                       lambda w: w <> '') AS words,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS again
    FROM documents
), fails AS (
    SELECT doc_id, part, len(words) < 50 AS a,
           100 * len(list_distinct(words)) < 65 * len(words) AS b,
           100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c,
           regexp_matches(t, '[#$%&*|]') AS d, again AS e
    FROM docs
), judged AS (
    SELECT *, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END,
                     CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END,
                     CASE WHEN e THEN 'E' ELSE '' END) AS failed
    FROM fails
), known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad
    FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good,
           count(*) FILTER (WHERE bad) AS bad
    FROM judged LEFT JOIN known USING (doc_id) GROUP BY part, failed
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter,
           substr(filter_order, 1, step - 1) AS earlier
    FROM orders, range(1, 6) r(step)
), at_step AS (
    SELECT part, filter_order, step, letter, n, good, bad, failed,
           contains(failed, letter) AS fails_here,
           translate(failed, earlier, '') <> failed AS gone
    FROM counts, steps
), per_step AS (
    SELECT part, filter_order, step, any_value(letter) AS letter,
           coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_here), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE NOT gone AND fails_here), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE gone AND fails_here), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE failed = letter), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE NOT gone AND fails_here), 0) AS good_lost,
           coalesce(sum(bad) FILTER (WHERE NOT gone AND fails_here), 0) AS toxic_lost
    FROM at_step GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM per_step
"""

QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_bpe": op4_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_minhash": op9_minhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_ngram_join": op11_ngram_join,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": _OP3_SQL,
    "op5_chat_format": _OP5_SQL,
    "op7_line_dedup": _OP7_SQL,
    "op10_decontaminate": _OP10_SQL,
    "op12_collocations": _OP12_SQL,
    "op13_filter_audit": _OP13_SQL,
}
