"""Drift between the two sides of an exact split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_punct
from ..functions.vectors import argmax
from ..operators import drift as D
from ..operators import metrics as M
from ..operators import profile as P
from ..operators.split import in_validation, split_exact
from .base import ALNUM, CORPUS, SOFTMAX, SPLIT, STOP, corpus, documents, query, r6, scored
from .base import sql_clean_punct, sql_tokens

_SIDES = f"""{CORPUS}, {SPLIT}"""
_TOK = f"""{_SIDES}, cleaned AS (SELECT side, doc_id, label, {sql_clean_punct("text")} AS text FROM sides),
tok AS (SELECT side, doc_id, label, text, {sql_tokens("text")} AS toks FROM cleaned)"""
_TERMS = f"""{_TOK}, words AS (SELECT side, unnest(toks) AS term FROM tok),
cnt AS (SELECT term, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b
  FROM words WHERE {ALNUM("term")} AND term NOT IN {STOP} GROUP BY term)"""


def _with_side(rows, source=None):
    """``rows`` with their side of the split; the cut is found in ``source``."""
    chosen = in_validation(rows if source is None else source, 0.2, "doc_id")
    return rows.withColumn("side", F.when(chosen, "b").otherwise("a"))


def _sides(spark, folder):
    # every document has one label row at most, so the cut is that of the documents
    return _with_side(corpus(spark, folder).drop("text"), documents(spark, folder))


def _text_sides(spark, folder):
    rows = documents(spark, folder).select("doc_id", "text")
    return _with_side(rows).withColumn("text", clean_punct(F.col("text")))


@query(
    "label_drift",
    f"""WITH {_SIDES}, c AS (
      SELECT label, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b
      FROM sides GROUP BY label),
    s AS (SELECT *, n_a / sum(n_a) OVER () AS sa, n_b / sum(n_b) OVER () AS sb FROM c)
    SELECT label, n_a, n_b, round(sa, 6) AS share_a, round(sb, 6) AS share_b,
           round(sb - sa, 6) + 0.0 AS share_delta,
           CASE WHEN n_b = 0 THEN 'missing' WHEN n_a = 0 THEN 'new' ELSE 'shared' END AS status
    FROM s""",
)
def label_drift(spark, folder):
    drift = D.label_drift_of(_sides(spark, folder))
    return drift.select(
        "label", "n_a", "n_b", *[r6(c).alias(c) for c in ("share_a", "share_b", "share_delta")],
        "status",
    )


@query(
    "vocab_drift",
    f"""WITH {_TERMS}
    SELECT count(*) FILTER (n_a > 0) AS vocab_a, count(*) FILTER (n_b > 0) AS vocab_b,
           count(*) FILTER (n_a > 0 AND n_b > 0) AS n_shared,
           count(*) FILTER (n_b = 0) AS n_only_a, count(*) FILTER (n_a = 0) AS n_only_b FROM cnt""",
)
def vocab_drift(spark, folder):
    return D.vocab_drift_of(D.term_sides(_text_sides(spark, folder)))


@query(
    "term_rank_change",
    f"""WITH {_TERMS}, r AS (
      SELECT *, CASE WHEN n_a > 0 THEN rank() OVER (ORDER BY n_a DESC) END AS rank_a,
             CASE WHEN n_b > 0 THEN rank() OVER (ORDER BY n_b DESC) END AS rank_b,
             row_number() OVER (ORDER BY n_a DESC, term) AS at_a,
             row_number() OVER (ORDER BY n_b DESC, term) AS at_b FROM cnt)
    SELECT term, n_a, n_b, rank_a, rank_b, rank_a - rank_b AS rank_gain
    FROM r WHERE (at_a <= 25 AND n_a > 0) OR (at_b <= 25 AND n_b > 0)""",
)
def term_rank_change(spark, folder):
    return D.term_rank_change_of(D.term_sides(_text_sides(spark, folder)))


@query(
    "length_drift",
    f"""WITH {_TOK}, l AS (
      SELECT side, 'char' AS measure, length(text) AS x FROM tok
      UNION ALL SELECT side, 'word', len(toks) FROM tok),
    d AS (SELECT side, measure, unnest(['count', 'mean', 'std', 'min', 'q25', 'q50', 'q75', 'max'])
                 AS statistic,
                 unnest([count(*), avg(x), stddev_samp(x), min(x), quantile_cont(x, 0.25),
                         quantile_cont(x, 0.5), quantile_cont(x, 0.75), max(x)]::DOUBLE[]) AS v
          FROM l GROUP BY side, measure)
    SELECT measure, statistic, round(max(v) FILTER (side = 'a'), 6) AS value_a,
           round(max(v) FILTER (side = 'b'), 6) AS value_b,
           round(max(v) FILTER (side = 'b') - max(v) FILTER (side = 'a'), 6) + 0.0 AS delta
    FROM d GROUP BY measure, statistic""",
)
def length_drift(spark, folder):
    lengths = P.length_counts(_text_sides(spark, folder), label_col="side")
    drift = D.length_drift_of(lengths.withColumnRenamed("label", "side"))
    return drift.select(
        "measure", "statistic", *[r6(c).alias(c) for c in ("value_a", "value_b", "delta")]
    )


@query(
    "imbalance_drift",
    f"""WITH {_SIDES}, c AS (SELECT side, label, count(*) AS n FROM sides GROUP BY side, label),
    f AS (SELECT side, unnest(['num_classes', 'imbalance_ratio']) AS statistic,
                 unnest([count(*)::DOUBLE, max(n) / min(n)]) AS v FROM c GROUP BY side)
    SELECT statistic, round(max(v) FILTER (side = 'a'), 6) AS value_a,
           round(max(v) FILTER (side = 'b'), 6) AS value_b,
           round(max(v) FILTER (side = 'b') - max(v) FILTER (side = 'a'), 6) + 0.0 AS delta
    FROM f GROUP BY statistic""",
)
def imbalance_drift(spark, folder):
    drift = D.imbalance_drift_of(_sides(spark, folder))
    return drift.select(
        "statistic", *[r6(c).alias(c) for c in ("value_a", "value_b", "delta")]
    )


@query(
    "compare_metrics",
    f"""WITH {SOFTMAX}, o AS (
      SELECT truth, pred, row_number() OVER (ORDER BY md5('42-' || vec_id)) AS nr,
             count(*) OVER () AS n FROM pred),
    s AS (SELECT CASE WHEN nr <= ceil(0.2 * n) THEN 'test' ELSE 'eval' END AS split,
                 (truth = pred)::INT AS hit FROM o),
    v AS (SELECT avg(hit) FILTER (split = 'eval') AS a, avg(hit) FILTER (split = 'test') AS b FROM s)
    SELECT 'accuracy' AS metric, round(a, 6) AS value_a, round(b, 6) AS value_b,
           round(b - a, 6) + 0.0 AS delta FROM v""",
)
def compare_metrics(spark, folder):
    rows = scored(spark, folder).withColumn("pred", argmax(F.col("logits")))
    kept, test = split_exact(rows.select("vec_id", "truth", "pred"), 0.2, "vec_id")
    metrics = M.accuracy(kept, "truth", "pred").withColumn("split", F.lit("eval")).unionByName(
        M.accuracy(test, "truth", "pred").withColumn("split", F.lit("test"))
    )
    compared = D.compare_metrics(metrics, "eval", "test")
    return compared.select(
        "metric", *[r6(c).alias(c) for c in ("value_a", "value_b", "delta")]
    )


