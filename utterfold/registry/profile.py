"""Corpus profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import profile as P
from ..operators.ngrams import leading_ngrams, token_bags
from ..plans.profile_report import report_rows, run_profile
from ..session import cut_lineage
from .base import CLEANED, CORPUS, LENGTHS, ORACLES, WORDS, big, cleaned_texts, corpus, documents, query, r6
from .base import table, with_label


def _lengths(spark, folder):
    # lengths first, labels after: the join never carries text
    clean = T.clean_punct(F.col("text")).alias("text")
    measured = (
        documents(spark, folder)
        .select("doc_id", "lang", clean)
        .select("doc_id", "lang", *P.text_lengths(F.col("text")))
    )
    return P.count_lengths(with_label(spark, folder, measured))


def _terms(spark, folder):
    return P.term_counts(cleaned_texts(spark, folder), "doc_id")


def _kept(spark, folder):
    return P.without_stopwords(_terms(spark, folder))


@query(
    "profile_shape",
    """SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS "column",
              unnest(['bigint', 'string', 'string', 'string', 'bigint']) AS type,
              unnest([0, 1, 2, 3, 4]) AS position, n_rows, 5 AS n_columns
    FROM (SELECT count(*) AS n_rows FROM documents)""",
)
def shape(spark, folder):
    return P.profile_shape(table(spark, folder, "documents"))


@query(
    "profile_missing",
    """WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS n_missing FROM j
    UNION ALL SELECT 'quality', count(*) - count(quality) FROM j
    UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM j""",
)
def missing(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id")
    return P.profile_missing(rows.join(table(spark, folder, "labels"), "doc_id", "left"))


@query("head", f"WITH {CORPUS} SELECT doc_id, text, label FROM corpus ORDER BY doc_id LIMIT 5")
def head(spark, folder):
    return P.head(corpus(spark, folder), "doc_id")


@query(
    "label_distribution",
    f"WITH {CORPUS} SELECT label, count(*) AS n FROM corpus GROUP BY label",
)
def label_distribution(spark, folder):
    return P.label_distribution(corpus(spark, folder))


@query("num_classes", f"WITH {CORPUS} SELECT count(DISTINCT label) AS num_classes FROM corpus")
def num_classes(spark, folder):
    return P.num_classes(corpus(spark, folder))


@query(
    "imbalance",
    f"""WITH {CORPUS}, c AS (SELECT count(*) AS n FROM corpus GROUP BY label)
    SELECT max(n) AS max_n, min(n) AS min_n, round(max(n) / min(n), 6) AS imbalance_ratio,
           max(n) / min(n) > 10 AS imbalanced FROM c""",
)
def imbalance(spark, folder):
    return P.imbalance(corpus(spark, folder)).withColumn("imbalance_ratio", r6("imbalance_ratio"))


@query(
    "length_counts",
    f"""WITH {LENGTHS}
    SELECT label, measure, length::BIGINT AS length, count(*) AS n FROM lengths GROUP BY ALL""",
)
def length_counts(spark, folder):
    return _lengths(spark, folder).select("label", "measure", *big("length"), "n")


@query(
    "describe_length",
    f"""WITH {LENGTHS}
    SELECT measure, count(*) AS "count", round(avg(length), 6) AS mean,
           round(stddev_samp(length), 6) AS std, min(length)::BIGINT AS "min",
           quantile_cont(length, 0.25) AS q25, quantile_cont(length, 0.5) AS q50,
           quantile_cont(length, 0.75) AS q75, max(length)::BIGINT AS "max"
    FROM lengths GROUP BY measure""",
)
def describe_length(spark, folder):
    described = P.describe_length(_lengths(spark, folder))
    return described.select(
        "measure", "count", r6("mean").alias("mean"), r6("std").alias("std"), *big("min"),
        "q25", "q50", "q75", *big("max"),
    )


@query(
    "length_histogram",
    f"""WITH {LENGTHS}, b AS (
      SELECT measure, min(length) AS lo, max(length) AS hi FROM lengths GROUP BY measure),
    h AS (SELECT measure, least(((length - lo) * 50) // (hi - lo), 49) AS bin, count(*) AS n
          FROM lengths JOIN b USING (measure) GROUP BY 1, 2),
    g AS (SELECT measure, lo, hi, unnest(range(50)) AS bin FROM b)
    SELECT g.measure, g.bin, round(lo + (hi - lo) * g.bin / 50, 6) AS bin_start,
           round(lo + (hi - lo) * (g.bin + 1) / 50, 6) AS bin_end, coalesce(n, 0) AS n
    FROM g LEFT JOIN h ON g.measure = h.measure AND g.bin = h.bin""",
)
def length_histogram(spark, folder):
    return P.length_histogram(_lengths(spark, folder)).select(
        "measure", *big("bin"), r6("bin_start").alias("bin_start"), r6("bin_end").alias("bin_end"),
        "n",
    )


@query(
    "corpus_tokens",
    f"""WITH {WORDS} SELECT doc_id AS row_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms
    FROM kept GROUP BY doc_id""",
)
def corpus_tokens(spark, folder):
    bag = P.corpus_tokens(cleaned_texts(spark, folder), "doc_id")
    return bag.groupBy("row_id").agg(
        F.count("*").alias("n_tokens"), F.count_distinct("token").alias("n_terms")
    )


@query("vocab_size", f"WITH {WORDS} SELECT count(DISTINCT term) AS vocab_size FROM kept")
def vocab_size(spark, folder):
    return P.vocab_size(_kept(spark, folder))


@query(
    "approx_vocab_size",
    f"WITH {WORDS} SELECT count(DISTINCT term) AS vocab_size, true AS within_five_percent FROM kept",
)
def approx_vocab_size(spark, folder):
    """The estimate itself has no SQL; its distance from the exact size has."""
    estimate = P.approx_vocab_size(cleaned_texts(spark, folder), "doc_id")
    exact = P.vocab_size(_kept(spark, folder))
    close = F.abs(exact.scalar() - F.col("approx_vocab_size")) <= exact.scalar() * 0.05
    return estimate.select(
        exact.scalar().alias("vocab_size"), close.alias("within_five_percent")
    )


_TERMS = f"""{WORDS}, terms AS (
  SELECT term, count(*) AS n, min((doc_id, pos)) AS seen FROM kept GROUP BY term)"""


@query(
    "term_counts",
    f"WITH {WORDS} SELECT term, count(*) AS n, term IN (SELECT term FROM bag EXCEPT "
    "SELECT term FROM kept) AS is_stopword FROM bag GROUP BY term",
)
def term_counts(spark, folder):
    return _terms(spark, folder).select("term", "n", "is_stopword")


@query(
    "top_terms",
    f"""WITH {_TERMS} SELECT row_number() OVER (ORDER BY n DESC, seen) AS rank, term, n
    FROM terms ORDER BY n DESC, seen LIMIT 25""",
)
def top_terms(spark, folder):
    return P.top_terms(_kept(spark, folder)).select(*big("rank"), "term", "n")


@query(
    "rare_terms",
    f"""WITH {_TERMS} SELECT row_number() OVER (ORDER BY n, seen DESC) AS rank, term, n
    FROM terms ORDER BY n, seen DESC LIMIT 25""",
)
def rare_terms(spark, folder):
    return P.rare_terms(_kept(spark, folder)).select(*big("rank"), "term", "n")


def _gram_sql(n: int, source: str = "kept") -> str:
    parts = " || ' ' || ".join(f"t[i + {j}]" if j else "t[i]" for j in range(n))
    return f"""WITH {WORDS}, seqs AS (
      SELECT doc_id, list(term ORDER BY pos) AS t FROM {source} GROUP BY doc_id),
    starts AS (SELECT doc_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM seqs),
    grams AS (SELECT doc_id, i, {parts} AS term FROM starts),
    terms AS (SELECT term, count(*) AS n, min((doc_id, i)) AS seen FROM grams GROUP BY term)
    SELECT row_number() OVER (ORDER BY n DESC, seen) AS rank, term, n
    FROM terms ORDER BY n DESC, seen LIMIT 25"""


def _grams(spark, folder, n, remove_stopwords=True):
    bags = token_bags(cleaned_texts(spark, folder), "doc_id", remove_stopwords=remove_stopwords)
    return leading_ngrams(bags, [n]).select(*big("rank"), "term", "n")


@query("top_bigrams", _gram_sql(2))
def top_bigrams(spark, folder):
    return _grams(spark, folder, 2)


@query("top_trigrams", _gram_sql(3))
def top_trigrams(spark, folder):
    return _grams(spark, folder, 3)


@query("top_bigrams_with_stopwords", _gram_sql(2, "bag"))
def top_bigrams_with_stopwords(spark, folder):
    return _grams(spark, folder, 2, remove_stopwords=False)


@query(
    "mean_length_by_class",
    f"""WITH {LENGTHS} SELECT label, round(avg(length), 6) AS mean_words FROM lengths
    WHERE measure = 'word' GROUP BY label""",
)
def mean_length_by_class(spark, folder):
    means = P.mean_length_by_class(_lengths(spark, folder))
    return means.withColumn("mean_words", r6("mean_words"))


_LEADING = """biggest AS (
  SELECT label, count(*) AS n FROM corpus GROUP BY label ORDER BY n DESC, label LIMIT {0})""".format


@query(
    "top_classes",
    f"""WITH {CORPUS}, {_LEADING(5)}
    SELECT doc_id, label FROM corpus WHERE label IN (SELECT label FROM biggest)""",
)
def top_classes(spark, folder):
    return P.top_classes(corpus(spark, folder).select("doc_id", "label"), k=5)


@query(
    "class_order_many",
    f"""WITH {CORPUS}, {_LEADING(5)}
    SELECT row_number() OVER (ORDER BY n DESC, label) AS position, label FROM biggest""",
)
def class_order_many(spark, folder):
    return P.class_order(corpus(spark, folder), k=5).select(*big("position"), "label")


@query(
    "class_order_few",
    f"""WITH {CORPUS}
    SELECT row_number() OVER (ORDER BY label) AS position, label
    FROM (SELECT DISTINCT label FROM corpus)""",
)
def class_order_few(spark, folder):
    return P.class_order(corpus(spark, folder), k=20).select(*big("position"), "label")


@query(
    "length_box_by_class",
    f"""WITH {LENGTHS}, top AS (
      SELECT label FROM corpus GROUP BY label ORDER BY count(*) DESC, label LIMIT 20),
    box AS (
      SELECT label, measure, count(*) AS "count", min(length) AS mn, max(length) AS mx,
             quantile_cont(length, 0.25) AS q25, quantile_cont(length, 0.5) AS q50,
             quantile_cont(length, 0.75) AS q75
      FROM lengths WHERE label IN (SELECT label FROM top) GROUP BY label, measure),
    fence AS (
      SELECT label, measure,
             min(length) FILTER (length >= q25 - 1.5 * (q75 - q25)) AS low,
             max(length) FILTER (length <= q75 + 1.5 * (q75 - q25)) AS high,
             count(*) FILTER (length < q25 - 1.5 * (q75 - q25)
                              OR length > q75 + 1.5 * (q75 - q25)) AS n_outliers
      FROM lengths JOIN box USING (label, measure) GROUP BY label, measure)
    SELECT label, measure, "count", mn::BIGINT AS "min", q25, q50, q75, mx::BIGINT AS "max",
           least(low::DOUBLE, q25) AS whisker_low, greatest(high::DOUBLE, q75) AS whisker_high,
           n_outliers
    FROM box JOIN fence USING (label, measure)""",
)
def length_box_by_class(spark, folder):
    # read twice: for the leading classes and for the boxes
    box = P.length_box_by_class(cut_lineage(_lengths(spark, folder)))
    return box.select(
        "label", "measure", "count", *big("min"), "q25", "q50", "q75", *big("max"),
        "whisker_low", "whisker_high", *big("n_outliers"),
    )


def _zipf_sql(source: str) -> str:
    return f"""WITH {WORDS}, f AS (SELECT count(*) AS frequency FROM {source} GROUP BY term)
    SELECT row_number() OVER (ORDER BY frequency DESC) AS rank, frequency,
           max(frequency) OVER () / row_number() OVER (ORDER BY frequency DESC) AS ideal
    FROM f"""


@query("zipf", _zipf_sql("bag"))
def zipf(spark, folder):
    return P.zipf(_terms(spark, folder))


@query("zipf_without_stopwords", _zipf_sql("kept"))
def zipf_without_stopwords(spark, folder):
    return P.zipf(_kept(spark, folder))


@query(
    "frequency_range",
    f"""WITH {WORDS}, f AS (SELECT count(*) AS n FROM bag GROUP BY term)
    SELECT count(*) AS n_terms, max(n) AS max_frequency, min(n) AS min_frequency FROM f""",
)
def frequency_range(spark, folder):
    return P.frequency_range(_terms(spark, folder))


@query(
    "frequency_ranks",
    f"""WITH {WORDS}, f AS (SELECT count(*) AS n FROM bag GROUP BY term),
    g AS (SELECT n AS frequency, count(*) AS n_terms FROM f GROUP BY n)
    SELECT frequency, n_terms,
           (sum(n_terms) OVER (ORDER BY frequency DESC) - n_terms + 1)::BIGINT AS rank_from,
           (sum(n_terms) OVER (ORDER BY frequency DESC))::BIGINT AS rank_to FROM g""",
)
def frequency_ranks(spark, folder):
    return P.frequency_ranks(_terms(spark, folder))


def _long_sql(analysis: str, oracle: str, keys: list[str], figures: list[str]) -> str:
    key = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
    items = ", ".join(
        f"{{'figure': '{f}', 'value': CAST({f} AS DOUBLE)}}".replace(f"CAST({f}", f'CAST("{f}"')
        for f in figures
    )
    return f"""SELECT '{analysis}' AS analysis, key, item.figure AS figure,
        round(item.value, 6) + 0.0 AS value
    FROM (SELECT {key} AS key, unnest([{items}]) AS item FROM ({oracle}))"""


_BOX = ["count", "min", "q25", "q50", "q75", "max", "whisker_low", "whisker_high", "n_outliers"]
_REPORT_SQL = " UNION ALL ".join(
    [
        """SELECT 'shape' AS analysis, c.k AS key, f.figure AS figure, f.value AS value
        FROM (SELECT count(*)::DOUBLE AS n FROM documents),
             (SELECT unnest([{'k': 'doc_id|bigint', 'p': 0}, {'k': 'text|string', 'p': 1},
                             {'k': 'label|string', 'p': 2}]) AS c),
             LATERAL (SELECT unnest([{'figure': 'position', 'value': c.p::DOUBLE},
                                     {'figure': 'n_rows', 'value': n},
                                     {'figure': 'n_columns', 'value': 3.0::DOUBLE}]) AS f)""",
        """SELECT 'missing_values', unnest(['doc_id', 'text', 'label']), 'n_missing', 0.0""",
        f"""SELECT 'head', unnest([concat_ws('|', p, 'doc_id', doc_id), concat_ws('|', p, 'text', text),
                                   concat_ws('|', p, 'label', label)]), 'position', p
        FROM (WITH {CLEANED} SELECT doc_id, text, label, row_number() OVER (ORDER BY doc_id) - 1 AS p
              FROM cleaned ORDER BY doc_id LIMIT 5)""",
    ]
    + [
        _long_sql(analysis, ORACLES[oracle], keys, figures)
        for analysis, oracle, keys, figures in [
            ("target_distribution", "label_distribution", ["label"], ["n"]),
            ("num_classes", "num_classes", [], ["num_classes"]),
            ("imbalance", "imbalance", [], ["max_n", "min_n", "imbalance_ratio", "imbalanced"]),
            ("length_stats", "describe_length", ["measure"],
             ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
            ("length_histogram", "length_histogram", ["measure", "bin"],
             ["bin_start", "bin_end", "n"]),
            ("vocabulary_size", "vocab_size", [], ["vocab_size"]),
            ("most_common_words", "top_terms", ["term"], ["rank", "n"]),
            ("least_common_words", "rare_terms", ["term"], ["rank", "n"]),
            ("most_common_2grams", "top_bigrams", ["term"], ["rank", "n"]),
            ("most_common_3grams", "top_trigrams", ["term"], ["rank", "n"]),
            ("avg_word_length_by_class", "mean_length_by_class", ["label"], ["mean_words"]),
            ("length_box_by_class", "length_box_by_class", ["label", "measure"], _BOX),
            ("zipf_stopwords_included", "zipf", ["rank"], ["frequency", "ideal"]),
            ("zipf_stopwords_removed", "zipf_without_stopwords", ["rank"], ["frequency", "ideal"]),
            ("frequency_range", "frequency_range", [],
             ["n_terms", "max_frequency", "min_frequency"]),
        ]
    ]
)


@query("profile_report", _REPORT_SQL)
def profile_report(spark, folder):
    """Every row of every analysis of the full profile."""
    report = run_profile(corpus(spark, folder, documents(spark, folder)), "doc_id")
    return report_rows(report).withColumn("value", r6("value"))
