"""Secrets in texts: candidates, and a random forest that removes the false ones.

A candidate is a long run of the characters that keys are written in. Most are no
secrets but long words, paths or numbers. A forest trained on labelled findings tells
them apart by length, the classes and transitions of their characters, how likely these
transitions are in the corpus's own words, how much of them dictionary words cover,
the path they were found under, and the words around them.

Everything runs as DataFrame operations and MLlib in the JVM.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.ml.classification import (
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import full_text, stage

#: Least characters of a candidate.
LEAST = 16
#: Characters of context on either side.
CONTEXT = 40
#: The most frequent words that count as dictionary, a top-k of the corpus.
DICTIONARY = 200
#: At most so many labelled findings train a forest, half of them of either class.
TRAIN_FINDINGS = 20_000
TREES, DEPTH = 20, 6

_RUN = r"[^A-Za-z0-9+/_=.\-]"
_KEY_WORD = r"(?i)(token|secret|passw|pwd|key|auth|credential|bearer)\w*\W*$"
_TRIAL_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"
FEATURES = [
    "length", "digits", "upper", "symbols", "distinct", "changes", "hex", "transitions",
    "dictionary", "path_depth", "trial_path", "own_slashes", "key_word", "assigned",
    "quoted", "left_words", "right_words",
]


def _runs(text: Column) -> Column:
    return F.split(text, _RUN, -1)


def candidates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source"
) -> DataFrame:
    """``doc_id, path, start, candidate, left, right``: every long run with its context.

    ``start`` counts characters from 0. Null texts hold none, a null path is empty. Rows
    that repeat give repeated findings. Other columns are ignored.
    """
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    texts = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), path.alias("path"), full_text(text_col).alias("text")
    ).where(F.col("text").rlike(rf"[A-Za-z0-9+/_=.\-]{{{LEAST},}}"))
    runs = texts.withColumn("runs", _runs(F.col("text")))
    long = F.filter(
        F.sequence(F.lit(0), F.size("runs") - 1),
        lambda i: F.char_length(F.get("runs", i)) >= LEAST,
    )
    found = runs.select("doc_id", "path", "text", "runs", F.explode(long).alias("i"))
    start = F.aggregate(
        F.slice("runs", F.lit(1), F.col("i")), F.lit(0), lambda s, r: s + F.char_length(r) + 1
    )
    found = found.select(
        "doc_id", "path", "text", F.get("runs", F.col("i")).alias("candidate"), start.alias("start")
    )
    size = F.char_length("candidate")
    return found.select(
        "doc_id",
        "path",
        "start",
        "candidate",
        F.substring(
            "text",
            F.greatest(F.col("start") - CONTEXT, F.lit(0)) + 1,
            F.least(F.col("start"), F.lit(CONTEXT)),
        ).alias("left"),
        F.substring("text", F.col("start") + size + 1, F.lit(CONTEXT)).alias("right"),
    )


@dataclasses.dataclass(frozen=True)
class Lexicon:
    """Dictionary words, and log probabilities of letter pairs: both of bounded size."""

    words: list[str]
    pairs: dict[str, float]


def learn_lexicon(docs: DataFrame, text_col: str = "text") -> Lexicon:
    """From the words of all documents: the most frequent, and their letter transitions."""
    words = (
        docs.select(F.explode(_runs(full_text(text_col))).alias("w"))
        .where(F.col("w").rlike("^[A-Za-z]{2,15}$"))
        .groupBy(F.lower("w").alias("w"))
        .agg(F.count("*").alias("n"))
    )
    words = stage(words, "vocabulary")
    top = words.where(F.char_length("w") > 2).orderBy(F.desc("n"), "w").limit(DICTIONARY)
    letters = words.select(
        "n",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.char_length("w") - 1), lambda i: F.substring("w", i, F.lit(2))
            )
        ).alias("pair"),
    )
    # at most 26 times 26 rows
    counted = letters.groupBy("pair").agg(F.sum("n").cast("double").alias("n"))
    rows = counted.collect()
    totals: dict[str, float] = {}
    for row in rows:
        totals[row["pair"][0]] = totals.get(row["pair"][0], 0.0) + row["n"]
    pairs = {
        r["pair"]: math.log((r["n"] + 1) / (totals[r["pair"][0]] + 26)) for r in rows
    }
    return Lexicon([r["w"] for r in top.collect()], pairs)


def _share(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")) / F.char_length("candidate")


def with_features(found: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Add the columns of ``FEATURES``."""
    c = F.col("candidate")
    lower = F.lower(c)
    n = F.char_length(c)
    floor = -8.0
    pairs = sorted(lexicon.pairs.items())
    table = F.map_from_arrays(
        F.array(*[F.lit(p) for p, _ in pairs]), F.array(*[F.lit(v) for _, v in pairs])
    ) if pairs else F.create_map(F.lit(""), F.lit(0.0))
    likely = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.coalesce(
                F.try_element_at(table, F.substring(lower, i, F.lit(2))), F.lit(floor)
            ),
        ),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    by_length = sorted(lexicon.words, key=lambda w: (-len(w), w))
    known = f"({'|'.join(by_length)})" if by_length else "(?!)"
    changes = F.regexp_count(
        c, F.lit(r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])")
    )
    columns = {
        "length": n,
        "digits": _share(c, "[^0-9]"),
        "upper": _share(c, "[^A-Z]"),
        "symbols": _share(c, "[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "changes": changes / n,
        "hex": c.rlike("^[0-9a-fA-F]+$"),
        "transitions": likely / (n - 1),
        "dictionary": F.lit(1.0) - _share(lower, known),
        "path_depth": F.regexp_count("path", F.lit("/")),
        "trial_path": F.col("path").rlike(_TRIAL_PATH),
        "own_slashes": F.regexp_count(c, F.lit("[/.]")),
        "key_word": F.col("left").rlike(_KEY_WORD),
        "assigned": F.col("left").rlike(r"[=:]\s*[\"']?$"),
        "quoted": F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']"),
        "left_words": F.regexp_count("left", F.lit(r"\w+")),
        "right_words": F.regexp_count("right", F.lit(r"\w+")),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def fit_forest(
    labelled: DataFrame, findings: int = TRAIN_FINDINGS, seed: int = 0
) -> RandomForestClassificationModel | None:
    """A forest on findings with features and ``label`` 0 or 1; None without both classes.

    At most ``findings`` train it, half of either class, in the order of a hash. Null
    labels do not count.
    """
    half = max(1, findings // 2)
    order = F.xxhash64(F.lit(seed), "doc_id", "start", "candidate")
    columns = [*FEATURES, F.col("label").cast("double").alias("label")]
    parts = [
        labelled.where(F.col("label") == v).orderBy(order, "doc_id", "start").limit(half)
        for v in (0, 1)
    ]
    train = stage(parts[0].union(parts[1]).select(*columns), "findings")
    if train.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return forest.fit(vectors.select("label", "features"))


def score_findings(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Add ``score`` and ``is_secret``; without a model every candidate stays, at one half."""
    if model is None:
        scored = found.withColumn("score", F.lit(0.5))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(found)
        out = model.setFeaturesCol("_features").transform(vectors)
        scored = out.select(*found.columns, vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


def rule_labels(found: DataFrame) -> DataFrame:
    """Add ``label`` where no reviewer has been: 1 for a quoted value with several digits that
    is assigned to a key word, else 0. A weak label, for corpora without labelled findings.
    """
    named = F.col("left").rlike("(?i)(token|secret|password|api_?key)\\s*[=:]\\s*[\"']$")
    digits = F.regexp_count("candidate", F.lit("[0-9]")) >= 4
    return found.withColumn("label", (named & digits).cast("int"))


def scan(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    held_out: Column | None = None,
) -> DataFrame:
    """``doc_id, start, candidate, left, right, label, score, is_secret`` and the features.

    ``labels`` has ``doc_id, start, label`` of findings that were judged, one row each;
    without it ``rule_labels`` judges. Findings for which ``held_out`` (on ``doc_id``) holds
    train nothing. Null texts hold no findings, an empty table gives an empty result, rows
    that repeat give repeated findings, columns besides the three named are ignored.
    """
    found = candidates(docs, id_col, text_col, path_col)
    found = with_features(found, learn_lexicon(docs, text_col))
    if labels is None:
        found = rule_labels(found)
    else:
        judged = labels.groupBy("doc_id", "start").agg(F.max("label").alias("label"))
        found = found.join(judged, ["doc_id", "start"], "left")
    found = stage(found, "candidates")
    train = found if held_out is None else found.where(~held_out)
    return score_findings(found, fit_forest(train))
