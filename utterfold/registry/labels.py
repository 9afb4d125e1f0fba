"""Label algebra and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import MULTICLASS, MULTILABEL
from ..functions.ranking import decode_label
from ..operators import labels as L
from ..operators.split import split_exact
from .base import CORPUS, SPLIT, UNPACKED, big, corpus, joined, query, table, unpacked

_MAP = """map AS (
  SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id
  FROM (SELECT DISTINCT label FROM {0}))""".format

_HALF = "SELECT DISTINCT label FROM corpus WHERE NOT contains(label, 'toxic')"


@query("unpack_labels", f"WITH {UNPACKED} SELECT doc_id, label FROM unpacked")
def unpack(spark, folder):
    return unpacked(spark, folder).select("doc_id", "label")


@query(
    "unpack_labels_empty_for_null",
    """SELECT d.doc_id, unnest(string_split(coalesce(quality::VARCHAR, ''), '|')) AS label
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def unpack_empty(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id")
    rows = rows.join(table(spark, folder, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.col("quality").alias("label"))
    return L.unpack_labels(rows, delim="|", null_label="empty")


@query(
    "canonical_labels",
    f"""WITH {CORPUS}
    SELECT doc_id, array_to_string(list_sort(string_split(label, '+')), '+') AS label FROM corpus""",
)
def canonical(spark, folder):
    return corpus(spark, folder).select("doc_id", L.canonical_label(F.col("label")).alias("label"))


@query(
    "label_map",
    f"WITH {CORPUS}, {_MAP('corpus')} SELECT label, label_id::BIGINT AS label_id FROM map",
)
def label_map(spark, folder):
    return L.build_label_map(corpus(spark, folder)).select("label", *big("label_id"))


@query(
    "label_map_inverse",
    f"WITH {UNPACKED}, {_MAP('unpacked')} SELECT label_id::BIGINT AS label_id, label FROM map",
)
def label_map_inverse(spark, folder):
    inverse = L.invert_label_map(L.build_label_map(unpacked(spark, folder)))
    return inverse.select(*big("label_id"), "label")


def _partial_map(spark, folder):
    known = corpus(spark, folder).filter(~F.contains(F.col("label"), F.lit("toxic")))
    return L.build_label_map(known)


@query(
    "encode_multiclass",
    f"""WITH {CORPUS}, {_MAP("corpus")}
    SELECT doc_id, label, label_id::BIGINT AS labels FROM corpus JOIN map USING (label)""",
)
def encode_multiclass(spark, folder):
    rows = corpus(spark, folder).select("doc_id", "label")
    encoded = L.encode_multiclass(rows, L.build_label_map(rows))
    return encoded.select("doc_id", "label", *big("labels"))


@query(
    "encode_multiclass_given_map",
    f"""WITH {CORPUS}, {_MAP(f"({_HALF})")}
    SELECT doc_id, label_id::BIGINT AS labels FROM corpus JOIN map USING (label)""",
)
def encode_multiclass_given(spark, folder):
    rows = corpus(spark, folder).select("doc_id", "label")
    encoded = L.encode_multiclass(rows, _partial_map(spark, folder))
    return encoded.select("doc_id", *big("labels"))


@query(
    "unseen_labels",
    f"""WITH {CORPUS} SELECT label, count(*) AS n_rows FROM corpus
    WHERE label NOT IN ({_HALF}) GROUP BY label""",
)
def unseen_labels(spark, folder):
    return L.unseen_labels(corpus(spark, folder), _partial_map(spark, folder))


@query(
    "regroup_labels",
    f"""WITH {UNPACKED}
    SELECT text, array_to_string(list(DISTINCT label ORDER BY label), ',') AS label_list
    FROM unpacked GROUP BY text""",
)
def regroup_labels(spark, folder):
    grouped = L.regroup_labels(unpacked(spark, folder))
    return grouped.select("text", joined("label_list", ",").alias("label_list"))


@query(
    "regroup_labels_with_repeats",
    f"""WITH {UNPACKED}
    SELECT text, array_to_string(list(label ORDER BY label), ',') AS label_list
    FROM unpacked GROUP BY text""",
)
def regroup_with_repeats(spark, folder):
    grouped = L.regroup_labels(unpacked(spark, folder), repeats=True)
    whole = L.expand_repeats(F.col("label_list"), F.col("label_counts"))
    return grouped.select("text", joined(whole, ",").alias("label_list"))


_HOT = """hot AS (
  SELECT text, array_to_string(list_transform(range(k), lambda i:
           CASE WHEN list_contains(ids, i) THEN 1 ELSE 0 END), ',') AS labels
  FROM (SELECT text, list(label_id) AS ids FROM unpacked LEFT JOIN map USING (label)
        GROUP BY text), (SELECT count(*) AS k FROM map))"""


def _ints(col):
    return joined(F.transform(col, lambda x: x.cast("int")), ",")


@query(
    "encode_multilabel",
    f"WITH {UNPACKED}, {_MAP('unpacked')}, {_HOT} SELECT text, labels FROM hot",
)
def encode_multilabel(spark, folder):
    rows = unpacked(spark, folder)
    encoded = L.encode_multilabel(rows, L.build_label_map(rows))
    return encoded.select("text", _ints("labels").alias("labels"))


@query(
    "encode_multilabel_given_map",
    f"""WITH {UNPACKED}, {_MAP("(SELECT label FROM unpacked WHERE label NOT IN ('en', 'toxic'))")},
    {_HOT} SELECT text, labels FROM hot""",
)
def encode_multilabel_given(spark, folder):
    rows = unpacked(spark, folder)
    known = L.build_label_map(rows.filter(~F.col("label").isin("en", "toxic")))
    return L.encode_multilabel(rows, known).select("text", _ints("labels").alias("labels"))


@query(
    "decode_label",
    f"""WITH {UNPACKED}, {_MAP("unpacked")}
    SELECT vec_id, e.label::BIGINT AS label_id,
           coalesce(map.label, 'UNKNOWN_' || e.label) AS name
    FROM embeddings e LEFT JOIN map ON e.label = map.label_id""",
)
def decode(spark, folder):
    names = L.label_names(L.build_label_map(unpacked(spark, folder)))
    vectors = table(spark, folder, "embeddings").withColumn("names", names)
    return vectors.select(
        "vec_id",
        F.col("label").cast("bigint").alias("label_id"),
        decode_label(F.col("label"), F.col("names")).alias("name"),
    )


@query(
    "prepare_labels_multiclass",
    f"""WITH {CORPUS}, {_MAP("corpus")}
    SELECT text, label_id::BIGINT AS labels FROM corpus JOIN map USING (label)""",
)
def prepare_multiclass(spark, folder):
    prepared, _ = L.prepare_labels(corpus(spark, folder), MULTICLASS)
    return prepared.select("text", *big("labels"))


@query(
    "prepare_labels_multilabel",
    f"WITH {UNPACKED}, {_MAP('unpacked')}, {_HOT} SELECT text, labels FROM hot",
)
def prepare_multilabel(spark, folder):
    prepared, _ = L.prepare_labels(unpacked(spark, folder), MULTILABEL)
    return prepared.select("text", _ints("labels").alias("labels"))


@query(
    "split_exact",
    f"WITH {CORPUS}, {SPLIT} SELECT doc_id, label, side FROM sides",
)
def split(spark, folder):
    train, validation = split_exact(corpus(spark, folder).select("doc_id", "label"), 0.2, "doc_id")
    return train.withColumn("side", F.lit("a")).unionByName(
        validation.withColumn("side", F.lit("b"))
    )


@query(
    "split_ratio_zero",
    "SELECT doc_id, 'a' AS side FROM documents",
)
def split_zero(spark, folder):
    train, _ = split_exact(table(spark, folder, "documents").select("doc_id"), 0, "doc_id")
    return train.withColumn("side", F.lit("a"))
