"""Readers and writers, checked by writing the driver tables out and reading them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import MULTICLASS, MULTILABEL, CorpusConfig

from ..operators import labels as L
from ..operators import metrics as M
from ..operators import profile as P
from ..operators.batches import map_batches
from ..operators.split import split_exact
from ..plans.prepare import load_corpus
from ..session import scratch_path
from ..sources import files, sinks
from ..streaming.corpus import stream_corpus
from .base import CLEANED, CORPUS, MULTILABEL as ML, SPLIT, big, cleaned, corpus, joined, query, r6, scored
from .base import scored_multilabel, sql_clean_basic
from .labels import _HOT, _MAP
from .metrics import _CLASSES, _ACCURACY, _wanted
from .scores import _NAME, _NAMES
from ..operators.scoring import names_array, predict_table

# Texts as they are, line breaks and all; the two readers differ in what is missing.
_ROWS = f"WITH {CORPUS} SELECT nullif(text, '') AS text, label FROM corpus"
_REQUESTED = f"WITH {CORPUS} SELECT coalesce(text, '') AS text, label FROM corpus"


def _written(spark, folder, kind, header):
    """The corpus as delimited or JSON files; returns their folder."""
    path = scratch_path(spark, kind)
    rows = corpus(spark, folder).select("text", "label")
    if kind == "json":
        rows.write.json(path)
    else:
        options = files.csv_options(files.SEPARATORS[kind])
        rows.write.options(**options).option("header", header).csv(path)
    return path


@query("read_tsv", _ROWS)
def read_tsv(spark, folder):
    path = _written(spark, folder, "tsv", header=False)
    return files.read_corpus(spark, path, "tsv", ["text", "label"])


@query("read_csv_with_header", _ROWS)
def read_csv(spark, folder):
    return files.read_corpus(spark, _written(spark, folder, "csv", header=True), "csv")


@query("read_json_lines", f"WITH {CORPUS} SELECT text, label FROM corpus")
def read_json(spark, folder):
    path = scratch_path(spark, "json")
    corpus(spark, folder).select("text", "label").write.json(path)
    return files.read_corpus(spark, path, "json", ["text", "label"])


@query(
    "load_corpus_unpacked",
    f"""WITH {CLEANED}
    SELECT {sql_clean_basic("text")} AS text, unnest(string_split(label, '+')) AS label FROM corpus""",
)
def load_unpacked(spark, folder):
    path = _written(spark, folder, "tsv", header=False)
    config = CorpusConfig(
        path, columns=["text", "label"], file_type="tsv", task=MULTILABEL, unpack=True
    )
    return load_corpus(spark, config)


@query("read_scoring_input", _REQUESTED)
def read_scoring_input(spark, folder):
    return files.read_scoring_input(spark, _written(spark, folder, "csv", header=True))


@query("stream_corpus", _ROWS)
def stream(spark, folder):
    """The files of a folder through a stream that ends when all are read."""
    source = _written(spark, folder, "tsv", header=False)
    target = scratch_path(spark, "streamed")
    rows = stream_corpus(spark, source, ["text", "label"], "tsv", max_files_per_trigger=2)
    run = (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema("text string, label string").parquet(target)


@query(
    "write_predictions",
    f"""WITH {ML}, named AS (SELECT *, {_NAME} AS name FROM mlp)
    SELECT vec_id::VARCHAR AS vec_id,
           to_json(coalesce(list(name ORDER BY c) FILTER (p = 1), []))::VARCHAR AS predicted_labels
    FROM named GROUP BY vec_id""",
)
def write_predictions(spark, folder):
    path = scratch_path(spark, "predictions")
    rows = scored_multilabel(spark, folder).drop("truth")
    sinks.write_predictions(predict_table(rows, MULTILABEL, names_array(_NAMES)), path)
    return spark.read.options(**files.csv_options(",")).option("header", True).csv(path)


@query(
    "label_map_saved_and_loaded",
    f"WITH {CORPUS}, {_MAP('corpus')} SELECT label, label_id::BIGINT AS label_id FROM map",
)
def label_map_round_trip(spark, folder):
    path = scratch_path(spark, "label-map")
    sinks.save_label_map(L.build_label_map(corpus(spark, folder)), path)
    return sinks.load_label_map(spark, path).select("label", *big("label_id"))


@query(
    "metrics_saved_and_merged",
    f"""WITH {_CLASSES}, v AS ({_wanted(_ACCURACY, "tot")})
    SELECT 'run' AS run_id, split, metric, value FROM v, (SELECT unnest(['eval', 'test']) AS split)""",
)
def metrics_round_trip(spark, folder):
    from ..functions.vectors import argmax

    path = scratch_path(spark, "metrics")
    rows = scored(spark, folder).withColumn("pred", argmax(F.col("logits")))
    metrics = M.accuracy(rows, "truth", "pred")
    for split in ("eval", "test"):
        sinks.save_metrics(metrics, "run", split, path)
    merged = sinks.load_metrics(spark, path)
    return merged.select("run_id", "split", "metric", r6("value").alias("value"))


@query(
    "profile_saved",
    f"WITH {CORPUS} SELECT label, count(*) AS n, 'train' AS split FROM corpus GROUP BY label",
)
def profile_round_trip(spark, folder):
    path = scratch_path(spark, "profile")
    profile = {"target_distribution": P.label_distribution(corpus(spark, folder))}
    sinks.save_profile(profile, "train", path)
    return spark.read.parquet(f"{path}/target_distribution").select("label", "n", "split")


@query(
    "export_training_set_multiclass",
    f"""WITH {CORPUS}, {SPLIT}, {_MAP("corpus")}
    SELECT text, label_id::BIGINT AS labels,
           CASE side WHEN 'a' THEN 'train' ELSE 'validation' END AS split
    FROM sides JOIN map USING (label)""",
)
def export_multiclass(spark, folder):
    path = scratch_path(spark, "training-set")
    rows = corpus(spark, folder)
    label_map = L.build_label_map(rows)
    encoded = L.encode_multiclass(rows, label_map)
    train, validation = split_exact(encoded, 0.2, "doc_id")
    sinks.export_training_set(
        {"train": train, "validation": validation}, path, MULTICLASS, label_map.count()
    )
    return sinks.load_training_set(spark, path).select("text", *big("labels"), "split")


@query(
    "export_training_set_multilabel",
    f"""WITH {CORPUS}, unpacked AS (
      SELECT text, unnest(string_split(label, '+')) AS label FROM corpus),
    {_MAP("unpacked")}, {_HOT} SELECT text, labels, 'train' AS split FROM hot""",
)
def export_multilabel(spark, folder):
    path = scratch_path(spark, "training-set")
    rows = L.unpack_labels(corpus(spark, folder))
    label_map = L.build_label_map(rows)
    encoded = L.encode_multilabel(rows, label_map)
    sinks.export_training_set({"train": encoded}, path, MULTILABEL, label_map.count())
    stored = sinks.load_training_set(spark, path)
    as_text = joined(F.transform("labels", lambda x: x.cast("int")), ",")
    return stored.select("text", as_text.alias("labels"), "split")


@query(
    "map_batches",
    "SELECT doc_id, length(text)::BIGINT AS n FROM documents",
)
def batches(spark, folder):
    rows = corpus(spark, folder).select("doc_id", "text")

    def lengths(frame):
        return frame.assign(n=frame["text"].str.len())[["doc_id", "n"]]

    return map_batches(rows, lengths, "doc_id bigint, n bigint", batch_size=100)
