"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
Every query runs once to warm up and then BENCH_RUNS times (default 3); the
median counts. Results are computed in full and thrown away.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from utterfold.config import MULTICLASS  # noqa: E402
from utterfold.operators import labels as L  # noqa: E402
from utterfold.operators.model import fit_multiclass, score  # noqa: E402
from utterfold.registry import QUERIES  # noqa: E402
from utterfold.registry.base import documents  # noqa: E402
from utterfold.session import build_session  # noqa: E402

HEADLINE = (
    "clean_basic",
    "clean_punct",
    "tokens",
    "unpack_labels",
    "load_corpus_unpacked",
    "label_map",
    "encode_multiclass",
    "regroup_labels",
    "encode_multilabel",
    "split_exact",
    "label_distribution",
    "describe_length",
    "length_histogram",
    "length_box_by_class",
    "vocab_size",
    "top_terms",
    "rare_terms",
    "top_bigrams",
    "top_trigrams",
    "zipf",
    "profile_report",
    "label_drift",
    "vocab_drift",
    "rank_predictions",
    "top_three",
    "predict_table_multilabel",
    "precision_recall_f1",
    "roc_auc_ovr",
    "roc_auc",
    "average_precision",
    "compute_metrics_multiclass",
    "compute_metrics_multilabel",
    "select_best",
    "early_stop_epoch",
    "export_training_set_multilabel",
    "stream_corpus",
    "score_stream_with_user_scorer",
)


def finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_time(action, runs: int) -> float:
    action()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 4)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]",
        "utterfold-bench",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {
        name: median_time(lambda query=QUERIES[name]: finish(query(spark, folder)), runs)
        for name in HEADLINE
    }

    rows = documents(spark, folder).select("doc_id", "text", F.col("lang").alias("label"))
    label_map = L.build_label_map(rows)
    train = L.encode_multiclass(rows, label_map)
    start = time.perf_counter()
    model = fit_multiclass(train, label_map)
    seconds[f"fit_{MULTICLASS}"] = round(time.perf_counter() - start, 4)
    seconds["score_fitted_model"] = median_time(lambda: finish(score(rows, model)), runs)
    n_rows = rows.count()
    found = re.search(r"sf([0-9.]+)", folder)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": {
            "load_unpack_clean": round(n_rows / seconds["load_corpus_unpacked"]),
            "regroup_multi_hot": round(n_rows / seconds["encode_multilabel"]),
            "tokens": round(n_rows / seconds["tokens"]),
            "score_fitted_model": round(n_rows / seconds["score_fitted_model"]),
        },
        "sf": float(found.group(1)) if found else None,
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    with contextlib.suppress(BrokenPipeError):
        main()
