"""Writing predictions, label maps, metrics, profiles and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MULTICLASS, check_task
from ..operators.labels import bounded_map
from .files import csv_options


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").options(**csv_options(",")).option(
        "header", True
    ).csv(path)


def save_label_map(label_map: DataFrame, path: str) -> None:
    """Labels and ids as JSON rows; ids stay numbers and serve both directions."""
    label_map.select("label", "label_id").write.mode("overwrite").json(path)


def load_label_map(spark: SparkSession, path: str, max_labels: int | None = None) -> DataFrame:
    """The saved map; with ``max_labels`` a longer one is an error."""
    stored = spark.read.schema("label string, label_id int").json(path)
    return stored if max_labels is None else bounded_map(stored, max_labels)


def save_metrics(metrics: DataFrame, run_id: str, split: str, path: str) -> None:
    """Put ``metric, value`` into the long table ``run_id, split, metric, value``.

    A run and split that is there already is replaced.
    """
    metrics.select(
        F.lit(run_id).alias("run_id"),
        "metric",
        F.col("value").cast("double").alias("value"),
        F.lit(split).alias("split"),
    ).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_id", "split"
    ).parquet(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All splits merged: ``run_id, split, metric, value``."""
    stored = spark.read.schema("run_id string, metric string, value double, split string")
    return stored.parquet(path).select("run_id", "split", "metric", "value")


def save_profile(profile: dict[str, DataFrame], split: str, path: str) -> None:
    """One Parquet table per analysis, below ``split=...``."""
    for name, table in profile.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/split={split}")


def training_rows(
    df: DataFrame, task: str, num_labels: int, text_col: str = "text"
) -> DataFrame:
    """``(text, labels)`` in the declared types; a label out of range fails the query.

    Labels are a class id below ``num_labels`` or a float vector of that length.
    """
    check_task(task)
    text = F.col(text_col).cast("string").alias(text_col)
    if task == MULTICLASS:
        labels = F.col("labels").cast("int")
        valid = (labels >= 0) & (labels < num_labels)
    else:
        labels = F.col("labels").cast("array<float>")
        valid = F.size(labels) == num_labels
    checked = F.when(valid, labels).otherwise(
        F.raise_error(F.lit(f"labels do not fit {num_labels} classes")).cast(
            "int" if task == MULTICLASS else "array<float>"
        )
    )
    others = [c for c in df.columns if c not in (text_col, "labels")]
    return df.select(text, checked.alias("labels"), *others)


def export_training_set(
    splits: dict[str, DataFrame], path: str, task: str, num_labels: int, text_col: str = "text"
) -> None:
    """One Parquet partition per split, columns exactly text and labels."""
    for split, df in splits.items():
        training_rows(df.select(text_col, "labels"), task, num_labels, text_col).write.mode(
            "overwrite"
        ).parquet(f"{path.rstrip('/')}/split={split}")


def load_training_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
