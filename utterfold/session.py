"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None, app_name: str = "utterfold", **conf: str
) -> SparkSession:
    """A session with the settings the operators are written for.

    ``master`` is left to spark-submit when not given. Extra settings use their
    full Spark name: ``build_session(**{"spark.sql.shuffle.partitions": "8"})``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; on a cluster
    other machines could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="utterfold-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/utterfold/{name}-{uuid.uuid4().hex}"


_FEW = 8


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share an input of fewer than eight partitions among up to eight cores.

    Eight partitions are a gigabyte at most, on a cluster of any size; a larger input
    is left alone.
    """
    cores = min(_FEW, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Later passes read only the columns they need, and a lost executor costs a
    file read instead of the whole computation.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
