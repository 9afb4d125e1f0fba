"""Results that readers see whole or not at all.

Each publication goes to a folder of its own. It becomes the current one when a row about
it reaches the manifest, the last thing that is written; until then, and if the writer
dies, readers keep finding the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "number bigint, version string, published_at timestamp"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``number, version, published_at`` of all publications below ``root``."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{root.rstrip('/')}/manifest")
    except AnalysisException:
        # nothing has been published yet
        return spark.createDataFrame([], _MANIFEST)


def current(spark: SparkSession, root: str) -> str:
    """The folder of the latest publication."""
    order = [F.desc("number"), F.desc("published_at"), F.desc("version")]
    latest = versions(spark, root).orderBy(*order).first()
    if latest is None:
        raise FileNotFoundError(f"nothing is published below {root}")
    return f"{root.rstrip('/')}/versions/{latest['version']}"


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder, then make it the current one; returns the folder."""
    version = uuid.uuid4().hex
    folder = f"{root.rstrip('/')}/versions/{version}"
    write(folder)
    last = versions(spark, root).agg(F.max("number")).first()[0] or 0
    row = spark.range(1).select(
        F.lit(last + 1).cast("bigint").alias("number"),
        F.lit(version).alias("version"),
        F.current_timestamp().alias("published_at"),
    )
    row.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/manifest")
    return folder
