"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# UTC keeps window edges and text times the same on every executor; AQE splits
# skewed join partitions and coalesces small shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}


def build_session(app: str = "tideglass", **extra: str) -> SparkSession:
    """A session with the defaults above; ``extra`` overrides single settings."""
    builder = SparkSession.builder.appName(app)
    for name, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def task_count(table: DataFrame, rows: int) -> int:
    """Tasks for ``rows`` rows of ``table`` each, and no fewer than the session's. Of Parquet, only footers are read."""
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-table.count() // rows))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for intermediate tables and stream checkpoints.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, so that
    every executor sees it; without that setting it lies below the warehouse,
    which all executors share too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tideglass-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
