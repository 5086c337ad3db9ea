"""Window, sequence and report tables, and saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.schemas import SENSOR_RENAMES, SEQUENCES


def read_windows_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A window CSV with header. Without a schema every column is read as text
    and all but the key and the label columns are cast to double."""
    if schema is not None:
        return spark.read.schema(schema).csv(path, header=True)
    raw = spark.read.csv(path, header=True)
    cols = []
    for name in raw.columns:
        col, out = F.col(f"`{name}`"), SENSOR_RENAMES.get(name, name)
        if out == "ts":
            col = F.coalesce(
                F.try_to_timestamp(col), F.timestamp_seconds(col.try_cast("double"))
            )
        elif out in ("stage", "mitre_label"):
            col = col.try_cast("int")
        elif out not in ("src_ip", "dst_ip", "label"):
            col = col.try_cast("double")
        cols.append(col.alias(out))
    return raw.select(*cols)


def append_windows(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a parquet table partitioned by day.

    Rows are spread by day and a hash of the row, so that a day is written by
    several tasks and no task writes to many days; a file is sorted by time.
    """
    (
        df.withColumn("day", F.to_date(ts))
        .repartition("day", F.pmod(F.xxhash64(*df.columns), F.lit(8)))
        .sortWithinPartitions("day", ts)
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def append_csv(df: DataFrame, path: str) -> None:
    """Append CSV part files, each with its header line."""
    df.write.mode("append").csv(path, header=True)


def save_sequences(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEQUENCES).parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Raises if there is no model; nothing is scored with random weights."""
    return PipelineModel.load(path)


def save_report(report: DataFrame, path: str) -> None:
    """A small report (metrics, best settings) as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
