"""Late rows: a router keeps what a watermark would drop, and windows are amended with it.

``route_late`` splits every micro-batch against the watermark it records: rows whose window was closed before the batch
go to a side table, the others to a table that feeds the window stream. ``amend_windows`` computes the windows that late
rows belong to anew, so both tables together give the windows of a batch run over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideglass.operators.joins import null_safe_join
from tideglass.operators.timeline import as_keys, bucket

ON_TIME, LATE, MARKS, STAGING = "on_time", "late", "marks", "_staging"


def _publish(spark: SparkSession, staged: str, final: str) -> None:
    """Show a written folder under its name, in one step; a folder that an earlier attempt has shown stays."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, final))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(source):
        fs.mkdirs(target.getParent())
        fs.rename(source, target)


def route_late(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    ts: str = "ts",
    width: int = 10,
    delay: str = "1 minute",
    available_now: bool = True,
    every: str = "10 seconds",
) -> StreamingQuery:
    """Write ``path/on_time`` and ``path/late``, a folder per micro-batch.

    The watermark of a batch is the latest time of all batches before it less ``delay``, as in a window stream with that
    delay; it is written to ``path/marks`` with every batch. A row is late if its window of ``width`` seconds ended by
    the watermark. Rows without time are on time, and dropped by the windows. A batch that is run again after a failure
    finds the same mark and shows no row twice. The window stream reads ``on_time_rows`` without a limit of files per
    trigger, so that it never splits a batch, and with the same ``delay``; it then drops nothing.
    """
    spark = stream.sparkSession
    behind = int(pd.Timedelta(delay).total_seconds() * 1_000_000)
    mark_type = "latest long"

    def split(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        name, before = f"b{batch:012d}", f"{path}/{MARKS}/b{batch - 1:012d}"
        mark = session.read.schema(mark_type).parquet(before).first().latest if batch else None
        end = (bucket(ts, width) + 1) * F.lit(width * 1_000_000)
        late = F.lit(False) if mark is None else F.coalesce(end <= F.lit(mark - behind), F.lit(False))
        staged = f"{path}/{STAGING}/{name}"
        rows.withColumn("_late", late.cast("int")).write.mode("overwrite").partitionBy("_late").parquet(staged)
        newest = session.read.schema(stream.schema).parquet(staged).agg(F.max(F.unix_micros(ts)).alias("latest"))
        newest.select(F.greatest("latest", F.lit(mark).cast("long")).alias("latest")).write.mode("overwrite").parquet(f"{path}/{MARKS}/{name}")
        for value, kind in enumerate((ON_TIME, LATE)):
            _publish(session, f"{staged}/_late={value}", f"{path}/{kind}/{name}")

    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
    return writer.foreachBatch(split).start()


def _routed(spark: SparkSession, path: str, kind: str) -> str | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path}/{kind}/*" if fs.exists(folder) else None


def routed_rows(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    """The rows of ``path/on_time`` or ``path/late`` so far; empty if there are none."""
    found = _routed(spark, path, kind)
    return spark.read.schema(schema).parquet(found) if found else spark.createDataFrame([], schema)


def on_time_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that are on time as a stream."""
    return spark.readStream.schema(schema).parquet(f"{path}/{ON_TIME}/*")


def amend_windows(
    windows: DataFrame,
    on_time: DataFrame,
    late: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    key: str | Sequence[str] | None = "src_ip",
    ts: str = "ts",
    width: int = 10,
) -> DataFrame:
    """``windows`` of a stream with those that late rows belong to computed anew by ``compute`` from all their rows.

    Only the rows of such windows are read by it; the other windows stay as they are.
    """
    keys = as_keys(key)
    touched = late.dropna(subset=[ts, *keys]).select(*keys, bucket(ts, width).alias("_w")).distinct()
    marked = on_time.unionByName(late).withColumn("_w", bucket(ts, width))
    again = compute(null_safe_join(marked, touched, [*keys, "_w"], "left_semi").drop("_w"))
    kept = null_safe_join(windows.withColumn("_w", bucket(ts, width)), touched, [*keys, "_w"], "left_anti")
    return kept.drop("_w").unionByName(again.select(*windows.columns))
