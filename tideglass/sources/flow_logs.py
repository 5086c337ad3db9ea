"""Sensor flow logs: tab-separated text with a ``#fields`` header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.scalar import epoch_ts, number
from tideglass.schemas import FLOW_MEANS, sensor_log_schema
from tideglass.sources.heads import FILE, files, first_lines, text_lines

MIN_BYTES = 100
MARK = "#fields"


def skipped_logs(
    spark: SparkSession, path: str, pattern: str = "*.log", min_bytes: int = MIN_BYTES
) -> DataFrame:
    """(source_file, file_bytes, reason) of the files that ``read_flow_log`` leaves out."""
    lines = text_lines(spark, path, pattern)
    headed = first_lines(lines, F.col("line").startswith(MARK)).select(F.col(FILE).alias("_headed"))
    # The listing and the reader spell local paths differently.
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    reason = F.when(F.col("file_bytes") < min_bytes, "too small").when(F.col("_headed").isNull(), "no header")
    listed = files(spark, path, pattern)
    joined = listed.join(headed, plain(F.col(FILE)) == plain(F.col("_headed")), "left")
    return joined.withColumn("reason", reason).filter("reason is not null").select(FILE, "file_bytes", "reason")


def read_flow_log(
    spark: SparkSession,
    path: str,
    pattern: str = "*.log",
    min_bytes: int = MIN_BYTES,
    corrupt: bool = False,
) -> DataFrame:
    """All logs under ``path`` as one flow table.

    Each file's first ``#fields`` line, wherever it stands, names its columns;
    columns a file does not have are null. Numbers are coerced (``-`` becomes 0),
    ``ts`` becomes a timestamp, and ``source_file`` names the file. A line with
    too few columns keeps what it has; ``corrupt=True`` adds its text as
    ``_corrupt_record``. Files below ``min_bytes`` or without a header are left
    out; ``skipped_logs`` lists them.
    """
    lines = text_lines(spark, path, pattern).filter(F.col("file_bytes") >= min_bytes)
    heads = first_lines(lines, F.col("line").startswith(MARK))
    heads = heads.select(FILE, F.slice(F.split(F.rtrim("header"), "\t"), 2, 10_000).alias("fields"))
    # Different column names are few, whatever the number of files.
    named = [r.name for r in heads.select(F.explode("fields").alias("name")).distinct().orderBy("name").collect()]
    if not named:
        raise ValueError(f"no usable flow log under {path}")
    rows = (
        lines.filter(~F.col("line").startswith("#") & (F.col("line") != ""))
        .join(heads, FILE)
        .withColumn("parts", F.split("line", "\t", -1))
    )
    place = lambda name: F.array_position("fields", name)
    columns = [
        F.when(place(n) > 0, F.get("parts", place(n).cast("int") - 1)).alias(field.name)
        for n, field in zip(named, sensor_log_schema(named).fields, strict=True)
    ]
    if corrupt:
        columns.append(F.when(F.size("parts") != F.size("fields"), F.col("line")).alias("_corrupt_record"))
    logs = rows.select(*columns, FILE)
    typed = {c: number(c) for c in FLOW_MEANS if c in logs.columns}
    if "ts" in logs.columns:
        typed["ts"] = epoch_ts("ts")
    typed |= {c: F.col(c).try_cast("int") for c in ("src_port", "dst_port") if c in logs.columns}
    return logs.withColumns(typed)
