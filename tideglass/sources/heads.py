"""Lines of many text files, and the header line of each file.

Everything stays in Spark: a file's header is found by its place among the lines
and joined to the file's other lines, so neither file names nor headers of
single files pass through the driver, and a header may stand at any place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "source_file"


def text_lines(spark: SparkSession, path: str, pattern: str, encoding: str | None = None) -> DataFrame:
    """(source_file, file_bytes, block, line) of all files that match."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    line = F.decode(F.col("value").cast("binary"), encoding) if encoding else F.col("value")
    return lines.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        line.alias("line"),
    )


def first_lines(lines: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(source_file, header): the first line of each file for which ``wanted`` holds."""
    # Within a block the id grows from line to line.
    placed = lines.withColumn("_at", F.struct("block", F.monotonically_increasing_id().alias("n")))
    if wanted is not None:
        placed = placed.filter(wanted)
    return placed.groupBy(FILE).agg(F.min_by("line", "_at").alias("header"))


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(source_file, file_bytes) of all files that match, empty ones too; nothing is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return listed.select(F.col("path").alias(FILE), F.col("length").alias("file_bytes"))
