"""Catalogue entries that write the given tables as the files of a source or sink and read them back through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.operators import metrics, sequences
from tideglass.operators.scaling import RobustScaler, fit_robust_scaler
from tideglass.plans.adapters import BUCKET, EVENT_STAGES, VECTOR, WINDOW_COLUMNS, flows, text, vectors, windows
from tideglass.plans.catalog import _labelled_active, _position_sum, query, rounded
from tideglass.session import scratch_path
from tideglass.sources import flow_logs, ground_truth, tables

LOG_FIELDS = ["ts", "uid", "id.orig_h", "orig_bytes", "resp_bytes", "service"]


def _log_lines(rows: DataFrame) -> DataFrame:
    """Log lines and header lines, one header at least for each file that is written."""
    micros = F.unix_micros("ts")
    when = F.format_string("%d.%06d", F.floor(micros / 1_000_000).cast("long"), F.pmod(micros, F.lit(1_000_000)))
    cells = [when, *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("uid", "src_ip", "orig_bytes", "resp_bytes", "label")]]
    part = F.pmod(F.xxhash64("uid"), F.lit(64)).cast("int").alias("part")
    lines = rows.select(part, F.concat_ws("\t", *cells).alias("line"))
    heads = lines.select("part").distinct().select("part", F.lit("\t".join(["#fields", *LOG_FIELDS])).alias("line"))
    return lines.unionByName(heads).repartition("part").select("line")


@query
def flow_log_source(spark, sf):
    """Flows written as sensor logs and read back with their headers."""
    path = scratch_path(spark, "logs")
    _log_lines(flows(spark, sf)).write.text(path)
    back = flow_logs.read_flow_log(spark, path, "part-*")
    return rounded(back.select("uid", "src_ip", text(), "orig_bytes", "resp_bytes", "service"), ["orig_bytes", "resp_bytes"])


@query
def labelled_flow_source(spark, sf):
    """Flows written as ground-truth files with day-first times and read back with their stages."""
    path = scratch_path(spark, "truth")
    rows = flows(spark, sf).select(
        F.col("src_ip").alias("Source IP"), F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias(" Timestamp"),
        F.when(F.col("label") == "error", "DDoS").otherwise("BENIGN").alias("Label"),
    )
    rows.write.option("quoteAll", True).csv(path, header=True)
    return ground_truth.read_labelled_flows(spark, path, "part-*").select("src_ip", text(), "label", "stage")


@query
def window_table_sink(spark, sf):
    """Windows appended to the table by day and read back."""
    path = scratch_path(spark, "window-table")
    tables.append_windows(windows(spark, sf, gap_fill=False), path)
    return rounded(spark.read.parquet(path).select("src_ip", text(), *WINDOW_COLUMNS), ["orig_bytes", "resp_bytes"])


@query
def window_csv_source(spark, sf):
    """Windows appended as CSV and read back."""
    path = scratch_path(spark, "window-csv")
    tables.append_csv(windows(spark, sf, gap_fill=False), path)
    back = tables.read_windows_csv(spark, path)
    counts = [F.col(c).cast("long").alias(c) for c in WINDOW_COLUMNS[2:]]
    return rounded(back.select("src_ip", text(), *WINDOW_COLUMNS[:2], *counts), ["orig_bytes", "resp_bytes"])


@query
def sequence_table(spark, sf):
    """Sequences saved and loaded."""
    path = scratch_path(spark, "sequence-table")
    made = sequences.make_sequences(_labelled_active(spark, sf), features=WINDOW_COLUMNS, bucket_seconds=BUCKET)
    tables.save_sequences(made, path)
    return tables.load_sequences(spark, path).select(
        "src_ip", "seq_id", text("start_ts"), text("end_ts"), "label", "prob", _position_sum(F.flatten("x")).alias("x_sum")
    )


@query
def scaler_saved(spark, sf):
    """A fitted scaler saved and loaded."""
    path = scratch_path(spark, "scaler")
    fit_robust_scaler(vectors(spark, sf), VECTOR).save(spark, path)
    return rounded(RobustScaler.load(spark, path).table(spark).select("feature", "center", "scale"), ["center", "scale"], 9)


@query
def report_saved(spark, sf):
    """Class shares saved as a report and read back."""
    path = scratch_path(spark, "report")
    made = metrics.class_distribution(flows(spark, sf), "label", [*EVENT_STAGES, "scan"])
    tables.save_report(made, path)
    return rounded(spark.read.schema(made.schema).json(path), ["pct"], 9)
