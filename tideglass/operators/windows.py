"""Flows to tumbling windows, gap filling, trend features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.dimensions import RISK_HORIZONS
from tideglass.functions.scalar import byte_ratio, number
from tideglass.operators.labels import horizon_class
from tideglass.operators.timeline import (
    BUCKET,
    CHUNK,
    DAY,
    HALO,
    PIECE,
    POS,
    SERIES,
    as_keys,
    bucket,
    dense_index,
    index_series,
    over_frames,
)
from tideglass.schemas import FLOW_MEANS


def check_width(width: int, bucket_seconds: int = DAY) -> None:
    """Epoch-aligned and midnight-aligned windows agree only for such widths,
    and a time bucket must hold whole windows."""
    if width <= 0 or DAY % width:
        raise ValueError(f"window width {width} s does not divide a day")
    if bucket_seconds % width:
        raise ValueError(f"buckets of {bucket_seconds} s do not hold whole windows of {width} s")


def window_start(ts: str, width: int) -> Column:
    return F.window(F.col(ts), f"{width} seconds")["start"]


def fill_gaps(
    windows: DataFrame,
    key: str | Sequence[str] | None,
    ts: str,
    width: int,
    values: Sequence[str],
    bucket_seconds: int = DAY,
) -> DataFrame:
    """One row per ``width`` between the first and last window of each series.

    Every window row is repeated up to the next window of its series, with 0 in
    ``values`` for the added rows; nothing but real windows is shuffled. The
    next window of the last row in a time bucket is the first of a later bucket.
    A gap is cut into buckets first, so no array is longer than the windows of a
    bucket or the buckets of a gap.
    """
    keys = as_keys(key)
    series = keys or [SERIES]
    parted = windows.withColumn(BUCKET, bucket(ts, bucket_seconds))
    if not keys:
        parted = parted.withColumn(SERIES, F.lit(0))
    inside = Window.partitionBy(*series, BUCKET)
    # The last rows of all buckets of a series form one chain; the other rows stay
    # with their bucket. So the flows are read and aggregated once.
    chain = Window.partitionBy(*series, "_chain").orderBy(BUCKET)
    step = F.expr(f"INTERVAL {width} SECONDS")
    last = F.coalesce(F.col("_next") - step, F.col(ts))
    filled = (
        parted.withColumns({"_lead": F.lead(ts).over(inside.orderBy(ts)), "_first": F.min(ts).over(inside)})
        .withColumn("_chain", F.when(F.col("_lead").isNotNull(), F.col(BUCKET)))
        .withColumn("_later", F.lead("_first").over(chain))
        .withColumn("_next", F.coalesce("_lead", "_later"))
        .withColumn("_last", last)
        .withColumn("_in", F.explode(F.sequence(F.col(BUCKET), bucket("_last", bucket_seconds))))
        .withColumn("_from", F.greatest(F.col(ts), F.timestamp_seconds(F.col("_in") * bucket_seconds)))
        .withColumn("_to", F.least(F.col("_last"), F.timestamp_seconds((F.col("_in") + 1) * bucket_seconds - width)))
        .withColumn("_slot", F.explode(F.sequence("_from", "_to", step)))
        .drop("_last", "_in", "_from", "_to")
    )
    real = F.col("_slot") == F.col(ts)
    added = {c: F.when(real, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)) for c in values}
    return (
        filled.withColumns(added)
        .withColumn(ts, F.col("_slot"))
        .drop("_slot", "_lead", "_later", "_next", "_first", "_chain", BUCKET, SERIES)
    )


def window_features(
    flows: DataFrame,
    key: str | Sequence[str] | None = "src_ip",
    ts: str = "ts",
    width: int = 10,
    means: Sequence[str] = FLOW_MEANS,
    uid: str | None = "uid",
    port: str | None = "dst_port",
    gap_fill: bool = True,
    bucket_seconds: int = DAY,
    count_name: str = "flow_count",
    port_name: str = "unique_dest_ports_scan_signature",
) -> DataFrame:
    """Per-source tumbling windows: means, flow count, distinct ports, byte ratio.

    Unset numbers count as 0 *before* the mean. Rows without a key are dropped.
    ``gap_fill=False`` leaves out windows without traffic; after the silence
    filter both forms are the same, and the short form never builds the
    (usually far larger) empty part. Aggregation is partial before the shuffle,
    and the distinct count is spread over (source, window, port), so one busy
    source does not end up in one task.
    """
    check_width(width, bucket_seconds)
    keys = as_keys(key)
    have = set(flows.columns)
    means = [m for m in means if m in have]
    flows = flows.dropna(subset=[ts, *keys])
    aggs = [F.avg(number(m)).alias(m) for m in means]
    if uid in have:
        aggs.append(F.count(uid).alias(count_name))
    if port in have:
        aggs.append(F.count_distinct(port).alias(port_name))
    values = means + [count_name] * (uid in have) + [port_name] * (port in have)
    windows = (
        flows.groupBy(*keys, F.window(F.col(ts), f"{width} seconds").alias("_w"))
        .agg(*aggs)
        .select(*keys, F.col("_w.start").alias(ts), *values)
    )
    if gap_fill:
        windows = fill_gaps(windows, keys, ts, width, values, bucket_seconds)
    if {"orig_bytes", "resp_bytes"} <= set(values):
        windows = windows.withColumn("bidirectional_flow_ratio", byte_ratio())
    return windows


def net_window_features(
    flows: DataFrame,
    by: str | Sequence[str] | None,
    ts: str,
    width: int,
    counted: Column | str,
    syn: Column | str,
    size: Column | str,
    duration: Column | str,
    fwd: Column | str,
    bwd: Column | str,
    rate: Column | str,
    attack: Column | str,
    gap_fill: bool = True,
    bucket_seconds: int = DAY,
) -> DataFrame:
    """Network-wide windows of one capture (``by`` names the capture)."""
    check_width(width, bucket_seconds)
    keys = as_keys(by)

    def col(c):
        return F.col(c) if isinstance(c, str) else c

    flows = flows.dropna(subset=[ts, *keys]).select(
        *keys,
        ts,
        *[
            col(c).alias(name)
            for name, c in {
                "_counted": counted, "_syn": syn, "_size": size, "_duration": duration,
                "_fwd": fwd, "_bwd": bwd, "_rate": rate, "_attack": attack,
            }.items()
        ],
    )
    per_second = F.lit(float(width))
    aggs = {
        "connections_per_sec": F.count("_counted") / per_second,
        "syn_rate": F.sum("_syn") / per_second,
        "avg_packet_size": F.avg("_size"),
        "flow_duration_mean": F.avg("_duration"),
        "fwd_packets_sum": F.sum("_fwd"),
        "bwd_packets_sum": F.sum("_bwd"),
        "flow_packets_s_mean": F.avg("_rate"),
        "attack_active": F.max("_attack"),
    }
    windows = (
        flows.groupBy(*keys, F.window(F.col(ts), f"{width} seconds").alias("_w"))
        .agg(*[F.coalesce(a, F.lit(0)).alias(n) for n, a in aggs.items()])
        .select(*keys, F.col("_w.start").alias(ts), *aggs)
    )
    if gap_fill:
        windows = fill_gaps(windows, keys, ts, width, list(aggs), bucket_seconds)
    return windows


# Trend columns of the network-wide windows.
NET_DIFFS = {"connections_per_sec_diff": "connections_per_sec", "syn_rate_diff": "syn_rate"}
NET_AVERAGES = {
    "connections_1m_avg": "connections_per_sec",
    "syn_rate_1m_avg": "syn_rate",
    "packet_size_1m_avg": "avg_packet_size",
}


def trend_features(
    windows: DataFrame,
    by: str | Sequence[str] | None,
    ts: str = "ts",
    diffs: Mapping[str, str] = NET_DIFFS,
    averages: Mapping[str, str] = NET_AVERAGES,
    rows: int = 6,
    step: int | None = None,
    tie: Sequence[str] = (),
    bucket_seconds: int = DAY,
) -> DataFrame:
    """First differences (0 for the first row) and rolling means over ``rows``
    rows. Give ``step`` (seconds) if the series is gap-filled: it saves a shuffle."""
    numbered = index_series(windows, by, ts, step, tie, bucket_seconds)
    trends = lambda spec: _trends(spec, diffs, averages, rows)
    return over_frames(numbered, by, trends, max(rows - 1, 1)).drop(POS)


def risk_features(
    windows: DataFrame,
    by: str | Sequence[str] | None,
    step: int,
    ts: str = "ts",
    diffs: Mapping[str, str] = NET_DIFFS,
    averages: Mapping[str, str] = NET_AVERAGES,
    rows: int = 6,
    active: str = "attack_active",
    horizons: Sequence[tuple[str, float]] = RISK_HORIZONS,
    label: str = "label",
    chunk: int = CHUNK,
    partitions: int | None = None,
) -> DataFrame:
    """Trend features and lookahead label of a gap-filled series in one shuffle.

    Same columns as ``trend_features`` followed by ``lookahead_label``. Rows are
    one ``step`` apart, so a chunk holds ``chunk`` rows of a series, the rows
    the rolling frames need from the chunk before, and the attacks that can be
    seen from it in the chunks after. ``partitions`` fixes the number of tasks:
    filled rows are mostly zeros, so their bytes say little of their number.
    """
    before = max(rows - 1, 1)
    reach = int(max(limit for _, limit in horizons) // step)
    if max(before, reach) > chunk:
        raise ValueError("a chunk must be longer than the horizon")
    attack = F.coalesce(F.col(active) == 1, F.lit(False))
    home = F.floor(F.col(POS) / F.lit(chunk)).cast("long")
    inside = F.pmod(F.col(POS), F.lit(chunk))
    none = F.array().cast("array<bigint>")
    pieces = F.concat(
        F.array(home),
        F.when(inside >= chunk - before, F.array(home + 1)).otherwise(none),
        F.when(attack & (inside < reach), F.array(home - 1)).otherwise(none),
    )
    spread = dense_index(windows, ts, step).select("*", F.posexplode(pieces).alias(HALO, PIECE))
    if partitions:
        spread = spread.repartition(partitions, *as_keys(by), PIECE)
    part = Window.partitionBy(*as_keys(by), PIECE)
    forward, backward = part.orderBy(POS), part.orderBy(F.desc(POS))
    later = backward.rangeBetween(Window.unboundedPreceding, -1)
    gap = (F.min(F.when(attack, F.col(POS))).over(later) - F.col(POS)) * F.lit(step)
    return (
        spread.withColumns(_trends(forward, diffs, averages, rows))
        .withColumn(label, horizon_class(attack, gap, horizons))
        .filter(F.col(HALO) == 0)
        .drop(HALO, PIECE, POS)
    )


def _trends(spec, diffs: Mapping[str, str], averages: Mapping[str, str], rows: int) -> dict:
    out = {n: F.coalesce(F.col(c) - F.lag(c).over(spec), F.lit(0.0)) for n, c in diffs.items()}
    out |= {n: F.avg(c).over(spec.rowsBetween(1 - rows, 0)) for n, c in averages.items()}
    return out


def change_features(
    windows: DataFrame,
    by: str | Sequence[str] | None,
    ts: str = "ts",
    changes: Sequence[str] = (),
    rolling: Sequence[str] = (),
    slopes: Sequence[str] = (),
    rows: int = 5,
    step: int | None = None,
    tie: Sequence[str] = (),
    bucket_seconds: int = DAY,
) -> DataFrame:
    """Relative change to the previous window, rolling mean and deviation, and
    the linear slope per window over the last ``rows`` windows."""

    def columns(spec) -> dict:
        frame = spec.rowsBetween(1 - rows, 0)
        # Positions relative to the chunk keep the squares of the slope small.
        x = (F.col(POS) - F.col(PIECE) * CHUNK).cast("double")
        out = {}
        for c in changes:
            before = F.lag(c).over(spec)
            out[f"{c}_pct_change"] = F.try_divide(F.col(c) - before, before)
        for c in rolling:
            out[f"{c}_roll_mean"] = F.avg(c).over(frame)
            out[f"{c}_roll_std"] = F.stddev_samp(c).over(frame)
        for c in slopes:
            out[f"{c}_slope"] = F.regr_slope(F.col(c), x).over(frame)
        return out

    numbered = index_series(windows, by, ts, step, tie, bucket_seconds)
    return over_frames(numbered, by, columns, max(rows - 1, 1)).drop(POS)


def traffic_mix(
    flows: DataFrame,
    key: str | Sequence[str] | None,
    ts: str,
    width: int,
    failed: Column,
    tcp: Column,
    udp: Column,
    inbound: str,
    outbound: str,
    port: str,
) -> DataFrame:
    """Failed-connection percent, TCP to UDP and in to out ratios, distinct ports."""
    check_width(width)
    keys = as_keys(key)
    return (
        flows.groupBy(*keys, F.window(F.col(ts), f"{width} seconds").alias("_w"))
        .agg(
            (F.avg(failed.cast("int")) * 100).alias("failed_pct"),
            F.try_divide(F.count_if(tcp), F.count_if(udp)).alias("tcp_udp_ratio"),
            F.try_divide(F.sum(inbound), F.sum(outbound)).alias("in_out_ratio"),
            F.count_distinct(port).alias("distinct_ports"),
        )
        .select(
            *keys,
            F.col("_w.start").alias(ts),
            "failed_pct", "tcp_udp_ratio", "in_out_ratio", "distinct_ports",
        )
    )
