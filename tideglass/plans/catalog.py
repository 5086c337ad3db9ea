"""One query per operator, over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.dimensions import RISK_CLASSES, STAGE_NAMES
from tideglass.functions import scalar as S
from tideglass.functions import scores as P
from tideglass.functions.hashing import row_hash
from tideglass.operators import forecast, labels, metrics, sampling, sequences
from tideglass.operators.neighbours import knn_classify
from tideglass.operators.anchored import anchored_windows
from tideglass.operators.packets import assemble_flows, connection_flows
from tideglass.operators.scaling import fit_robust_scaler
from tideglass.operators.windows import (
    change_features,
    net_window_features,
    risk_features,
    traffic_mix,
    trend_features,
    window_features,
)
from tideglass.plans.adapters import (
    BUCKET,
    DAY,
    EVENT_STAGES,
    HORIZONS,
    HOUR,
    VECTOR,
    WINDOW_COLUMNS,
    connections,
    event_packets,
    flows,
    net_windows,
    packet_tasks,
    packets,
    predictions,
    scored_vectors,
    table,
    text,
    vectors,
    windows,
    window_tasks,
)
from tideglass.schemas import FLOW_MEANS
from tideglass.plans.jobs import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# --- windows ---------------------------------------------------------------------


@query
def win_features_gapfilled(spark, sf):
    out = windows(spark, sf)
    return rounded(out.select("src_ip", text(), *WINDOW_COLUMNS), ["orig_bytes", "resp_bytes"])


@query
def win_features_dense_only(spark, sf):
    out = windows(spark, sf, gap_fill=False)
    return rounded(out.select("src_ip", text(), *WINDOW_COLUMNS), ["orig_bytes", "resp_bytes"])


@query
def win_features_without_key(spark, sf):
    """All flows as one series, gaps filled."""
    means = ["orig_bytes", "resp_bytes"]
    out = window_features(flows(spark, sf), None, width=HOUR, means=means, port_name="distinct_ports", bucket_seconds=BUCKET)
    return rounded(out.select(text(), *WINDOW_COLUMNS), means)


@query
def win_features_null_key(spark, sf):
    """Flows without a source are left out."""
    means = ["orig_bytes", "resp_bytes"]
    some = flows(spark, sf).withColumn("src_ip", F.when(F.col("src_ip").cast("int") % 10 != 0, F.col("src_ip")))
    out = window_features(some, width=HOUR, means=means, port_name="distinct_ports", gap_fill=False, bucket_seconds=BUCKET)
    return rounded(out.select("src_ip", text(), *WINDOW_COLUMNS), means)


NET = [
    "connections_per_sec", "syn_rate", "avg_packet_size", "flow_duration_mean",
    "fwd_packets_sum", "bwd_packets_sum", "flow_packets_s_mean", "attack_active",
]


@query
def net_window_features_all(spark, sf):
    out = net_windows(spark, sf).select(text(), *NET)
    return rounded(out, [c for c in NET if c not in ("fwd_packets_sum", "bwd_packets_sum", "attack_active")])


@query
def net_window_features_by_capture(spark, sf):
    """Daily windows of the second flow set, one capture per return flag."""
    li = table(spark, sf, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    out = net_window_features(
        li, "l_returnflag", "ts", DAY,
        counted="l_orderkey", syn=(F.col("l_linenumber") == 1).cast("int"), size=cents("l_extendedprice"),
        duration="l_quantity", fwd=F.col("l_quantity").cast("long"), bwd=F.col("l_linenumber").cast("long"),
        rate=cents("l_tax"), attack=(F.col("l_discount") >= 0.09).cast("int"), bucket_seconds=365 * DAY,
    )
    out = out.select("l_returnflag", text(), *NET)
    return rounded(out, [c for c in NET if c not in ("fwd_packets_sum", "bwd_packets_sum", "attack_active")], 4)


@query
def trend_features_by_source(spark, sf):
    out = trend_features(net_windows(spark, sf, "src_ip"), "src_ip", step=HOUR)
    cols = [
        "connections_per_sec_diff", "syn_rate_diff", "connections_1m_avg",
        "syn_rate_1m_avg", "packet_size_1m_avg",
    ]
    return rounded(out.select("src_ip", text(), *cols), cols)


@query
def trend_features_active_rows(spark, sf):
    """Differences and rolling means over windows with traffic, gaps left out."""
    out = trend_features(
        windows(spark, sf, gap_fill=False), "src_ip",
        diffs={"bytes_diff": "orig_bytes"}, averages={"bytes_avg": "orig_bytes"}, bucket_seconds=BUCKET,
    )
    return rounded(out.select("src_ip", text(), "bytes_diff", "bytes_avg"), ["bytes_diff", "bytes_avg"])


@query
def lookahead_label_by_source(spark, sf):
    out = labels.lookahead_label(net_windows(spark, sf, "src_ip"), "src_ip", horizons=HORIZONS, bucket_seconds=BUCKET)
    return out.select("src_ip", text(), "attack_active", "label")


@query
def risk_class_distribution(spark, sf):
    """Windows, trends, lookahead labels, class counts: the whole risk chain."""
    labelled = risk_features(net_windows(spark, sf, "src_ip"), "src_ip", HOUR, horizons=HORIZONS, partitions=window_tasks(spark, sf))
    rising = (F.col("connections_per_sec_diff") > 0).cast("long")
    out = labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(rising).alias("rising"),
        F.round(F.avg("connections_1m_avg"), 9).alias("connections_1m_avg"),
    )
    return out


@query
def rolling_slope(spark, sf):
    out = change_features(
        net_windows(spark, sf, "src_ip").withColumn("n", F.col("connections_per_sec") * HOUR),
        "src_ip", changes=["n"], rolling=["n"], slopes=["n"], step=HOUR,
    )
    cols = ["n_pct_change", "n_roll_mean", "n_roll_std", "n_slope"]
    return rounded(out.select("src_ip", text(), *cols), cols)


@query
def traffic_mix_by_source(spark, sf):
    out = traffic_mix(
        flows(spark, sf).withColumn("k", F.col("resp_bytes").cast("double")), "src_ip", "ts", DAY,
        failed=F.col("label") == "error", tcp=F.col("label").isin("click", "view"),
        udp=F.col("label") == "signup", inbound="k", outbound="orig_bytes", port="dst_port",
    )
    cols = ["failed_pct", "tcp_udp_ratio", "in_out_ratio"]
    return rounded(out.select("src_ip", text(), *cols, "distinct_ports"), cols)


# --- packets -----------------------------------------------------------------------


@query
def assemble_flows_from_packets(spark, sf):
    out = assemble_flows(packets(spark, sf), packet_tasks(spark, sf))
    floats = ["avg_win_orig", "avg_win_resp", "iat_mean", "iat_max", "iat_var", "duration"]
    ints = [
        "orig_pkts", "resp_pkts", "min_ttl_orig", "max_ttl_orig", "min_ttl_resp", "max_ttl_resp",
        "payload_min_orig", "payload_max_orig", "payload_min_resp", "payload_max_resp",
        "flag_syn", "flag_ack", "flag_fin", "flag_rst", "flag_psh", "flag_urg",
    ]
    # A side without packets has no values; one mark for it in both engines.
    out = out.fillna(-1, [*ints, *floats])
    # Squares of gaps of years are large.
    out = out.withColumn("iat_var", F.col("iat_var") / 1e9)
    return rounded(out.select("uid", *ints, *floats), floats, 4)


@query
def connection_flow_records(spark, sf):
    """The full flow record of every connection, with and without packets."""
    out = connection_flows(connections(spark, sf), packets(spark, sf), packet_tasks(spark, sf))
    out = out.withColumn("iat_var", F.col("iat_var") / 1e9).fillna(-1.0, FLOW_MEANS)
    return rounded(out.withColumn("ts", text()), FLOW_MEANS, 4)


@query
def anchored_windows_capture(spark, sf):
    """One capture; the windows carry the time to the next burst of large packets as risk class."""
    capture = event_packets(spark, sf)
    big = capture.filter("frame_len > 98 AND ip_version = 4")
    spans = labels.attack_intervals(big, [F.window("ts", "2 hours")], "ts", F.lit(True)).select("start", "end")
    out = anchored_windows(capture, None, width=HOUR, bucket_widths=24, intervals=spans, horizons=HORIZONS, fan=8)
    cols = ["connections_per_sec", "syn_rate", "avg_packet_size"]
    stamp = F.unix_micros("ts").alias("ts_us")
    return rounded(out.select(stamp, *cols, "unique_source_ips", "label"), cols)


@query
def anchored_windows_by_source(spark, sf):
    """Every source as a capture of its own; packets without IP or of version 6 open no window."""
    out = anchored_windows(event_packets(spark, sf), "src_ip", width=DAY, bucket_widths=10)
    cols = ["connections_per_sec", "syn_rate", "avg_packet_size"]
    stamp = F.unix_micros("ts").alias("ts_us")
    return rounded(out.select("src_ip", stamp, *cols), cols)


@query
def service_sets(spark, sf):
    """Sorted services per source; none gives a dash."""
    services = F.when(F.col("label") != "view", F.col("label"))
    return flows(spark, sf).groupBy("src_ip").agg(S.service_list(services).alias("services"))


@query
def tcp_flags_and_history(spark, sf):
    li = packets(spark, sf)
    history = F.when(F.col("is_orig"), F.lit("ShADt")).otherwise(F.lit("ShADT"))
    cols = {f"n_{f}": F.sum(S.tcp_flag("tcp_flags", f).cast("long")) for f in S.TCP_FLAGS}
    return li.withColumn("history", history).groupBy("src_ip").agg(
        *[c.alias(n) for n, c in cols.items()],
        F.sum(S.retransmitted("history", "t").cast("long")).alias("retrans_orig"),
        F.sum(S.retransmitted("history", "T").cast("long")).alias("retrans_resp"),
    )


# --- scalars, cleaning, filters ----------------------------------------------------


@query
def number_coercion(spark, sf):
    """Text with ``-`` and words to numbers, unset counted as 0."""
    raw = F.when(F.col("label") == "view", "-").when(F.col("label") == "click", "n/a").otherwise(F.col("resp_bytes"))
    out = flows(spark, sf).select("src_ip", raw.alias("raw")).withColumn("v", S.number("raw"))
    return out.groupBy("src_ip").agg(F.sum("v").alias("total"), F.round(F.avg("v"), 6).alias("mean"))


@query
def clean_numeric_values(spark, sf):
    value = (
        F.when(F.col("label") == "view", F.lit(float("inf")))
        .when(F.col("label") == "click", F.lit(float("nan")))
        .when(F.col("label") == "signup", F.lit(None).cast("double"))
        .otherwise(F.col("orig_bytes"))
    )
    out = S.clean_numeric(flows(spark, sf).withColumn("v", value), ["v"])
    return out.select("uid", F.round("v", 6).alias("v"))


@query
def time_parsing(spark, sf):
    """Epoch seconds, day-first text and unparsable text."""
    ev = flows(spark, sf)
    written = (
        F.when(F.col("label") == "view", F.date_format("ts", "dd/MM/yyyy HH:mm"))
        .when(F.col("label") == "click", F.date_format("ts", "d/M/yyyy H:mm:ss"))
        .when(F.col("label") == "signup", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("label") == "purchase", F.date_format("ts", "d/M/yyyy h:mm a"))
        .otherwise("not a time")
    )
    seconds = F.unix_seconds("ts").cast("string")
    out = ev.select(
        "uid",
        S.parse_ts_dayfirst(written).alias("parsed"),
        S.epoch_ts(F.when(F.col("label") == "error", "-").otherwise(seconds)).alias("epoch"),
    ).dropna(subset=["parsed"])
    return out.select("uid", text("parsed"), text("epoch"))


@query
def label_map(spark, sf):
    padded = F.concat(F.lit(" "), F.col("label"), F.lit("\t"))
    ev = flows(spark, sf).withColumn("label", padded)
    known = {k: v for k, v in EVENT_STAGES.items() if k != "signup"}
    out = labels.map_label(ev, "label", known).withColumn("attack", S.attack_flag(S.strip("label"), ("VIEW", "CLICK")))
    return out.select("uid", "stage", "attack")


@query
def label_map_table(spark, sf):
    dim = labels.stage_table(spark, {k: v for k, v in EVENT_STAGES.items() if k != "click"})
    out = labels.map_label_table(flows(spark, sf), "label", dim, "label", "stage")
    return out.groupBy("src_ip", "stage").agg(F.count(F.lit(1)).alias("n"))


@query
def flow_feature_derivation(spark, sf):
    """Totals, mean sizes and rates of order lines read as positional flows."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", "con").when(F.col("l_returnflag") == "N", "FIN").alias("state"),
        (F.col("l_linenumber") - 1).cast("string").alias("Spkts"),
        (F.col("l_partkey") % 3).cast("string").alias("Dpkts"),
        F.col("l_quantity").cast("string").alias("sbytes"),
        F.lit("10").alias("dbytes"),
        (F.col("l_discount") * 10).cast("string").alias("dur"),
    )
    out = S.derive_flow_features(li).select(
        "l_orderkey", "l_linenumber", "total_packets", "total_bytes", "avg_packet_size",
        "flow_packets_s", "syn_equivalent",
    )
    return rounded(out, ["avg_packet_size", "flow_packets_s"])


@query
def conform_features(spark, sf):
    """Rename, add absent features as 0.0, drop by name in any case."""
    out = S.drop_columns(flows(spark, sf), ["LABEL", "Dst_Port"])
    out = S.conform(out, ["sent", "resp_bytes", "absent"], ["uid"], {"orig_bytes": "sent"})
    return rounded(out, ["sent", "resp_bytes"])


@query
def silence_filter(spark, sf):
    rows = windows(spark, sf).withColumn("orig_pkts", F.lit(0))
    out = sequences.drop_silent(rows).select("src_ip", text(), *WINDOW_COLUMNS)
    return rounded(out, ["orig_bytes", "resp_bytes"])


@query
def byte_ratio(spark, sf):
    out = windows(spark, sf, gap_fill=False).filter("resp_bytes > 0")
    return rounded(out.select("src_ip", text(), "bidirectional_flow_ratio"), ["bidirectional_flow_ratio"])


# --- labels ------------------------------------------------------------------------


def _truth(spark, sf):
    """Ground truth: flows with a large value have the stage of their type. The
    addresses are padded."""
    ev = labels.map_label(flows(spark, sf), "label", EVENT_STAGES)
    loud = F.when(F.col("orig_bytes") > 300, F.col("stage")).otherwise(0)
    return ev.withColumns({"stage": loud, "src_ip": F.concat(F.col("src_ip"), F.lit(" "))})


@query
def attack_db(spark, sf):
    return labels.attack_database(_truth(spark, sf))


@query
def entity_label(spark, sf):
    out = labels.label_by_entity(windows(spark, sf), labels.attack_database(_truth(spark, sf)))
    return out.select("src_ip", text(), "stage", "prob")


@query
def attacker_list_label(spark, sf):
    stages = {str(i): i % 5 for i in range(0, 40, 3)}
    out = labels.label_by_attackers(windows(spark, sf, gap_fill=False), stages)
    return out.groupBy("stage", "prob").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_ip").alias("sources"))


@query
def entity_window_label(spark, sf):
    out = labels.label_by_entity_window(windows(spark, sf), _truth(spark, sf), HOUR)
    return out.select("src_ip", text(), "stage")


def _daily_intervals(spark, sf):
    late = (F.col("label") == "error") & (F.hour("ts") >= 12)
    return labels.attack_intervals(flows(spark, sf), ["src_ip", F.to_date("ts").alias("day")], "ts", late)


@query
def interval_label(spark, sf):
    out = labels.label_by_intervals(
        windows(spark, sf).withColumn("end_ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")),
        _daily_intervals(spark, sf), "end_ts", "src_ip", HORIZONS, bucket_seconds=10 * DAY,
        partitions=window_tasks(spark, sf),
    )
    return out.select("src_ip", text(), "label")


@query
def interval_label_network(spark, sf):
    """One interval list for all sources: the flows of the largest values."""
    big = F.col("orig_bytes") > 250
    spans = labels.attack_intervals(flows(spark, sf), [F.window("ts", "6 hours")], "ts", big)
    out = labels.label_by_intervals(windows(spark, sf), spans.select("start", "end"), "ts", None, HORIZONS, bucket_seconds=DAY)
    return out.groupBy("src_ip", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def boundary_exclusion(spark, sf):
    out = labels.clear_of_boundaries(
        windows(spark, sf), _daily_intervals(spark, sf), 1_800, "ts", "src_ip", HORIZONS,
        bucket_seconds=10 * DAY, partitions=window_tasks(spark, sf),
    )
    return out.select("src_ip", text())


# --- sequences ---------------------------------------------------------------------


def _labelled_active(spark, sf):
    rows = windows(spark, sf, gap_fill=False).withColumn("orig_pkts", F.lit(0))
    return labels.label_by_entity(sequences.drop_silent(rows), labels.attack_database(_truth(spark, sf)))


def _position_sum(flat):
    """Sum of position · value: changes with any swap of steps or features."""
    weighted = F.transform(flat, lambda v, i: v * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v), 4)


@query
def sequences_stride6(spark, sf):
    out = sequences.make_sequences(_labelled_active(spark, sf), features=WINDOW_COLUMNS, bucket_seconds=BUCKET)
    return out.select(
        "src_ip", "seq_id", text("start_ts"), text("end_ts"), "label", "prob",
        _position_sum(F.flatten("x")).alias("x_sum"),
    )


@query
def sequences_sliding(spark, sf):
    out = sequences.sliding_sequences(windows(spark, sf), features=WINDOW_COLUMNS, step=HOUR)
    return out.select("src_ip", text(), _position_sum(F.flatten("x")).alias("x_sum"))


@query
def sequences_sliding_active(spark, sf):
    """Sliding over windows with traffic, where time does not give the position."""
    out = sequences.sliding_sequences(
        windows(spark, sf, gap_fill=False), features=WINDOW_COLUMNS, bucket_seconds=BUCKET
    )
    return out.select("src_ip", text(), _position_sum(F.flatten("x")).alias("x_sum"))


@query
def flatten_sequence(spark, sf):
    out = sequences.make_sequences(_labelled_active(spark, sf), features=WINDOW_COLUMNS, bucket_seconds=BUCKET)
    flat = sequences.flatten_sequence(out).select("src_ip", "seq_id", F.posexplode("flat").alias("position", "v"))
    return rounded(flat, ["v"])


# --- scaling -----------------------------------------------------------------------


@query
def robust_scaler_fit(spark, sf):
    out = fit_robust_scaler(vectors(spark, sf), VECTOR).table(spark)
    return rounded(out.select("feature", "center", "scale"), ["center", "scale"], 9)


@query
def robust_scaler_apply(spark, sf):
    rows = vectors(spark, sf)
    scaled = fit_robust_scaler(rows, VECTOR).apply(rows)
    out = scaled.select("vec_id", F.posexplode(F.array(*VECTOR)).alias("position", "v"))
    return rounded(out, ["v"])


# --- sampling ----------------------------------------------------------------------


@query
def cap_by_class(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sampling.cap_by_class(docs, "lang", {"en": 150, "de": 40, "fr": 100_000}, 42, "doc_id")


@query
def sample_by_class(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.sample_by_class(docs, "lang", {"en": 0.05}, 42, "doc_id")


@query
def balance_active(spark, sf):
    rows = sampling.with_row_key(windows(spark, sf).withColumn("orig_pkts", F.lit(0)), ["src_ip"], "k")
    rows = rows.withColumn("id", F.concat_ws("|", "k", F.unix_seconds("ts").cast("string")))
    labelled = labels.label_by_entity(rows, labels.attack_database(_truth(spark, sf)))
    labelled = materialise(labelled, "active")
    out = sampling.balance_active(labelled, "stage", 0, 1_500, 42, "id")
    return out.select("id", "stage")


@query
def balance_sequences(spark, sf):
    seqs = sequences.make_sequences(_labelled_active(spark, sf), features=WINDOW_COLUMNS, bucket_seconds=BUCKET)
    keyed = sampling.with_row_key(seqs, ["src_ip", "seq_id"], "id")
    out = sampling.balance_sequences(materialise(keyed.select("id", "label"), "sequences"), "label", 0, floor=50, ratio=2, seed=42, row_id="id")
    return out.select("id", "label")


@query
def balance_risk(spark, sf):
    labelled = labels.lookahead_label(
        net_windows(spark, sf, "src_ip"), "src_ip", horizons=HORIZONS, bucket_seconds=BUCKET
    )
    keyed = labelled.withColumn("id", F.concat_ws("|", "src_ip", F.unix_seconds("ts").cast("string")))
    out = sampling.balance_risk(materialise(keyed.select("id", "label"), "risk"), "label", ratio=1, seed=42, row_id="id")
    return out.select("id", "label")


@query
def hash_split(spark, sf):
    out = sampling.hash_split(table(spark, sf, "documents"), 0.8, 42, "doc_id")
    return out.select("doc_id", "part")


@query
def stratified_split(spark, sf):
    out = sampling.stratified_split(table(spark, sf, "documents"), "lang", 0.2, 0.1, 42, "doc_id")
    return out.select("doc_id", "lang", "part")


@query
def chronological_split(spark, sf):
    out = sampling.chronological_split(flows(spark, sf), "ts", 0.8)
    return out.select("uid", "part")


@query
def shuffled_order(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", row_hash(42, "doc_id").alias("h"))
    return sampling.shuffle_rank(docs, 42, "doc_id")


@query
def fuse_datasets(spark, sf):
    """Risk windows of the two flow sets under one schema."""
    first = labels.lookahead_label(net_windows(spark, sf), None, horizons=HORIZONS, bucket_seconds=BUCKET)
    li = table(spark, sf, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    second = net_window_features(
        li, "l_returnflag", "ts", DAY,
        counted="l_orderkey", syn=(F.col("l_linenumber") == 1).cast("int"), size=cents("l_extendedprice"),
        duration="l_quantity", fwd=F.col("l_quantity").cast("long"), bwd=F.col("l_linenumber").cast("long"),
        rate=cents("l_tax"), attack=(F.col("l_discount") >= 0.1).cast("int"), bucket_seconds=365 * DAY,
    )
    second = labels.lookahead_label(
        second, "l_returnflag", horizons=[(n, s * 24) for n, s in HORIZONS], bucket_seconds=365 * DAY
    )
    fused = sampling.fuse({"a": first, "b": second.drop("l_returnflag")})
    return fused.groupBy("dataset", "label", "y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("connections_per_sec"), 6).alias("rate")
    )


# --- metrics -----------------------------------------------------------------------


@query
def class_distribution(spark, sf):
    out = metrics.class_distribution(flows(spark, sf), "label", [*EVENT_STAGES, "scan"])
    return rounded(out, ["pct"], 9)


@query
def class_weights(spark, sf):
    out = metrics.class_weights(table(spark, sf, "embeddings"), "label", list(range(12)))
    return rounded(out, ["weight"], 9)


@query
def active_sources(spark, sf):
    out = metrics.activity(flows(spark, sf))
    return out.select("sources", text("first_ts"), text("last_ts"))


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic")


@query
def classification_report(spark, sf):
    out = metrics.classification_report(predictions(spark, sf).withColumn("truth", F.col("flow_count").cast("int")), "truth", "stage")
    return rounded(out, ["precision", "recall", "f1"], 9)


@query
def report_summary(spark, sf):
    out = metrics.report_summary(predictions(spark, sf).withColumn("truth", F.col("flow_count").cast("int")), "truth", "stage")
    return rounded(out, [c for c in out.columns if c != "rows"], 9)


@query
def macro_fpr(spark, sf):
    out = metrics.macro_fpr(table(spark, sf, "labels"), "quality", "toxic")
    return rounded(out, ["macro_fpr"], 9)


@query
def ovr_roc_auc(spark, sf):
    out = metrics.ovr_curves(scored_vectors(spark, sf), "label", "probs", 10, bins=16)
    return rounded(out.select("class", "positives", "roc_auc"), ["roc_auc"], 9)


@query
def average_precision(spark, sf):
    out = metrics.ovr_curves(scored_vectors(spark, sf), "label", "probs", 10, bins=16)
    return rounded(out.select("class", "average_precision"), ["average_precision"], 9)


@query
def weighted_ovr_scores(spark, sf):
    out = metrics.weighted_ovr(metrics.ovr_curves(scored_vectors(spark, sf), "label", "probs", 10, bins=16))
    return rounded(out, ["roc_auc", "average_precision"], 9)


@query
def log_loss(spark, sf):
    loss = metrics.cross_entropy("label", "probs")
    return rounded(metrics.reduce_loss(scored_vectors(spark, sf), loss), ["loss"], 9)


@query
def focal_loss(spark, sf):
    loss = metrics.focal("label", "probs", 2.0)
    each = metrics.reduce_loss(scored_vectors(spark, sf), loss, "none")
    return rounded(each.select("vec_id", "loss"), ["loss"], 9)


@query
def binary_log_loss(spark, sf):
    rows = flows(spark, sf).select(
        (F.col("label") == "error").cast("int").alias("y"),
        (F.col("orig_bytes") / (F.col("orig_bytes") + 50)).alias("p"),
    )
    out = metrics.reduce_loss(rows, metrics.binary_cross_entropy("y", "p"), "sum")
    return rounded(out, ["loss"], 4)


@query
def best_model(spark, sf):
    """Best hour of the day as predictor of errors, by share of hits."""
    scores = flows(spark, sf).groupBy(F.hour("ts").cast("string").alias("model")).agg(
        F.round(F.avg((F.col("label") == "error").cast("int")), 9).alias("macro_f1")
    )
    return metrics.best_model(scores)


# --- scores, alerts, views ---------------------------------------------------------


@query
def softmax_argmax(spark, sf):
    out = scored_vectors(spark, sf).select(
        "vec_id", P.argmax("probs").alias("pred"), F.round(F.array_max("probs"), 9).alias("confidence"),
    )
    return out


@query
def next_stage(spark, sf):
    stage = P.next_stage("threat_prob", "stage")
    return predictions(spark, sf).select(
        "src_ip", text(), "stage", stage.alias("next_stage"),
        S.class_name(stage, STAGE_NAMES).alias("next_name"),
    )


@query
def status_band(spark, sf):
    return predictions(spark, sf).select(
        "src_ip", text(), P.status_band("confidence", "stage").alias("status")
    )


@query
def stage_alerts(spark, sf):
    out = forecast.stage_alerts(predictions(spark, sf), bucket_seconds=BUCKET)
    return out.select("src_ip", text(), "stage", "severity")


@query
def newest_alerts(spark, sf):
    out = forecast.stage_alerts(predictions(spark, sf), bucket_seconds=BUCKET)
    return forecast.newest(out, 3, "ts", ("src_ip",)).select("src_ip", text(), "stage", "severity")


@query
def latest_telemetry(spark, sf):
    rows = predictions(spark, sf).withColumn("stage_name", S.class_name("stage", STAGE_NAMES))
    rates = windows(spark, sf, gap_fill=False).withColumn("flag_syn", F.col("distinct_ports"))
    out = forecast.telemetry(rows, rates, HOUR, 100)
    return rounded(
        out.select("src_ip", text(), "stage_name", "threat_prob", "connections_per_sec", "syn_rate"),
        ["threat_prob", "connections_per_sec", "syn_rate"],
    )


@query
def first_rows(spark, sf):
    out = forecast.first_rows(flows(spark, sf), 1_000, "src_ip", "ts", ("uid",))
    return out.select("src_ip", "uid", text())


@query
def sequence_timeline(spark, sf):
    rows = predictions(spark, sf).withColumn("stage_name", S.class_name("stage", STAGE_NAMES))
    out = forecast.timeline(rows, bucket_seconds=BUCKET)
    return rounded(out, ["threat_prob", "confidence"])


@query
def prediction_history(spark, sf):
    out = forecast.history(predictions(spark, sf), 5)
    return rounded(out.select("src_ip", text(), "rank", "stage", "threat_prob"), ["threat_prob"])


@query
def current_status(spark, sf):
    rows = predictions(spark, sf).withColumn("stage_name", S.class_name("stage", STAGE_NAMES))
    out = forecast.current_status(rows).select("src_ip", text(), "stage_name", "next_stage", "status")
    return out


@query
def criticality_score(spark, sf):
    """Probability weighted by the account balance of the customer as asset."""
    assets = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("src_ip"), (F.lit(1) + F.col("c_acctbal") / 10_000).alias("weight")
    )
    rows = predictions(spark, sf).withColumn("prob", F.col("threat_prob") / 100)
    out = forecast.criticality_score(rows, assets)
    return rounded(out.select("src_ip", text(), "risk_score"), ["risk_score"], 11)


@query
def top_k_features(spark, sf):
    emb = table(spark, sf, "embeddings")
    top = forecast.top_k_features("embedding", VECTOR, 8)
    out = emb.select("vec_id", F.posexplode(top).alias("rank", "t")).select("vec_id", "rank", "t.feature", "t.share")
    return rounded(out, ["share"])


@query
def percent_weights(spark, sf):
    emb = table(spark, sf, "embeddings")
    quiet = F.when(F.col("label") == 0, F.transform("embedding", lambda v: v * 0)).otherwise(F.col("embedding"))
    out = emb.select("vec_id", F.posexplode(P.percent_weights(quiet)).alias("position", "share"))
    return rounded(out, ["share"])


@query
def ovr_vote(spark, sf):
    rows = scored_vectors(spark, sf)
    vote = P.ovr_vote([F.col("probs")[i] * 3 for i in range(10)], [f"c{i}" for i in range(10)])
    return rows.select("vec_id", vote.alias("pred"))


@query
def prediction_json(spark, sf):
    names = [n for n, _ in sorted(RISK_CLASSES.items(), key=lambda kv: kv[1])]
    rows = scored_vectors(spark, sf, 4)
    return rows.select("vec_id", P.prediction_json("probs", names).alias("record"))


@query
def linear_explain(spark, sf):
    """Contributions to a linear score whose coefficients are the distance of
    the class-1 mean from the overall mean."""
    rows = vectors(spark, sf)
    means = rows.agg(
        *[F.avg(c).alias(c) for c in VECTOR],
        *[F.avg(F.when(F.col("label") == 1, F.col(c))).alias(f"one_{c}") for c in VECTOR],
    ).first()
    mean = [means[c] for c in VECTOR]
    coef = [means[f"one_{c}"] - means[c] for c in VECTOR]
    x = rows.select("vec_id", F.array(*VECTOR).alias("x"))
    out = forecast.explain(x, "x", coef, mean, VECTOR, 8)
    return rounded(
        out.select("vec_id", F.posexplode("contributions").alias("position", "contribution")), ["contribution"], 9
    )


@query
def knn_vote(spark, sf):
    rows = sampling.hash_split(table(spark, sf, "embeddings"), 0.8, 42, "vec_id")
    out = knn_classify(
        rows.filter("part = 'train'"), rows.filter("part = 'test'"), "embedding", "label", "vec_id", 5
    )
    return rounded(out, ["nearest"])
