"""Table schemas and feature lists."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names and orders of the telemetry files -------------

# Numeric columns of a flow record that are averaged per window.
FLOW_MEANS = [
    "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
    "min_ttl_orig", "max_ttl_orig", "min_ttl_resp", "max_ttl_resp",
    "avg_win_orig", "avg_win_resp",
    "payload_min_orig", "payload_max_orig", "payload_min_resp", "payload_max_resp",
    "frag_count", "retrans_orig", "retrans_resp",
    "flag_syn", "flag_ack", "flag_fin", "flag_rst", "flag_psh", "flag_urg",
    "iat_mean", "iat_max", "iat_var",
]

# Model inputs of one per-source window.
WINDOW_FEATURES = FLOW_MEANS + [
    "flow_count", "unique_dest_ports_scan_signature", "bidirectional_flow_ratio",
]

# Model inputs of one network-wide window.
NET_FEATURES = [
    "connections_per_sec", "syn_rate", "avg_packet_size", "flow_duration_mean",
    "fwd_packets_sum", "bwd_packets_sum", "flow_packets_s_mean",
    "connections_per_sec_diff", "syn_rate_diff", "connections_1m_avg",
    "syn_rate_1m_avg", "packet_size_1m_avg",
]

# Sensor log names to canonical names (dots would need back-ticks in Spark).
SENSOR_RENAMES = {
    "id.orig_h": "src_ip",
    "id.orig_p": "src_port",
    "id.resp_h": "dst_ip",
    "id.resp_p": "dst_port",
}

# Positional columns of the headerless 49-column flow file.
POSITIONAL_FLOW_COLUMNS = [
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes",
    "sttl", "dttl", "sloss", "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts",
    "swin", "dwin", "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth", "res_bdy_len",
    "Sjit", "Djit", "Stime", "Ltime", "Sintpkt", "Dintpkt", "tcprtt", "synack", "ackdat",
    "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd",
    "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm",
    "ct_dst_sport_ltm", "ct_dst_src_ltm", "attack_cat", "Label",
]

# Columns of the labelled numeric flow file, after trimming the header.
LABELLED_FLOW_COLUMNS = [
    "Timestamp", "Label", "SYN Flag Count", "Average Packet Size", "Flow Duration",
    "Total Fwd Packets", "Total Backward Packets", "Flow Packets/s",
]

# Rows per sequence.
SEQUENCE_LENGTH = 6

# --- Spark schemas -------------------------------------------------------------

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _TIME, _INT, _DOUBLE = T.StringType(), T.TimestampType(), T.IntegerType(), T.DoubleType()
_DOUBLES = T.ArrayType(_DOUBLE)

PACKETS = _struct(
    ts=_TIME, uid=_TEXT, src_ip=_TEXT, dst_ip=_TEXT, is_orig=T.BooleanType(),
    ip_version=_INT, ttl=_INT, ip_len=_INT, is_tcp=T.BooleanType(), tcp_flags=_INT,
    tcp_win=_INT, frame_len=_INT,
)

FLOWS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("uid", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("service", T.StringType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in FLOW_MEANS]
)

WINDOWS = T.StructType(
    [T.StructField("src_ip", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(name, T.DoubleType()) for name in WINDOW_FEATURES]
)

SEQUENCES = _struct(
    src_ip=_TEXT, seq_id=T.LongType(), start_ts=_TIME, end_ts=_TIME,
    x=T.ArrayType(_DOUBLES), label=_INT, prob=_DOUBLE,
)

PREDICTIONS = _struct(
    src_ip=_TEXT, ts=_TIME, stage=_INT, stage_name=_TEXT, confidence=_DOUBLE,
    threat_prob=_DOUBLE, probs=_DOUBLES, attn=_DOUBLES,
)

WEIGHTS = _struct(name=_TEXT, shape=T.ArrayType(_INT), data=_DOUBLES)


def sensor_log_schema(fields: list[str]) -> T.StructType:
    """All-text schema for a sensor log whose header lists ``fields``."""
    return T.StructType(
        [T.StructField(SENSOR_RENAMES.get(name, name), T.StringType()) for name in fields]
    )


def positional_flow_schema() -> T.StructType:
    return T.StructType(
        [T.StructField(name, T.StringType()) for name in POSITIONAL_FLOW_COLUMNS]
    )
