"""DuckDB statements that compute the catalogue independently of Spark."""

from __future__ import annotations

FLOWS = """
flows AS (
  SELECT CAST(user_id AS VARCHAR) AS src_ip, CAST(ts AS TIMESTAMP) AS ts, event_id AS uid,
         event_type AS label, value AS orig_bytes,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k
  FROM events)"""

# Hourly windows with traffic, and the same with the gaps filled.
WIN = FLOWS + """,
win AS (
  SELECT src_ip, date_trunc('hour', ts) AS ts, avg(orig_bytes) AS orig_bytes, avg(k) AS resp_bytes,
         count(uid) AS flow_count, count(DISTINCT label) AS distinct_ports
  FROM flows GROUP BY 1, 2)"""
FILLED = WIN + """,
spine AS (
  SELECT src_ip, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
  FROM win GROUP BY src_ip),
filled AS (
  SELECT s.src_ip, s.ts, coalesce(w.orig_bytes, 0) AS orig_bytes, coalesce(w.resp_bytes, 0) AS resp_bytes,
         coalesce(w.flow_count, 0) AS flow_count, coalesce(w.distinct_ports, 0) AS distinct_ports
  FROM spine s LEFT JOIN win w USING (src_ip, ts))"""

NET_AGGS = """count(uid) / 3600.0 AS connections_per_sec,
         sum(CASE WHEN label = 'click' THEN 1 ELSE 0 END) / 3600.0 AS syn_rate,
         avg(orig_bytes) AS avg_packet_size, avg(k) AS flow_duration_mean,
         CAST(sum(k) AS BIGINT) AS fwd_packets_sum, CAST(sum(length(label)) AS BIGINT) AS bwd_packets_sum,
         avg(orig_bytes / 2) AS flow_packets_s_mean,
         max(CASE WHEN label = 'error' THEN 1 ELSE 0 END) AS attack_active"""
NET_COLS = [
    "connections_per_sec", "syn_rate", "avg_packet_size", "flow_duration_mean",
    "fwd_packets_sum", "bwd_packets_sum", "flow_packets_s_mean", "attack_active",
]
NET_ZERO = ", ".join(f"coalesce(w.{c}, 0) AS {c}" for c in NET_COLS)
NET_ALL = FLOWS + f""",
nw AS (SELECT date_trunc('hour', ts) AS ts, {NET_AGGS} FROM flows GROUP BY 1),
nspine AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM nw),
net AS (SELECT s.ts, {NET_ZERO} FROM nspine s LEFT JOIN nw w USING (ts))"""
NET_SRC = FLOWS + f""",
nw AS (SELECT src_ip, date_trunc('hour', ts) AS ts, {NET_AGGS} FROM flows GROUP BY 1, 2),
nspine AS (SELECT src_ip, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM nw GROUP BY src_ip),
net AS (SELECT s.src_ip, s.ts, {NET_ZERO} FROM nspine s LEFT JOIN nw w USING (src_ip, ts))"""


def daily(attack: str) -> str:
    """Daily windows of the order lines, one capture per return flag."""
    return f"""
dw AS (
  SELECT l_returnflag, date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) AS ts,
         count(l_orderkey) / 86400.0 AS connections_per_sec,
         sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) / 86400.0 AS syn_rate,
         avg(CAST(round(l_extendedprice * 100) AS BIGINT)) AS avg_packet_size, avg(l_quantity) AS flow_duration_mean,
         CAST(sum(l_quantity) AS BIGINT) AS fwd_packets_sum, CAST(sum(l_linenumber) AS BIGINT) AS bwd_packets_sum,
         avg(CAST(round(l_tax * 100) AS BIGINT)) AS flow_packets_s_mean,
         max(CASE WHEN l_discount >= {attack} THEN 1 ELSE 0 END) AS attack_active
  FROM lineitem GROUP BY 1, 2),
dspine AS (
  SELECT l_returnflag, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM dw GROUP BY 1),
daily AS (SELECT s.l_returnflag, s.ts, {NET_ZERO} FROM dspine s LEFT JOIN dw w USING (l_returnflag, ts))"""


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
HORIZON = """CASE WHEN {active} THEN 'IMMINENT' WHEN gap <= {h} THEN 'IMMINENT'
       WHEN gap <= 4 * {h} THEN 'NEAR-TERM' WHEN gap <= 10 * {h} THEN 'ELEVATED' ELSE 'NORMAL' END"""


def lookahead(source: str, by: str | None, h: int = 10_800) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""
ahead AS (
  SELECT *, epoch(min(CASE WHEN attack_active = 1 THEN ts END) OVER
    ({part}ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) - epoch(ts) AS gap
  FROM {source}),
risk AS (SELECT *, {HORIZON.format(active="attack_active = 1", h=h)} AS label FROM ahead)"""


STAGE = "CASE label WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 0 END"
TRUTH = f"""
truth AS (SELECT src_ip, ts, CASE WHEN orig_bytes > 300 THEN {STAGE} ELSE 0 END AS stage FROM flows),
db AS (SELECT src_ip, max(stage) AS stage FROM truth WHERE stage > 0 GROUP BY 1)"""

PRED = WIN + """,
pred AS (
  SELECT src_ip, ts, CAST(floor(resp_bytes) AS INTEGER) % 5 AS stage, least(100.0, orig_bytes * 2) AS threat_prob,
         100.0 - least(100.0, orig_bytes / 2) AS confidence, CAST(flow_count AS INTEGER) AS flow_count,
         distinct_ports
  FROM win)"""
STAGE_NAME = """CASE {s} WHEN 0 THEN 'Normal' WHEN 1 THEN 'Reconnaissance' WHEN 2 THEN 'Initial Access'
  WHEN 3 THEN 'Lateral Movement' ELSE 'Command & Control' END"""
ALERTS = PRED + """,
loud AS (SELECT *, lag(stage) OVER (PARTITION BY src_ip ORDER BY ts) AS before FROM pred WHERE threat_prob > 75),
alerts AS (SELECT src_ip, ts, stage, CASE WHEN threat_prob > 90 THEN 'critical' ELSE 'warning' END AS severity
  FROM loud WHERE before IS NULL OR before <> stage)"""
NEXT = "CASE WHEN threat_prob > 50 AND stage < 4 THEN stage + 1 ELSE stage END"
STATUS = """CASE WHEN confidence < 75 OR stage = 0 THEN 'MONITORING' WHEN confidence < 90 THEN 'ELEVATED'
  ELSE 'CRITICAL' END"""

EMB = """
emb AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i
  FROM embeddings)"""


def softmax(classes: int) -> str:
    return EMB + f""",
powers AS (
  SELECT vec_id, label, i, exp(l - max(l) OVER (PARTITION BY vec_id)) AS e
  FROM (SELECT vec_id, label, i % {classes} AS i, sum(v ORDER BY i) * 10 AS l FROM emb GROUP BY vec_id, label, i % {classes})),
probs AS (SELECT vec_id, label, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM powers)"""


CURVES = softmax(10) + """,
scores AS (
  SELECT i AS class, p, count(*) AS n, sum(CASE WHEN label = i THEN 1 ELSE 0 END) AS pos FROM probs GROUP BY 1, 2),
cum AS (
  SELECT class, pos, n - pos AS neg,
         sum(pos) OVER (PARTITION BY class ORDER BY p DESC) AS tp,
         sum(n - pos) OVER (PARTITION BY class ORDER BY p DESC) AS fp,
         sum(pos) OVER (PARTITION BY class) AS np, sum(n - pos) OVER (PARTITION BY class) AS nn
  FROM scores),
curves AS (
  SELECT CAST(class AS INTEGER) AS class, CAST(max(np) AS BIGINT) AS positives,
         sum(pos * (nn - fp + neg / 2.0)) / (max(np) * max(nn)) AS roc_auc,
         sum(pos * tp / (tp + fp)) / max(np) AS average_precision
  FROM cum GROUP BY class)"""


def row_hash(row_id: str) -> str:
    return f"CAST(('0x' || substr(md5('42|' || {row_id}), 1, 8)) AS UBIGINT)"


def report(matrix: str) -> str:
    """Per-class counts and ratios from (t, p) pairs."""
    return matrix + """,
classes AS (SELECT t AS class FROM pairs UNION SELECT p FROM pairs),
counts AS (
  SELECT class, (SELECT count(*) FROM pairs WHERE t = class AND p = class) AS tp,
         (SELECT count(*) FROM pairs WHERE t = class) AS support,
         (SELECT count(*) FROM pairs WHERE p = class) AS predicted
  FROM classes),
report AS (
  SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
         CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1,
         support, tp, predicted
  FROM counts)"""


PAIRS = PRED + ", pairs AS (SELECT flow_count AS t, stage AS p FROM pred)"
QUALITY = "pairs AS (SELECT quality AS t, toxic AS p FROM labels)"

ACTIVE = WIN + "," + TRUTH + """,
active AS (
  SELECT w.*, coalesce(db.stage, 0) AS label, CASE WHEN db.stage IS NULL THEN 0.0 ELSE 1.0 END AS prob,
         row_number() OVER (PARTITION BY w.src_ip ORDER BY w.ts) - 1 AS pos
  FROM win w LEFT JOIN db USING (src_ip) WHERE orig_bytes > 0 OR resp_bytes > 0),
seqs AS (
  SELECT src_ip, pos // 6 AS seq_id, min(ts) AS start_ts, max(ts) AS end_ts,
         arg_max(label, pos) AS label, arg_max(prob, pos) AS prob,
         sum((pos % 6 * 4 + 1) * orig_bytes + (pos % 6 * 4 + 2) * resp_bytes
             + (pos % 6 * 4 + 3) * flow_count + (pos % 6 * 4 + 4) * distinct_ports) AS x_sum
  FROM active GROUP BY 1, 2 HAVING count(*) = 6)"""


def sliding(source: str) -> str:
    """Position-weighted sum over the six rows before each row."""
    terms = " + ".join(
        f"""{4 * s + 1} * lag(orig_bytes, {6 - s}) OVER w + {4 * s + 2} * lag(resp_bytes, {6 - s}) OVER w
         + {4 * s + 3} * lag(flow_count, {6 - s}) OVER w + {4 * s + 4} * lag(distinct_ports, {6 - s}) OVER w"""
        for s in range(6)
    )
    return f"""
slid AS (
  SELECT src_ip, ts, row_number() OVER w AS rn, {terms} AS x_sum
  FROM {source} WINDOW w AS (PARTITION BY src_ip ORDER BY ts))
SELECT src_ip, {TS}, round(x_sum, 4) AS x_sum FROM slid WHERE rn > 6"""


PACKETS = """
packets AS (
  SELECT l_orderkey AS uid,
         epoch(CAST(l_shipdate AS TIMESTAMP)) + l_linenumber * l_linenumber + l_suppkey % 7 AS t,
         CAST(l_suppkey AS VARCHAR) AS src_ip, l_linenumber % 2 = 1 AS o, l_linestatus = 'F' AS v4,
         CAST(l_quantity AS INTEGER) AS ttl, CAST(l_partkey % 1500 AS INTEGER) AS len,
         l_returnflag <> 'R' AS tcp, CAST(l_partkey % 64 AS INTEGER) AS flags, l_suppkey % 1000 AS win
  FROM lineitem)"""
FLAG_BITS = {"syn": 2, "ack": 16, "fin": 1, "rst": 4, "psh": 8, "urg": 32}


def attacked_intervals(label: str, extra: str = "") -> str:
    return f"""
iv AS (
  SELECT src_ip, min(ts) AS s, max(ts) AS e FROM flows
  WHERE label = 'error' AND hour(ts) >= 12 GROUP BY src_ip, CAST(ts AS DATE)),
timed AS (
  SELECT f.src_ip, f.ts, bool_or(iv.s <= {label} AND {label} <= iv.e) AS inside,
         min(CASE WHEN iv.s > {label} THEN (epoch_us(iv.s) - epoch_us({label})) / 1e6 END) AS gap
  FROM filled f LEFT JOIN iv ON iv.src_ip = f.src_ip GROUP BY 1, 2{extra})"""


def quotas(source: str, row_id: str, label: str, quota: str) -> str:
    """Rows of ``source`` within the quota of their class, lowest hashes first."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {row_hash(row_id)}, {row_id}) AS rn FROM {source}),
kept AS (SELECT * FROM ranked WHERE rn <= {quota})"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


ORACLES: dict[str, str] = {}

ORACLES["win_features_gapfilled"] = with_(FILLED, f"""
SELECT src_ip, {TS}, round(orig_bytes, 6) AS orig_bytes, round(resp_bytes, 6) AS resp_bytes,
       flow_count, distinct_ports FROM filled""")
ORACLES["win_features_dense_only"] = with_(WIN, f"""
SELECT src_ip, {TS}, round(orig_bytes, 6) AS orig_bytes, round(resp_bytes, 6) AS resp_bytes,
       flow_count, distinct_ports FROM win""")


_ALL = """,
one AS (SELECT date_trunc('hour', ts) AS ts, avg(orig_bytes) AS orig_bytes, avg(k) AS resp_bytes,
               count(uid) AS flow_count, count(DISTINCT label) AS distinct_ports FROM flows GROUP BY 1),
steps AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM one)"""
ORACLES["win_features_without_key"] = with_(FLOWS + _ALL, f"""
SELECT {TS}, round(coalesce(orig_bytes, 0), 6) AS orig_bytes, round(coalesce(resp_bytes, 0), 6) AS resp_bytes,
       coalesce(flow_count, 0) AS flow_count, coalesce(distinct_ports, 0) AS distinct_ports
FROM steps LEFT JOIN one USING (ts)""")
ORACLES["win_features_null_key"] = with_(WIN, f"""
SELECT src_ip, {TS}, round(orig_bytes, 6) AS orig_bytes, round(resp_bytes, 6) AS resp_bytes,
       flow_count, distinct_ports FROM win WHERE CAST(src_ip AS INTEGER) % 10 <> 0""")


def _net_select(digits: int, keys: str = "") -> str:
    plain = {"fwd_packets_sum", "bwd_packets_sum", "attack_active"}
    cols = ", ".join(c if c in plain else f"round({c}, {digits}) AS {c}" for c in NET_COLS)
    return f"SELECT {keys}{TS}, {cols} FROM "


ORACLES["net_window_features_all"] = with_(NET_ALL, _net_select(6) + "net")
ORACLES["net_window_features_by_capture"] = with_(daily("0.09"), _net_select(4, "l_returnflag, ") + "daily")
TRENDS = """
trends AS (
  SELECT *, coalesce(connections_per_sec - lag(connections_per_sec) OVER w, 0) AS connections_per_sec_diff,
         coalesce(syn_rate - lag(syn_rate) OVER w, 0) AS syn_rate_diff,
         avg(connections_per_sec) OVER r AS connections_1m_avg, avg(syn_rate) OVER r AS syn_rate_1m_avg,
         avg(avg_packet_size) OVER r AS packet_size_1m_avg
  FROM net WINDOW w AS (PARTITION BY src_ip ORDER BY ts),
                  r AS (PARTITION BY src_ip ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""
ORACLES["trend_features_by_source"] = with_(NET_SRC + "," + TRENDS, f"""
SELECT src_ip, {TS}, round(connections_per_sec_diff, 6) AS connections_per_sec_diff,
       round(syn_rate_diff, 6) AS syn_rate_diff, round(connections_1m_avg, 6) AS connections_1m_avg,
       round(syn_rate_1m_avg, 6) AS syn_rate_1m_avg, round(packet_size_1m_avg, 6) AS packet_size_1m_avg
FROM trends""")
ORACLES["trend_features_active_rows"] = with_(WIN + """,
d AS (
  SELECT src_ip, ts, coalesce(orig_bytes - lag(orig_bytes) OVER (PARTITION BY src_ip ORDER BY ts), 0) AS bytes_diff,
         avg(orig_bytes) OVER (PARTITION BY src_ip ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS bytes_avg
  FROM win)""", f"SELECT src_ip, {TS}, round(bytes_diff, 6) AS bytes_diff, round(bytes_avg, 6) AS bytes_avg FROM d")
ORACLES["lookahead_label_by_source"] = with_(
    NET_SRC + "," + lookahead("net", "src_ip"), f"SELECT src_ip, {TS}, attack_active, label FROM risk")
ORACLES["risk_class_distribution"] = with_(NET_SRC + "," + TRENDS + "," + lookahead("trends", "src_ip"), """
SELECT label, count(*) AS n, CAST(sum(CASE WHEN connections_per_sec_diff > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rising,
       round(avg(connections_1m_avg), 9) AS connections_1m_avg FROM risk GROUP BY label""")
ORACLES["rolling_slope"] = with_(NET_SRC + """,
n0 AS (SELECT src_ip, ts, connections_per_sec * 3600 AS n, row_number() OVER (PARTITION BY src_ip ORDER BY ts) AS x FROM net),
n1 AS (
  SELECT src_ip, ts, (n - lag(n) OVER w) / nullif(lag(n) OVER w, 0) AS n_pct_change, avg(n) OVER r AS n_roll_mean,
         stddev_samp(n) OVER r AS n_roll_std, regr_slope(n, x) OVER r AS n_slope
  FROM n0 WINDOW w AS (PARTITION BY src_ip ORDER BY ts),
                 r AS (PARTITION BY src_ip ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""", f"""
SELECT src_ip, {TS}, round(n_pct_change, 6) AS n_pct_change, round(n_roll_mean, 6) AS n_roll_mean,
       round(n_roll_std, 6) AS n_roll_std, round(n_slope, 6) AS n_slope FROM n1""")
ORACLES["traffic_mix_by_source"] = with_(FLOWS + """,
m AS (
  SELECT src_ip, date_trunc('day', ts) AS ts, 100.0 * avg(CASE WHEN label = 'error' THEN 1 ELSE 0 END) AS failed_pct,
         sum(CASE WHEN label IN ('click', 'view') THEN 1 ELSE 0 END)
           / nullif(sum(CASE WHEN label = 'signup' THEN 1 ELSE 0 END), 0) AS tcp_udp_ratio,
         sum(k) / nullif(sum(orig_bytes), 0) AS in_out_ratio, count(DISTINCT label) AS distinct_ports
  FROM flows GROUP BY 1, 2)""", f"""
SELECT src_ip, {TS}, round(failed_pct, 6) AS failed_pct, round(tcp_udp_ratio, 6) AS tcp_udp_ratio,
       round(in_out_ratio, 6) AS in_out_ratio, distinct_ports FROM m""")

# --- packets -----------------------------------------------------------------------

_SIDES = ", ".join(
    f"""sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS {n}_pkts,
  min(CASE WHEN {c} AND v4 THEN ttl END) AS min_ttl_{n}, max(CASE WHEN {c} AND v4 THEN ttl END) AS max_ttl_{n},
  min(CASE WHEN {c} AND v4 THEN len END) AS payload_min_{n}, max(CASE WHEN {c} AND v4 THEN len END) AS payload_max_{n},
  sum(CASE WHEN {c} AND tcp THEN win WHEN {c} THEN 0 END) / nullif(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS avg_win_{n}"""
    for c, n in (("o", "orig"), ("NOT o", "resp"))
)
_FLAGS = ", ".join(
    f"sum(CASE WHEN tcp AND (flags & {bit}) <> 0 THEN 1 ELSE 0 END) AS flag_{f}" for f, bit in FLAG_BITS.items()
)
_INTS = ["orig_pkts", "resp_pkts", *[f"flag_{f}" for f in FLAG_BITS]]
_TTLS = [f"{a}_{b}_{s}" for a, b in (("min", "ttl"), ("max", "ttl"), ("payload", "min"), ("payload", "max")) for s in ("orig", "resp")]
ORACLES["assemble_flows_from_packets"] = with_(PACKETS + f""",
gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY uid ORDER BY t) AS gap FROM packets),
f AS (
  SELECT uid, {_SIDES}, {_FLAGS}, coalesce(avg(gap), 0) AS iat_mean, coalesce(max(gap), 0) AS iat_max,
         coalesce(var_pop(gap), 0) / 1e9 AS iat_var, max(t) - min(t) AS duration
  FROM gaps GROUP BY uid)""",
    "SELECT uid, "
    + ", ".join([f"CAST({c} AS BIGINT) AS {c}" for c in _INTS] + [f"coalesce({c}, -1) AS {c}" for c in _TTLS])
    + ", "
    + ", ".join(f"coalesce(round(CAST({c} AS DOUBLE), 4), -1) AS {c}" for c in
                ("avg_win_orig", "avg_win_resp", "iat_mean", "iat_max", "iat_var", "duration"))
    + " FROM f")
_MEANS = [
    "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", *[t for t in _TTLS if "ttl" in t],
    "avg_win_orig", "avg_win_resp", *[t for t in _TTLS if "payload" in t], "retrans_orig", "retrans_resp",
]
ORACLES["connection_flow_records"] = with_(PACKETS + f""",
gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY uid ORDER BY t) AS gap FROM packets),
facts AS (
  SELECT uid, {_SIDES.replace("orig_pkts", "_o").replace("resp_pkts", "_r").replace("avg_win", "_avg_win")}, {_FLAGS},
         avg(gap) AS iat_mean, max(gap) AS iat_max, var_pop(gap) / 1e9 AS iat_var,
         sum(CASE WHEN o AND tcp THEN win ELSE 0 END) AS wo, sum(CASE WHEN NOT o AND tcp THEN win ELSE 0 END) AS wr,
         sum(CASE WHEN o THEN 1 ELSE 0 END) AS no, sum(CASE WHEN o THEN 0 ELSE 1 END) AS nr
  FROM gaps GROUP BY uid),
f AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS uid, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts,
         CAST(o_custkey AS VARCHAR) AS src_ip, CAST(o_orderkey % 60000 AS INTEGER) AS src_port,
         CAST(o_orderkey % 251 AS VARCHAR) AS dst_ip, CAST(o_custkey % 10 + 80 AS INTEGER) AS dst_port,
         CASE o_orderstatus WHEN 'P' THEN 'udp' ELSE 'tcp' END AS proto,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'http,ssl' WHEN '2-HIGH' THEN 'dns' ELSE '-' END AS service,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS duration, floor(o_totalprice) AS orig_bytes,
         o_orderkey % 5000 AS resp_bytes, o_custkey % 4 AS orig_pkts, o_orderkey % 3 AS resp_pkts,
         CASE WHEN no > 0 AND o_custkey % 4 > 0 THEN wo / (o_custkey % 4) END AS avg_win_orig,
         CASE WHEN nr > 0 AND o_orderkey % 3 > 0 THEN wr / (o_orderkey % 3) END AS avg_win_resp,
         CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS retrans_orig,
         CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS retrans_resp,
         facts.* EXCLUDE (uid)
  FROM orders LEFT JOIN facts ON facts.uid = o_orderkey)""",
    "SELECT uid, ts, src_ip, src_port, dst_ip, dst_port, proto, service, 0.0::DOUBLE AS frag_count, "
    + ", ".join(
        [f"coalesce(round(CAST({c} AS DOUBLE), 4), -1) AS {c}" for c in _MEANS]
        + [f"coalesce(round(CAST({c} AS DOUBLE), 4), 0) AS {c}" for c in ("iat_mean", "iat_max", "iat_var", *[f"flag_{f}" for f in FLAG_BITS])]
    )
    + " FROM f")
CAPTURE = """ev AS (
  SELECT epoch_us(CAST(ts AS TIMESTAMP)) AS t, user_id, event_type,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS len FROM events
  WHERE event_type <> 'signup' AND NOT (event_type = 'error' AND event_id % 7 = 0))"""
ORACLES["anchored_windows_capture"] = f"""
WITH RECURSIVE {CAPTURE},
starts(s) AS (
  SELECT min(t) FROM ev
  UNION ALL
  SELECT min(ev.t) FROM starts JOIN ev ON ev.t >= starts.s + 3600000000 HAVING min(ev.t) IS NOT NULL),
spans AS (SELECT s, lead(s) OVER (ORDER BY s) AS nxt FROM starts),
win AS (
  SELECT s + 3600000000 AS ts_us, round(count(*) / 3600.0, 6) AS connections_per_sec,
         round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / 3600.0, 6) AS syn_rate,
         round(avg(len), 6) AS avg_packet_size, count(DISTINCT user_id) AS unique_source_ips
  FROM spans JOIN ev ON ev.t >= s AND ev.t < nxt GROUP BY s),
iv AS (SELECT min(t) AS s, max(t) AS e FROM ev WHERE len > 98 GROUP BY t // 7200000000),
timed AS (
  SELECT win.*, bool_or(s <= ts_us AND ts_us <= e) AS inside, min(CASE WHEN s > ts_us THEN (s - ts_us) / 1e6 END) AS gap
  FROM win LEFT JOIN iv ON true GROUP BY ALL)
SELECT ts_us, connections_per_sec, syn_rate, avg_packet_size, unique_source_ips,
       {HORIZON.format(active="inside", h=10800)} AS label FROM timed"""
ORACLES["anchored_windows_by_source"] = f"""
WITH RECURSIVE {CAPTURE},
starts(u, s) AS (
  SELECT user_id, min(t) FROM ev GROUP BY 1
  UNION ALL
  SELECT u, min(ev.t) FROM starts JOIN ev ON ev.user_id = u AND ev.t >= s + 86400000000 GROUP BY u),
spans AS (SELECT u, s, lead(s) OVER (PARTITION BY u ORDER BY s) AS nxt FROM starts)
SELECT CAST(u AS VARCHAR) AS src_ip, s + 86400000000 AS ts_us, round(count(*) / 86400.0, 6) AS connections_per_sec,
       round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / 86400.0, 6) AS syn_rate, round(avg(len), 6) AS avg_packet_size
FROM spans JOIN ev ON user_id = u AND t >= s AND t < nxt GROUP BY u, s"""
ORACLES["service_sets"] = with_(FLOWS, """
SELECT src_ip, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label <> 'view'), '-') AS services
FROM flows GROUP BY 1""")
ORACLES["tcp_flags_and_history"] = with_(PACKETS, "SELECT src_ip, " + ", ".join(
    f"CAST(sum(CASE WHEN (flags & {bit}) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_{f}" for f, bit in FLAG_BITS.items()
) + """, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS retrans_orig,
  CAST(sum(CASE WHEN o THEN 0 ELSE 1 END) AS BIGINT) AS retrans_resp FROM packets GROUP BY 1""")

# --- scalars, cleaning, filters ----------------------------------------------------

ORACLES["number_coercion"] = with_(FLOWS, """
SELECT src_ip, sum(CASE WHEN label IN ('view', 'click') THEN 0 ELSE k END) AS total,
       round(avg(CASE WHEN label IN ('view', 'click') THEN 0 ELSE k END), 6) AS mean FROM flows GROUP BY 1""")
ORACLES["clean_numeric_values"] = with_(FLOWS, """
SELECT uid, CASE WHEN label IN ('view', 'click', 'signup') THEN 0.0 ELSE round(orig_bytes, 6) END AS v FROM flows""")
ORACLES["time_parsing"] = with_(FLOWS, """
SELECT uid, strftime(CASE WHEN label IN ('view', 'purchase') THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END,
                     '%Y-%m-%d %H:%M:%S') AS parsed,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS epoch FROM flows WHERE label <> 'error'""")
ORACLES["label_map"] = with_(FLOWS, f"""
SELECT uid, CASE WHEN label = 'signup' THEN 0 ELSE {STAGE} END AS stage,
       CASE WHEN upper(label) IN ('VIEW', 'CLICK') THEN 0 ELSE 1 END AS attack FROM flows""")
ORACLES["label_map_table"] = with_(FLOWS, f"""
SELECT src_ip, CASE WHEN label = 'click' THEN 0 ELSE {STAGE} END AS stage, count(*) AS n FROM flows GROUP BY 1, 2""")
ORACLES["flow_feature_derivation"] = """
WITH f AS (
  SELECT l_orderkey, l_linenumber, CAST(l_linenumber - 1 + l_partkey % 3 AS DOUBLE) AS total_packets,
         l_quantity + 10 AS total_bytes, l_discount * 10 AS dur,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS syn_equivalent FROM lineitem)
SELECT l_orderkey, l_linenumber, total_packets, total_bytes,
       round(coalesce(total_bytes / nullif(total_packets, 0), 0), 6) AS avg_packet_size,
       round(total_packets / CASE WHEN dur = 0 THEN 0.0001 ELSE dur END, 6) AS flow_packets_s, syn_equivalent
FROM f"""
ORACLES["conform_features"] = with_(
    FLOWS, "SELECT uid, round(orig_bytes, 6) AS sent, round(k, 6) AS resp_bytes, CAST(0 AS DOUBLE) AS absent FROM flows")
ORACLES["silence_filter"] = with_(FILLED, f"""
SELECT src_ip, {TS}, round(orig_bytes, 6) AS orig_bytes, round(resp_bytes, 6) AS resp_bytes, flow_count, distinct_ports
FROM filled WHERE orig_bytes > 0 OR resp_bytes > 0""")
ORACLES["byte_ratio"] = with_(WIN, f"""
SELECT src_ip, {TS}, round(orig_bytes / (resp_bytes + 1e-9), 6) AS bidirectional_flow_ratio
FROM win WHERE resp_bytes > 0""")

# --- labels ------------------------------------------------------------------------

ORACLES["attack_db"] = with_(FLOWS + "," + TRUTH, "SELECT src_ip, stage FROM db")
ORACLES["entity_label"] = with_(FILLED + "," + TRUTH, """
SELECT f.src_ip, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS ts, coalesce(db.stage, 0) AS stage,
       CAST(CASE WHEN db.stage IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS prob
FROM filled f LEFT JOIN db USING (src_ip)""")
ORACLES["attacker_list_label"] = with_(WIN + """,
listed AS (SELECT src_ip, CAST(src_ip AS BIGINT) AS u FROM win),
named AS (SELECT src_ip, u, u < 40 AND u % 3 = 0 AS hit FROM listed)""", """
SELECT CAST(CASE WHEN hit THEN u % 5 ELSE 0 END AS INTEGER) AS stage,
       CAST(CASE WHEN hit THEN 1 ELSE 0 END AS DOUBLE) AS prob,
       count(*) AS n, count(DISTINCT src_ip) AS sources FROM named GROUP BY 1, 2""")
ORACLES["entity_window_label"] = with_(FILLED + "," + TRUTH + """,
worst AS (SELECT src_ip, date_trunc('hour', ts) AS ts, max(stage) AS stage FROM truth GROUP BY 1, 2)""", """
SELECT f.src_ip, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS ts, coalesce(w.stage, 0) AS stage
FROM filled f LEFT JOIN worst w USING (src_ip, ts)""")
ORACLES["interval_label"] = with_(
    FILLED + "," + attacked_intervals("(f.ts + INTERVAL 1 HOUR)"),
    f"SELECT src_ip, {TS}, {HORIZON.format(active='inside', h=10800)} AS label FROM timed")
ORACLES["interval_label_network"] = with_(FILLED + """,
iv AS (
  SELECT min(ts) AS s, max(ts) AS e FROM flows WHERE orig_bytes > 250
  GROUP BY time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')),
slots AS (SELECT DISTINCT ts FROM filled),
timed AS (
  SELECT slots.ts, bool_or(s <= ts AND ts <= e) AS inside,
         min(CASE WHEN s > ts THEN (epoch_us(s) - epoch_us(ts)) / 1e6 END) AS gap
  FROM slots LEFT JOIN iv ON true GROUP BY 1),
named AS (SELECT ts, """ + HORIZON.format(active="inside", h=10800) + """ AS label FROM timed)""", """
SELECT src_ip, label, count(*) AS n FROM filled JOIN named USING (ts) GROUP BY 1, 2""")
ORACLES["boundary_exclusion"] = with_(FILLED + "," + attacked_intervals("f.ts"), f"""
SELECT src_ip, {TS} FROM timed
WHERE coalesce(inside, false) OR gap IS NULL
   OR NOT (abs(gap - 10800) < 1800 OR abs(gap - 43200) < 1800 OR abs(gap - 108000) < 1800)""")

# --- sequences ---------------------------------------------------------------------

ORACLES["sequences_stride6"] = with_(ACTIVE, """
SELECT src_ip, seq_id, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts,
       strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts, label, CAST(prob AS DOUBLE) AS prob,
       round(x_sum, 4) AS x_sum FROM seqs""")
ORACLES["sequences_sliding"] = with_(FILLED, "," + sliding("filled"))
ORACLES["sequences_sliding_active"] = with_(WIN, "," + sliding("win"))
ORACLES["flatten_sequence"] = with_(ACTIVE + """,
long AS (
  SELECT src_ip, pos // 6 AS seq_id, pos % 6 AS step, unnest([0, 1, 2, 3]) AS f,
         unnest([orig_bytes, resp_bytes, flow_count, distinct_ports]) AS v FROM active)""", """
SELECT src_ip, seq_id, CAST(step * 4 + f AS INTEGER) AS position, round(v, 6) AS v
FROM long SEMI JOIN seqs USING (src_ip, seq_id)""")

# --- scaling -----------------------------------------------------------------------

SCALER = EMB + """,
params AS (
  SELECT i, quantile_cont(v, 0.5) AS center,
         CASE WHEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) = 0 THEN 1
              ELSE quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END AS scale
  FROM emb GROUP BY i)"""
ORACLES["robust_scaler_fit"] = with_(
    SCALER, "SELECT 'f' || i AS feature, round(center, 9) AS center, round(scale, 9) AS scale FROM params")
ORACLES["robust_scaler_apply"] = with_(SCALER, """
SELECT vec_id, CAST(i AS INTEGER) AS position, round((v - center) / scale, 6) AS v FROM emb JOIN params USING (i)""")

# --- sampling ----------------------------------------------------------------------

ORACLES["cap_by_class"] = with_(
    quotas("documents", "doc_id", "lang", "CASE lang WHEN 'en' THEN 150 WHEN 'de' THEN 40 ELSE 100000000 END"),
    "SELECT doc_id, lang, n_chars FROM kept")
ORACLES["sample_by_class"] = f"""
SELECT doc_id, lang FROM documents WHERE lang <> 'en' OR {row_hash("doc_id")} < 214748364"""
ORACLES["balance_active"] = with_(FILLED + "," + TRUTH + """,
lab AS (
  SELECT f.src_ip || '|' || CAST(epoch(f.ts) AS BIGINT) AS id, coalesce(db.stage, 0) AS stage
  FROM filled f LEFT JOIN db USING (src_ip) WHERE f.orig_bytes > 0 OR f.resp_bytes > 0),"""
    + quotas("lab", "id", "stage", "CASE stage WHEN 0 THEN 1500 ELSE 100000000 END"), "SELECT id, stage FROM kept")
ORACLES["balance_sequences"] = with_(ACTIVE + """,
keyed AS (SELECT src_ip || '|' || seq_id AS id, label FROM seqs),"""
    + quotas("keyed", "id", "label", """CASE label WHEN 0 THEN
      greatest((SELECT 2 * count(*) FROM keyed WHERE label <> 0), 50) ELSE 100000000 END"""), "SELECT id, label FROM kept")
ORACLES["balance_risk"] = with_(NET_SRC + "," + lookahead("net", "src_ip") + """,
keyed AS (SELECT src_ip || '|' || CAST(epoch(ts) AS BIGINT) AS id, label FROM risk),
target AS (SELECT greatest(count(*) FILTER (label = 'ELEVATED'), count(*) FILTER (label = 'NEAR-TERM')) AS n FROM keyed),"""
    + quotas("keyed", "id", "label", """CASE WHEN label IN ('NORMAL', 'IMMINENT') AND (SELECT n FROM target) > 0
      THEN (SELECT n FROM target) ELSE 100000000 END"""), "SELECT id, label FROM kept")
ORACLES["hash_split"] = f"""
SELECT doc_id, CASE WHEN {row_hash("doc_id")} < 3435973836 THEN 'train' ELSE 'test' END AS part FROM documents"""
ORACLES["stratified_split"] = with_(f"""
r AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {row_hash("doc_id")}, doc_id) AS rn,
         count(*) OVER (PARTITION BY lang) AS n FROM documents),
q AS (SELECT *, CAST(round(n * 0.2) AS BIGINT) AS t FROM r)""", """
SELECT doc_id, lang, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + CAST(round((n - t) * 0.1) AS BIGINT) THEN 'validation'
  ELSE 'train' END AS part FROM q""")
ORACLES["chronological_split"] = """
WITH cut AS (SELECT quantile_cont(CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE), 0.8) AS c FROM events)
SELECT event_id AS uid, CASE WHEN CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) < c THEN 'train' ELSE 'test' END AS part
FROM events, cut"""
ORACLES["shuffled_order"] = f"""
SELECT doc_id, CAST({row_hash("doc_id")} AS BIGINT) AS h,
       row_number() OVER (ORDER BY {row_hash("doc_id")}, doc_id) AS rank FROM documents"""
ORACLES["fuse_datasets"] = with_(NET_ALL + "," + lookahead("net", None) + "," + daily("0.1") + ","
    + lookahead("daily", "l_returnflag", 259_200).replace("ahead AS", "ahead2 AS").replace("FROM ahead)", "FROM ahead2)")
    .replace("risk AS", "risk2 AS") + """,
fused AS (
  SELECT 'a' AS dataset, label, connections_per_sec AS c FROM risk
  UNION ALL SELECT 'b', label, connections_per_sec FROM risk2)""", """
SELECT dataset, label, CASE label WHEN 'NORMAL' THEN 0 WHEN 'ELEVATED' THEN 1 WHEN 'NEAR-TERM' THEN 2 ELSE 3 END AS y,
       count(*) AS n, round(sum(c), 6) AS rate FROM fused GROUP BY 1, 2, 3""")

# --- metrics -----------------------------------------------------------------------

ORACLES["class_distribution"] = with_(FLOWS + """,
c AS (
  SELECT class, count(uid) AS n
  FROM (VALUES ('view'), ('click'), ('signup'), ('purchase'), ('error'), ('scan')) v(class)
  LEFT JOIN flows ON label = class GROUP BY 1)""",
    "SELECT class, n, round(100.0 * n / sum(n) OVER (), 9) AS pct FROM c")
ORACLES["class_weights"] = """
WITH c AS (
  SELECT CAST(r.i AS INTEGER) AS class, count(vec_id) AS n FROM range(12) r(i) LEFT JOIN embeddings ON label = r.i GROUP BY 1),
t AS (SELECT sum(n) AS total, count(*) FILTER (n > 0) AS k FROM c)
SELECT class, n, round(CASE WHEN n = 0 THEN 1.0 ELSE total / (k * n) END, 9) AS weight FROM c, t"""
ORACLES["active_sources"] = with_(FLOWS, """
SELECT count(DISTINCT src_ip) AS sources, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM flows""")
ORACLES["confusion_matrix"] = "SELECT quality AS label, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2"
ORACLES["classification_report"] = with_(report(PAIRS), """
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report""")
ORACLES["report_summary"] = with_(report(PAIRS), """
SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS macro_precision,
       round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
       round(sum(precision * support) / sum(support), 9) AS weighted_precision,
       round(sum(recall * support) / sum(support), 9) AS weighted_recall,
       round(sum(f1 * support) / sum(support), 9) AS weighted_f1, CAST(sum(support) AS BIGINT) AS rows FROM report""")
ORACLES["macro_fpr"] = with_(report(QUALITY), """
SELECT round(avg((predicted - tp) / ((SELECT count(*) FROM labels) - support)), 9) AS macro_fpr FROM report""")
ORACLES["ovr_roc_auc"] = with_(CURVES, "SELECT class, positives, round(roc_auc, 9) AS roc_auc FROM curves")
ORACLES["average_precision"] = with_(
    CURVES, "SELECT class, round(average_precision, 9) AS average_precision FROM curves")
ORACLES["weighted_ovr_scores"] = with_(CURVES, """
SELECT round(sum(roc_auc * positives) / sum(positives), 9) AS roc_auc,
       round(sum(average_precision * positives) / sum(positives), 9) AS average_precision FROM curves""")
ORACLES["log_loss"] = with_(softmax(10), "SELECT round(avg(-ln(p)), 9) AS loss FROM probs WHERE i = label")
ORACLES["focal_loss"] = with_(
    softmax(10), "SELECT vec_id, round(pow(1 - p, 2) * -ln(p), 9) AS loss FROM probs WHERE i = label")
ORACLES["binary_log_loss"] = with_(FLOWS + """,
b AS (SELECT CASE WHEN label = 'error' THEN 1 ELSE 0 END AS y,
             greatest(least(orig_bytes / (orig_bytes + 50), 1 - 1e-15), 1e-15) AS p FROM flows)""",
    "SELECT round(sum(-(y * ln(p) + (1 - y) * ln(1 - p))), 4) AS loss FROM b")
ORACLES["best_model"] = with_(FLOWS + """,
s AS (SELECT CAST(hour(ts) AS VARCHAR) AS model, round(avg(CASE WHEN label = 'error' THEN 1 ELSE 0 END), 9) AS macro_f1
      FROM flows GROUP BY 1)""",
    "SELECT min(model) AS model, max(macro_f1) AS macro_f1 FROM s WHERE macro_f1 = (SELECT max(macro_f1) FROM s)")

# --- scores, alerts, views ---------------------------------------------------------

ORACLES["softmax_argmax"] = with_(softmax(10), """
SELECT vec_id, CAST(arg_max(i, p) AS INTEGER) AS pred, round(max(p), 9) AS confidence FROM probs GROUP BY 1""")
ORACLES["next_stage"] = with_(PRED, f"""
SELECT src_ip, {TS}, stage, {NEXT} AS next_stage, {STAGE_NAME.format(s="(" + NEXT + ")")} AS next_name FROM pred""")
ORACLES["status_band"] = with_(PRED, f"SELECT src_ip, {TS}, {STATUS} AS status FROM pred")
ORACLES["stage_alerts"] = with_(ALERTS, f"SELECT src_ip, {TS}, stage, severity FROM alerts")
ORACLES["newest_alerts"] = with_(ALERTS + """,
top AS (SELECT * FROM alerts ORDER BY ts DESC, src_ip LIMIT 3)""", f"SELECT src_ip, {TS}, stage, severity FROM top")
ORACLES["latest_telemetry"] = with_(PRED + """,
top AS (SELECT * FROM pred ORDER BY ts DESC, src_ip LIMIT 100)""", f"""
SELECT src_ip, {TS}, {STAGE_NAME.format(s="stage")} AS stage_name, round(threat_prob, 6) AS threat_prob,
       round(flow_count / 3600.0, 6) AS connections_per_sec, round(distinct_ports / 3600.0, 6) AS syn_rate FROM top""")
ORACLES["first_rows"] = with_(FLOWS + """,
top AS (SELECT * FROM flows ORDER BY src_ip, ts, uid LIMIT 1000)""", f"SELECT src_ip, uid, {TS} FROM top")
ORACLES["sequence_timeline"] = with_(PRED, f"""
SELECT src_ip, row_number() OVER (PARTITION BY src_ip ORDER BY ts) - 1 AS "window",
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, round(threat_prob, 6) AS threat_prob,
       {STAGE_NAME.format(s="stage")} AS stage_name, round(confidence, 6) AS confidence FROM pred""")
ORACLES["prediction_history"] = with_(PRED + """,
h AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC) AS rank FROM pred)""", f"""
SELECT src_ip, {TS}, CAST(rank AS INTEGER) AS rank, stage, round(threat_prob, 6) AS threat_prob FROM h WHERE rank <= 5""")
ORACLES["current_status"] = with_(PRED + """,
h AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC) AS rank FROM pred)""", f"""
SELECT src_ip, {TS}, {STAGE_NAME.format(s="stage")} AS stage_name, {NEXT} AS next_stage, {STATUS} AS status
FROM h WHERE rank = 1""")
ORACLES["criticality_score"] = with_(PRED, """
SELECT p.src_ip, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts,
       round(least(1.0, p.threat_prob / 100 * coalesce(1 + c.c_acctbal / 10000, 1)), 11) AS risk_score
FROM pred p LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = p.src_ip""")
SHARES = EMB + """,
shares AS (SELECT vec_id, i, abs(v) / sum(abs(v)) OVER (PARTITION BY vec_id) * 100 AS share FROM emb)"""
ORACLES["top_k_features"] = with_(SHARES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, i) - 1 AS rank FROM shares)""", """
SELECT vec_id, CAST(rank AS INTEGER) AS rank, 'f' || i AS feature, round(share, 6) AS share FROM r WHERE rank < 8""")
ORACLES["percent_weights"] = with_(EMB, """
SELECT vec_id, CAST(i AS INTEGER) AS position,
       round(CASE WHEN label = 0 THEN 100.0 / 64 ELSE abs(v) / sum(abs(v)) OVER (PARTITION BY vec_id) * 100 END, 6) AS share
FROM emb""")
ORACLES["ovr_vote"] = with_(softmax(10) + """,
v AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS place FROM probs)""", """
SELECT vec_id, CASE WHEN p * 3 < 0.5 THEN 'NORMAL' ELSE 'c' || i END AS pred FROM v WHERE place = 1""")
ORACLES["prediction_json"] = with_(softmax(4) + """,
v AS (
  SELECT vec_id, arg_max(i, p) AS top, max(p) AS best, max(CASE WHEN i = 0 THEN p END) AS a,
         max(CASE WHEN i = 1 THEN p END) AS b, max(CASE WHEN i = 2 THEN p END) AS c, max(CASE WHEN i = 3 THEN p END) AS d
  FROM probs GROUP BY 1)""", """
SELECT vec_id, printf('{"prediction":"%s","confidence":"%.2f%%","full_distribution":{"NORMAL":"%.2f%%","ELEVATED":"%.2f%%","NEAR-TERM":"%.2f%%","IMMINENT":"%.2f%%"}}',
  ['NORMAL', 'ELEVATED', 'NEAR-TERM', 'IMMINENT'][top + 1], best * 100, a * 100, b * 100, c * 100, d * 100) AS record FROM v""")
ORACLES["linear_explain"] = with_(EMB + """,
m AS (SELECT i, avg(v) AS mean, avg(CASE WHEN label = 1 THEN v END) AS one FROM emb GROUP BY i)""", """
SELECT vec_id, CAST(i AS INTEGER) AS position, round((one - mean) * (v - mean), 9) AS contribution FROM emb JOIN m USING (i)""")
ORACLES["knn_vote"] = with_(f"""
s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, {row_hash("vec_id")} < 3435973836 AS train FROM embeddings),
d AS (SELECT q.vec_id, r.label, r.vec_id AS other, list_distance(q.x, r.x) AS dist
      FROM s q JOIN s r ON r.train AND NOT q.train),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS rn FROM d),
votes AS (SELECT vec_id, label, count(*) AS n, min(dist) AS nearest FROM k WHERE rn <= 5 GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS pick,
                min(nearest) OVER (PARTITION BY vec_id) AS near FROM votes)""", """
SELECT vec_id, CAST(label AS BIGINT) AS pred, round(near, 6) AS nearest FROM best WHERE pick = 1""")

# Properties that hold for every row, whatever the trees.
ORACLES["tree_explain"] = "SELECT vec_id, true AS adds_up, 8 AS n_top FROM embeddings"
ORACLES["ensemble_saved"] = "SELECT vec_id, true AS same FROM embeddings"

# --- streams -----------------------------------------------------------------------

# A closing row ends each stream, so all windows come out.
CLOSED = WIN + """,
closed AS (SELECT * FROM win)"""
ORACLES["stream_windows"] = with_(CLOSED, f"""
SELECT src_ip, {TS}, round(orig_bytes, 6) AS orig_bytes, round(resp_bytes, 6) AS resp_bytes,
       flow_count, distinct_ports FROM closed""")
ORACLES["stream_windows_with_late"] = ORACLES["stream_windows"]
ORACLES["stream_sliding_sequences"] = with_(CLOSED + """,
spine AS (
  SELECT src_ip, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM closed GROUP BY src_ip),
filled AS (
  SELECT s.src_ip, s.ts, coalesce(w.orig_bytes, 0) AS orig_bytes, coalesce(w.resp_bytes, 0) AS resp_bytes,
         coalesce(w.flow_count, 0) AS flow_count, coalesce(w.distinct_ports, 0) AS distinct_ports
  FROM spine s LEFT JOIN closed w USING (src_ip, ts))""", "," + sliding("filled"))
ORACLES["stream_stage_alerts"] = with_(CLOSED + ",\n" + ALERTS[len(WIN) + 1:].replace("FROM win)", "FROM closed)"),
    f"SELECT src_ip, {TS}, stage, severity FROM alerts")


# --- sources and sinks: what was written is what is read ----------------------------

ORACLES["flow_log_source"] = with_(FLOWS, f"""
SELECT CAST(uid AS VARCHAR) AS uid, src_ip, {TS}, round(coalesce(orig_bytes, 0), 6) AS orig_bytes,
       round(coalesce(k, 0), 6) AS resp_bytes, label AS service FROM flows""")
ORACLES["labelled_flow_source"] = with_(FLOWS, f"""
SELECT src_ip, {TS}, CASE WHEN label = 'error' THEN 'DDoS' ELSE 'BENIGN' END AS label,
       CASE WHEN label = 'error' THEN 4 ELSE 0 END AS stage FROM flows""")
for _name, _same in {
    "window_table_sink": "win_features_dense_only",
    "window_csv_source": "win_features_dense_only",
    "sequence_table": "sequences_stride6",
    "scaler_saved": "robust_scaler_fit",
    "report_saved": "class_distribution",
}.items():
    ORACLES[_name] = ORACLES[_same]
