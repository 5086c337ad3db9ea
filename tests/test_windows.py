import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.operators.labels import lookahead_label
from tideglass.operators.windows import (
    change_features,
    net_window_features,
    risk_features,
    traffic_mix,
    trend_features,
    window_features,
)

SCHEMA = "src_ip string, ts timestamp, uid string, dst_port int, orig_bytes string, resp_bytes string"


def random_flows(spark, n=600, span=40_000, seed=1):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame(
        {
            # one source holds about half of all rows
            "src_ip": rng.choice(["a", "a", "a", "b", "c", "d"], n),
            "ts": start + pd.to_timedelta(np.sort(rng.uniform(0, span, n)).round(3), unit="s"),
            "uid": [str(i) for i in range(n)],
            "dst_port": rng.integers(1, 5, n),
            "orig_bytes": rng.integers(0, 100, n).astype(str),
            "resp_bytes": rng.choice(["-", "3", "x", "7.5"], n),
        }
    )
    return pdf, spark.createDataFrame(pdf, SCHEMA)


def test_hand_case(spark, at):
    rows = [("a", at(3), "1", 80, "1", "-"), ("a", at(39), "2", 80, "3", "1"), (None, at(5), "3", 1, "9", "9")]
    out = window_features(spark.createDataFrame(rows, SCHEMA)).orderBy("ts").collect()
    assert [(r.ts, r.orig_bytes, r.flow_count) for r in out] == [
        (at(0), 1.0, 1), (at(10), 0.0, 0), (at(20), 0.0, 0), (at(30), 3.0, 1)
    ]
    assert out[0].resp_bytes == 0.0 and out[0].bidirectional_flow_ratio == pytest.approx(1e9)
    assert out[1].bidirectional_flow_ratio == 0.0


@pytest.mark.parametrize("bucket", [60, 3_600, 86_400])
def test_same_as_resample(spark, bucket):
    pdf, flows = random_flows(spark)
    ours = window_features(flows, width=10, bucket_seconds=bucket).toPandas()
    ours = ours.sort_values(["src_ip", "ts"]).reset_index(drop=True)
    for c in ("orig_bytes", "resp_bytes"):
        pdf[c] = pd.to_numeric(pdf[c].replace("-", np.nan), errors="coerce").fillna(0)
    want = (
        pdf.groupby("src_ip")
        .resample("10s", on="ts")
        .agg({"orig_bytes": "mean", "resp_bytes": "mean", "uid": "count", "dst_port": "nunique"})
        .fillna(0)
        .reset_index()
    )
    assert len(ours) == len(want)
    assert (ours["ts"].to_numpy() == want["ts"].to_numpy()).all()
    for a, b in (("orig_bytes", "orig_bytes"), ("resp_bytes", "resp_bytes"), ("flow_count", "uid"),
                 ("unique_dest_ports_scan_signature", "dst_port")):
        np.testing.assert_allclose(ours[a].to_numpy(float), want[b].to_numpy(float), rtol=1e-12)


def test_without_key_and_without_gaps(spark):
    pdf, flows = random_flows(spark)
    whole = window_features(flows, key=None, width=60, bucket_seconds=600)
    seconds = (pdf.ts.max().floor("60s") - pdf.ts.min().floor("60s")).total_seconds()
    assert whole.count() == seconds / 60 + 1
    assert whole.agg(F.sum("flow_count")).first()[0] == len(pdf)
    short = window_features(flows, width=10, gap_fill=False)
    full = window_features(flows, width=10)
    assert short.exceptAll(full).count() == 0
    assert full.filter("flow_count > 0").exceptAll(short).count() == 0


def test_width_must_divide_a_day(spark):
    _, flows = random_flows(spark, 10)
    with pytest.raises(ValueError):
        window_features(flows, width=7)


@pytest.mark.parametrize("step", [10, None])
def test_trends_equal_pandas(spark, step):
    _, flows = random_flows(spark, 300, 200_000)
    rows = window_features(flows, width=10)
    if step is None:
        rows = rows.filter("flow_count > 0")
    out = trend_features(
        rows, "src_ip", diffs={"d": "orig_bytes"}, averages={"m": "orig_bytes"}, step=step, bucket_seconds=3_600
    ).toPandas().sort_values(["src_ip", "ts"])
    by = out.groupby("src_ip")["orig_bytes"]
    np.testing.assert_allclose(out["d"], by.diff().fillna(0), atol=1e-9)
    np.testing.assert_allclose(
        out["m"], by.rolling(6, min_periods=1).mean().reset_index(level=0, drop=True), atol=1e-9
    )


def test_change_features(spark):
    _, flows = random_flows(spark, 200, 100_000)
    out = change_features(
        window_features(flows, width=10).filter("flow_count > 0"), "src_ip",
        changes=["orig_bytes"], rolling=["orig_bytes"], slopes=["orig_bytes"], bucket_seconds=600,
    ).toPandas().sort_values(["src_ip", "ts"])
    for _, g in out.groupby("src_ip"):
        v = g["orig_bytes"].to_numpy()
        for i in range(len(v)):
            part = v[max(0, i - 4) : i + 1]
            assert g["orig_bytes_roll_mean"].iloc[i] == pytest.approx(part.mean(), abs=1e-9)
            if len(part) > 1:
                assert g["orig_bytes_slope"].iloc[i] == pytest.approx(
                    np.polyfit(np.arange(len(part)), part, 1)[0], abs=1e-7
                )
                assert g["orig_bytes_roll_std"].iloc[i] == pytest.approx(part.std(ddof=1), abs=1e-7)


def test_net_windows(spark, at):
    rows = [("f", at(0), "BENIGN", 1, 10.0), ("f", at(1), None, 0, 20.0), ("f", at(25), "DDoS", 1, 5.0)]
    flows = spark.createDataFrame(rows, "file string, ts timestamp, label string, syn int, size double")
    out = net_window_features(
        flows, "file", "ts", 10, counted="label", syn="syn", size="size", duration="size", fwd="syn", bwd="syn",
        rate="size", attack=F.when(F.col("label") == "BENIGN", 0).otherwise(1),
    ).orderBy("ts").collect()
    assert [r.connections_per_sec for r in out] == [0.1, 0.0, 0.1]
    assert [r.attack_active for r in out] == [1, 0, 1]
    assert [r.avg_packet_size for r in out] == [15.0, 0.0, 5.0]


def test_traffic_mix(spark, at):
    rows = [("a", at(0), "tcp", "REJ", 10, 5, 80), ("a", at(1), "udp", "OK", 10, 5, 81)]
    flows = spark.createDataFrame(rows, "src_ip string, ts timestamp, proto string, state string, i int, o int, port int")
    row = traffic_mix(flows, "src_ip", "ts", 10, F.col("state") == "REJ", F.col("proto") == "tcp",
                      F.col("proto") == "udp", "i", "o", "port").first()
    assert (row.failed_pct, row.tcp_udp_ratio, row.in_out_ratio, row.distinct_ports) == (50.0, 1.0, 2.0, 2)


@pytest.mark.parametrize("chunk", [31, 64, 4_096])
def test_risk_features_equal_the_two_steps(spark, chunk):
    _, flows = random_flows(spark, 250, 30_000, 7)
    windows = net_window_features(
        flows, "src_ip", "ts", 10, counted="uid", syn="dst_port", size="dst_port", duration="dst_port",
        fwd="dst_port", bwd="dst_port", rate="dst_port", attack=(F.col("uid").cast("int") % 17 == 0).cast("int"),
    ).cache()
    want = lookahead_label(trend_features(windows, "src_ip", step=10), "src_ip", bucket_seconds=500)
    got = risk_features(windows, "src_ip", 10, chunk=chunk)
    assert got.columns == want.columns
    assert got.count() == windows.count()
    a = {(r.src_ip, r.ts): r for r in want.collect()}
    for r in got.collect():
        w = a[(r.src_ip, r.ts)]
        assert r.label == w.label and r.syn_rate_diff == pytest.approx(w.syn_rate_diff)
        assert r.packet_size_1m_avg == pytest.approx(w.packet_size_1m_avg)


def test_risk_features_in_a_given_number_of_tasks(spark, at):
    rows = [(str(i % 3), at(10 * (i // 3)), float(i % 7), float(i % 5), float(i % 4), int(i % 40 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, connections_per_sec double, syn_rate double, avg_packet_size double, attack_active int")
    plain, dealt = risk_features(df, "k", 10), risk_features(df, "k", 10, partitions=29)
    assert dealt.rdd.getNumPartitions() == 29
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
