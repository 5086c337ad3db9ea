import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.functions import scalar as S
from tideglass.functions import scores as P
from tideglass.operators import forecast as C

SCHEMA = "src_ip string, ts timestamp, threat_prob double, stage int"


def loop(rows, threshold=75):
    """(time, stage, severity) of one source, row by row."""
    out, last = [], None
    for _, ts, prob, stage in rows:
        if prob > threshold and stage != last:
            out.append((ts, stage, "critical" if prob > 90 else "warning"))
            last = stage
    return out


def test_alert_case(spark, at):
    case = [(80, 1), (95, 1), (40, 2), (95, 1), (91, 2), (75, 3), (76, 3)]
    rows = [("a", at(10 * i), float(p), s) for i, (p, s) in enumerate(case)]
    got = C.stage_alerts(spark.createDataFrame(rows, SCHEMA)).orderBy("ts").collect()
    assert [(r.stage, r.severity) for r in got] == [(1, "warning"), (2, "critical"), (3, "warning")]


@pytest.mark.parametrize("bucket", [50, 86_400])
def test_alerts_equal_the_loop(spark, at, bucket):
    rng = np.random.default_rng(bucket)
    rows = [
        (k, at(10 * i), float(rng.choice([10, 76, 91])), int(rng.integers(0, 3)))
        for k, n in {"hot": 500, "b": 30, "c": 1}.items()
        for i in range(n)
    ]
    got = C.stage_alerts(spark.createDataFrame(rows, SCHEMA).repartition(5), bucket_seconds=bucket).collect()
    for k in ("hot", "b", "c"):
        ours = sorted((r.ts, r.stage, r.severity) for r in got if r.src_ip == k)
        assert ours == loop([r for r in rows if r[0] == k])


def test_views(spark, at):
    rows = [(k, at(i), float(i), i % 5, f"s{i % 5}", float(70 + i)) for k in "ab" for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA + ", stage_name string, confidence double")
    assert C.newest(df, 3, tie=("src_ip",)).count() == 3
    assert C.history(df, 4).groupBy("src_ip").count().filter("count = 4").count() == 2
    now = {r.src_ip: r for r in C.current_status(df).collect()}
    assert (now["a"].stage, now["a"].status, now["a"].ts) == (4, "CRITICAL", at(24))
    line = C.timeline(df.filter("src_ip = 'a'")).orderBy("window").collect()
    assert [r.window for r in line] == list(range(25)) and line[0].time == "2018-02-14 09:00:00"
    windows = df.select("src_ip", "ts", F.lit(20).alias("flow_count"), F.lit(5).alias("flag_syn"))
    latest = C.telemetry(df, windows, 10, n=7).collect()
    assert len(latest) == 7 and {(r.connections_per_sec, r.syn_rate) for r in latest} == {(2.0, 0.5)}
    assert [r.stage for r in C.first_rows(df, 3, "src_ip", "ts").collect()] == [0, 1, 2]


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 1000.0, 1000.0],)], "l array<double>")
    row = df.select(P.softmax("l").alias("p"), P.argmax("l").alias("i")).first()
    assert row.p == [0.0, 0.5, 0.5] and row.i == 1
    w = spark.createDataFrame([([0.0, 0.0],), ([-3.0, 1.0],)], "w array<double>")
    assert [r[0] for r in w.select(P.percent_weights("w")).collect()] == [[50.0, 50.0], [75.0, 25.0]]
    s = spark.createDataFrame([(50.0, 1), (50.1, 1), (99.0, 4)], "p double, s int")
    assert [r[0] for r in s.select(P.next_stage("p", "s")).collect()] == [1, 2, 4]
    b = spark.createDataFrame([(74.9, 1), (99.0, 0), (75.0, 1), (90.0, 1)], "c double, s int")
    assert [r[0] for r in b.select(P.status_band("c", "s")).collect()] == ["MONITORING", "MONITORING", "ELEVATED", "CRITICAL"]
    v = spark.createDataFrame([(0.4, 0.49, 0.1), (0.6, 0.6, 0.2), (0.1, 0.5, 0.9)], "a double, b double, c double")
    votes = [r[0] for r in v.select(P.ovr_vote(["a", "b", "c"], ["E", "N", "I"])).collect()]
    assert votes == ["NORMAL", "E", "I"]


def test_prediction_record(spark):
    df = spark.createDataFrame([(1, [0.125, 0.75, 0.1, 0.025])], "w int, p array<double>")
    text = df.select(P.prediction_json("p", ["NORMAL", "ELEVATED", "NEAR-TERM", "IMMINENT"], window_id=F.col("w"))).first()[0]
    assert json.loads(text) == {
        "window_id": 1, "prediction": "ELEVATED", "confidence": "75.00%",
        "full_distribution": {"NORMAL": "12.50%", "ELEVATED": "75.00%", "NEAR-TERM": "10.00%", "IMMINENT": "2.50%"},
    }


def test_explanation(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],)], "x array<double>")
    row = C.explain(df, "x", [1.0, -5.0, 0.5], [1.0, 0.0, 2.0], ["p", "q", "r"], 2).first()
    assert row.contributions == [2.0, -5.0, 0.0]
    assert [(t.feature, round(t.share, 6)) for t in row.top] == [("q", round(500 / 7, 6)), ("p", round(200 / 7, 6))]


def test_criticality(spark):
    df = spark.createDataFrame([("a", 0.6), ("b", 0.6)], "src_ip string, prob double")
    assets = spark.createDataFrame([("a", 2.0)], "src_ip string, weight double")
    got = {r.src_ip: r.risk_score for r in C.criticality_score(df, assets).collect()}
    assert got == {"a": 1.0, "b": 0.6}


def test_interpret(spark):
    df = spark.createDataFrame([([0.0, 0.0, 9.0, 0.0, 0.0], 0.8)], "logits array<double>, prob double")
    row = C.interpret(df).first()
    assert (row.stage, row.stage_name, row.next_stage, row.status, row.threat_prob) == (2, "Initial Access", 3, "CRITICAL", 80.0)


def test_cleaning(spark):
    rows = [("-",), ("x",), (None,), ("3.5",), ("nan",), ("inf",)]
    df = spark.createDataFrame(rows, "v string")
    got = [r[0] for r in df.select(S.number("v")).collect()]
    assert got == [0, 0, 0, 3.5, 0, float("inf")]
    assert [r[0] for r in df.select(S.finite(S.number("v"))).collect()][-1] == 0
    assert S.to_number(df, ["v", "absent"]).schema["v"].dataType.simpleString() == "double"
    times = ["05/07/2017 9:05", " 5/7/2017 09:05:59", "2017-07-05 09:05:00", "5/7/2017 1:05 PM", "bad", "32/1/2017 1:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string")
    got = [str(r[0]) for r in df.select(S.parse_ts_dayfirst("t")).collect()]
    assert got == ["2017-07-05 09:05:00", "2017-07-05 09:05:59", "2017-07-05 09:05:00", "2017-07-05 13:05:00", "None", "None"]


def test_flags_and_text(spark):
    df = spark.createDataFrame([(0x12, "ShADtT", "con", "BENIGN", "\ta b \n"), (None, None, None, None, None)],
                               "f int, h string, s string, l string, t string")
    rows = df.select(
        S.tcp_flag("f", "syn"), S.tcp_flag("f", "fin"), S.retransmitted("h", "t"), S.syn_state("s"),
        S.attack_flag("l"), S.strip("t"),
    ).collect()
    assert tuple(rows[0]) == (True, False, 1, 1, 0, "a b") and tuple(rows[1]) == (False, False, 0, 0, 1, None)
    none = spark.createDataFrame([(None,)], "s string").agg(S.service_list("s")).first()[0]
    assert none == "-"


def test_derived_flow_features(spark):
    df = spark.createDataFrame([("0", "0", "5", "5", "0", "int"), ("2", "2", "100", "0", "2", "FIN")],
                               "Spkts string, Dpkts string, sbytes string, dbytes string, dur string, state string")
    a, b = S.derive_flow_features(df).collect()
    assert (a.avg_packet_size, a.flow_packets_s, a.syn_equivalent) == (0.0, 0.0, 1)
    assert (b.avg_packet_size, b.flow_packets_s, b.syn_equivalent) == (25.0, 2.0, 0)


def test_conform(spark):
    df = spark.createDataFrame([("k", 1, 2)], "`id` string, A int, Junk int")
    out = S.conform(S.drop_columns(df, ["junk"]), ["b", "c"], ["id"], {"A": "b"})
    assert out.columns == ["id", "b", "c"] and tuple(out.first()) == ("k", 1.0, 0.0)
