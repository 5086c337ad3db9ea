from datetime import datetime, timedelta

import numpy as np
import pytest

from tideglass.dimensions import (
    ATTACKER_STAGES_2018,
    RISK_HORIZONS,
    flow_label_stages,
    intervals,
)
from tideglass.operators import labels
from tideglass.operators.timeline import event_horizon

DAY = datetime(2017, 7, 5)
ATTACKS = [
    (datetime(2017, 7, 5, 11, 10, 0), datetime(2017, 7, 5, 11, 19, 0)),
    (datetime(2017, 7, 5, 2, 24, 0), datetime(2017, 7, 5, 10, 11, 0)),
]


def test_interval_limits(spark):
    cases = {
        "11:09:45": "IMMINENT", "11:08:30": "NEAR-TERM", "11:06:00": "ELEVATED", "11:00:00": "NORMAL",
        "11:09:30": "IMMINENT", "11:08:00": "NEAR-TERM", "11:05:00": "ELEVATED", "11:04:59": "NORMAL",
        "11:10:00": "IMMINENT", "11:19:00": "IMMINENT", "11:19:01": "NORMAL", "05:00:00": "IMMINENT",
        "02:23:30": "IMMINENT", "02:19:00": "ELEVATED", "02:18:59": "NORMAL",
    }
    rows = [(datetime.strptime(f"2017-07-05 {t}", "%Y-%m-%d %H:%M:%S"), want) for t, want in cases.items()]
    df = spark.createDataFrame(rows, "ts timestamp, want string")
    for bucket in (600, 3_600, 86_400):
        out = labels.label_by_intervals(df, intervals(spark, ATTACKS), bucket_seconds=bucket)
        assert [r for r in out.collect() if r.label != r.want] == []
        assert out.count() == len(rows)


@pytest.mark.parametrize("bucket", [7, 60, 400, 1_000, 86_400])
def test_event_horizon_brute_force(spark, bucket):
    rng = np.random.default_rng(bucket)
    rows = [(str(rng.integers(3)), DAY + timedelta(seconds=int(s))) for s in rng.integers(0, 5_000, 300)]
    spans = [
        (str(rng.integers(3)), DAY + timedelta(seconds=int(s)), DAY + timedelta(seconds=int(s + w)))
        for s, w in zip(rng.integers(0, 6_000, 25), rng.choice([0, 5, 900, 2_000], 25))
    ]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "i int, k string, ts timestamp")
    ev = spark.createDataFrame(spans, "k string, start timestamp, end timestamp")
    got = {r.i: (r._inside, r._gap) for r in event_horizon(df, ev, "k", "ts", 300, bucket).collect()}
    for i, (k, t) in enumerate(rows):
        inside = any(s <= t <= e for q, s, e in spans if q == k)
        gaps = [(s - t).total_seconds() for q, s, _ in spans if q == k and s > t]
        gap = min(gaps) if gaps and min(gaps) <= 300 else None
        assert got[i] == (inside, gap), (k, t)


def test_event_of_years_is_one_row(spark, at):
    """A long event is carried from bucket to bucket, not copied into each."""
    ev = spark.createDataFrame([(None, at(0), at(315_360_000)), ("a", at(50), at(40))], "k string, start timestamp, end timestamp")
    rows = [(k, at(s)) for k in (None, "a") for s in (-10, 0, 5, 200_000_000, 315_360_000, 315_360_001)]
    df = spark.createDataFrame([*rows, ("a", None)], "k string, ts timestamp")
    out = event_horizon(df, ev, "k", "ts", 60, 10)
    got = {(r.k, r.ts): (r._inside, r._gap) for r in out.collect()}
    assert got[None, at(-10)] == (False, 10.0) and [got[None, at(s)][0] for s in (0, 5, 200_000_000, 315_360_000, 315_360_001)] == [True] * 4 + [False]
    assert {v for (k, _), v in got.items() if k == "a"} == {(False, None)} and len(got) == 13
    assert "sequence" not in out._jdf.queryExecution().toString().lower()


def test_lookahead_is_strictly_later(spark, at):
    active = {100: 1, 110: 0, 300: 1}
    rows = [("f", at(s), active.get(s, 0)) for s in range(0, 700, 10)]
    df = spark.createDataFrame(rows, "file string, ts timestamp, attack_active int")
    got = {int((r.ts - at(0)).total_seconds()): r.label for r in labels.lookahead_label(df, "file").collect()}
    assert got[100] == got[300] == "IMMINENT" and got[70] == "IMMINENT" and got[60] == "NEAR-TERM"
    assert got[110] == "ELEVATED" and got[180] == "NEAR-TERM" and got[270] == "IMMINENT"
    assert got[310] == "NORMAL" and len(got) == len(rows)


def test_attack_database_and_join(spark, at):
    truth = spark.createDataFrame(
        [("1.1.1.1 ", 2), ("1.1.1.1", 4), ("2.2.2.2", 0), (None, 3)], "src_ip string, stage int"
    )
    db = labels.attack_database(truth)
    assert [tuple(r) for r in db.collect()] == [("1.1.1.1", 4)]
    windows = spark.createDataFrame([(" 1.1.1.1", at(i)) for i in range(40)] + [("3.3.3.3", at(0))], "src_ip string, ts timestamp")
    out = labels.label_by_entity(windows, db)
    assert out.filter("stage = 4 and prob = 1.0").count() == 40
    assert out.filter("stage = 0 and prob = 0.0").count() == 1
    assert set(out.columns) == {"src_ip", "ts", "stage", "prob"}


def test_attacker_list(spark):
    df = spark.createDataFrame([("18.219.9.1",), (" 172.31.69.28",), ("9.9.9.9",)], "src_ip string")
    got = sorted((r.src_ip.strip(), r.stage, r.prob) for r in labels.label_by_attackers(df, ATTACKER_STAGES_2018).collect())
    assert got == [("172.31.69.28", 3, 1.0), ("18.219.9.1", 4, 1.0), ("9.9.9.9", 0, 0.0)]


def test_label_dictionary(spark):
    rows = [" DDoS ", "Web Attack \x96 XSS", "Web Attack – XSS", "Infilteration", "what", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, label string")
    got = [r.stage for r in labels.map_label(df, "label", flow_label_stages()).orderBy("i").collect()]
    assert got == [4, 2, 2, 3, 0, 0]


def test_entity_window_label(spark, at):
    windows = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("b", at(0))], "src_ip string, ts timestamp")
    truth = spark.createDataFrame([("a ", at(3), 2), ("a", at(9), 4), ("b", at(30), 1)], "src_ip string, ts timestamp, stage int")
    got = sorted((r.src_ip, r.ts, r.stage) for r in labels.label_by_entity_window(windows, truth, 10).collect())
    assert got == [("a", at(0), 4), ("a", at(10), 0), ("b", at(0), 0)]


def test_clear_of_boundaries(spark, at):
    iv = spark.createDataFrame([(at(1_000), at(1_100))], "start timestamp, end timestamp")
    df = spark.createDataFrame([(at(1_000 - g),) for g in (25, 30, 34, 60, 119, 200, 296, 304, 306)] + [(at(1_050),)], "ts timestamp")
    kept = {1_000 - int((r.ts - at(0)).total_seconds()) for r in labels.clear_of_boundaries(df, iv, 5).collect()}
    assert kept == {25, 60, 200, 306, -50}


def test_horizon_class_order():
    assert [n for n, _ in RISK_HORIZONS] == ["IMMINENT", "NEAR-TERM", "ELEVATED"]


def test_tasks_of_horizons_follow_the_given_number(spark):
    df = spark.createDataFrame([(str(i % 50), DAY + timedelta(seconds=60 * i)) for i in range(400)], "k string, ts timestamp")
    spans = spark.createDataFrame([(str(i), *ATTACKS[0]) for i in range(50)], "k string, start timestamp, end timestamp")
    plain = event_horizon(df, spans, "k", "ts", 600)
    dealt = event_horizon(df, spans, "k", "ts", 600, partitions=37)
    assert dealt.rdd.getNumPartitions() == 37
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_shared_times_are_looked_up_once(spark, capsys):
    """Many rows of one time, and rows without a time, in one series."""
    start, end = ATTACKS[0]
    times = [start - timedelta(seconds=30), start, end + timedelta(seconds=1), None]
    df = spark.createDataFrame([(i, times[i % 4]) for i in range(400)], "i int, ts timestamp")
    spans = spark.createDataFrame([ATTACKS[0]], "start timestamp, end timestamp")
    out = event_horizon(df, spans, None, "ts", 600)
    got = {r.i: (r._inside, r._gap) for r in out.collect()}
    want = [(False, 30.0), (True, None), (False, None), (False, None)]
    assert len(got) == 400 and all(v == want[i % 4] for i, v in got.items())
    # The rows themselves meet the answers after the windows, by a join.
    assert out.columns == ["i", "ts", "_inside", "_gap"]
    capsys.readouterr()
    out.explain()
    assert "Join" in capsys.readouterr().out
