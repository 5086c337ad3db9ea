import re
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import GroupedData

from tideglass.operators.anchored import anchored_windows, chain_ends, compose, steps_of
from tideglass.operators.packets import arrival_gaps, assemble_flows, connection_flows
from tideglass.schemas import FLOWS, PACKETS

START = datetime(2017, 7, 5, 9, 0, 0)


def packet(t, uid="c", src="a", dst="b", orig=True, v=4, ttl=64, length=100, tcp=True, flags=0, win=10, frame=114):
    return (START + timedelta(seconds=t), uid, src, dst, orig, v, ttl, length, tcp, flags, win, frame)


def test_one_connection(spark):
    rows = [
        packet(0, flags=0x02, win=100),
        packet(1, src="b", dst="a", orig=False, flags=0x12, win=50, ttl=50, length=60),
        packet(3, flags=0x10, win=200, ttl=63, length=40),
        packet(3, v=6, ttl=1, length=1, tcp=False),
        packet(10, src="b", dst="a", orig=False, flags=0x11, win=0, ttl=55, length=1500),
        packet(5, uid="single"),
    ]
    got = {r.uid: r for r in assemble_flows(spark.createDataFrame(rows, PACKETS)).collect()}
    c = got["c"]
    assert (c.src_ip, c.dst_ip, c.orig_pkts, c.resp_pkts, c.duration) == ("a", "b", 3, 2, 10.0)
    assert (c.min_ttl_orig, c.max_ttl_orig, c.payload_min_orig, c.payload_max_orig) == (63, 64, 40, 100)
    assert (c.min_ttl_resp, c.max_ttl_resp, c.payload_min_resp, c.payload_max_resp) == (50, 55, 60, 1500)
    assert c.avg_win_orig == 100.0 and c.avg_win_resp == 25.0
    assert (c.flag_syn, c.flag_ack, c.flag_fin, c.flag_rst, c.frag_count) == (2, 3, 1, 0, 0)
    gaps = [1, 2, 0, 7]
    assert c.iat_mean == pytest.approx(2.5) and c.iat_max == 7.0
    assert c.iat_var == pytest.approx(np.var(gaps))
    assert (got["single"].iat_mean, got["single"].iat_max, got["single"].iat_var) == (0.0, 0.0, 0.0)
    assert got["single"].avg_win_resp is None


@pytest.mark.parametrize("levels", [(1, 3_600), (), (60,)])
def test_gaps_brute_force(spark, levels):
    rng = np.random.default_rng(5)
    times = {u: np.sort(rng.uniform(0, 9_000, n).round(2)) for u, n in {"hot": 800, "b": 40, "c": 2}.items()}
    rows = [packet(float(t), uid=u) for u, ts in times.items() for t in ts]
    got = {r.uid: r for r in arrival_gaps(spark.createDataFrame(rows, PACKETS), levels=levels).collect()}
    for u, ts in times.items():
        gaps = np.diff(ts)
        assert got[u].iat_mean == pytest.approx(gaps.mean())
        assert got[u].iat_max == pytest.approx(gaps.max())
        assert got[u].iat_var == pytest.approx(gaps.var(), rel=1e-6)


def plain_loop(rows, width):
    """Window start to packets; the window still open at the end is left out."""
    out, start = defaultdict(list), None
    for row in sorted(rows, key=lambda r: r[0]):
        if start is None or (row[0] - start).total_seconds() >= width:
            start = row[0]
        out[start].append(row)
    out.pop(start)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_anchored_windows_equal_the_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    kind = seed % 3
    if kind == 0:  # idle gaps between bursts
        times = np.cumsum(rng.choice([0.1, 1.0, 4.0, 35.0, 400.0], 400))
    elif kind == 1:  # steady: chains do not merge
        times = np.arange(500) * 0.7
    else:
        times = np.sort(rng.uniform(0, 900, 700)).round(1)
    rows = [
        packet(float(t), src=str(rng.integers(4)), flags=int(rng.choice([2, 16])), frame=int(rng.integers(60, 99)))
        for t in times
    ]
    df = spark.createDataFrame(rows, PACKETS)
    want = plain_loop(rows, 10)
    for bucket_widths, fan in ((2, 3), (7, 2), (60, 32)):
        got = {r.ts: r for r in anchored_windows(df, width=10, bucket_widths=bucket_widths, fan=fan).collect()}
        assert set(got) == {s + timedelta(seconds=10) for s in want}
        for s, part in want.items():
            r = got[s + timedelta(seconds=10)]
            assert r.connections_per_sec == pytest.approx(len(part) / 10)
            assert r.syn_rate == pytest.approx(sum(p[9] == 2 for p in part) / 10)
            assert r.unique_source_ips == len({p[2] for p in part})
            assert r.avg_packet_size == pytest.approx(np.mean([p[11] for p in part]))


def test_anchored_windows_per_key(spark):
    rng = np.random.default_rng(9)
    rows = [packet(float(t), dst=d) for d in "xyz" for t in np.sort(rng.uniform(0, 300, 80)).round(1)]
    got = anchored_windows(spark.createDataFrame(rows, PACKETS), "dst_ip", bucket_widths=3).collect()
    for d in "xyz":
        want = plain_loop([r for r in rows if r[3] == d], 10)
        assert {r.ts for r in got if r.dst_ip == d} == {s + timedelta(seconds=10) for s in want}


def test_anchored_windows_of_many_captures(spark, monkeypatch):
    """Small captures share calls of Python, also where a batch ends inside of one."""
    calls = spark.sparkContext.accumulator(0)
    apply = GroupedData.applyInPandas

    def watched(self, func, schema):
        def run(names, pdf):
            calls.add(1)
            return func(names, pdf)

        return apply(self, run, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", watched)
    rng = np.random.default_rng(4)
    rows = [packet(float(t), dst=f"d{k:03}") for k in range(200) for t in np.sort(rng.uniform(0, 100, 9)).round(1)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = anchored_windows(spark.createDataFrame(rows, PACKETS), "dst_ip", bucket_widths=3, fan=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(f"d{k:03}", s + timedelta(seconds=10)) for k in range(200) for s in plain_loop([r for r in rows if r[3] == f"d{k:03}"], 10)}
    assert {(r.dst_ip, r.ts) for r in got} == want and len(got) == len(want)
    assert calls.value == 0


def steps_by_hand(times, entry, width):
    """Last start of a chain that enters at ``entry``; None if nothing is left."""
    last = None
    while len(later := times[times >= entry]):
        last = int(later[0])
        entry = last + width
    return last


@pytest.mark.parametrize("seed", range(5))
def test_steps_compose_in_any_grouping(seed):
    rng = np.random.default_rng(seed)
    width, size, n = 10, 40, 9
    times = np.unique(rng.integers(0, size * n, [400, 60, 12][seed % 3]))
    own = [(b * size, times[times // size == b]) for b in range(n) if (times // size == b).any()]
    lows, tables = [low for low, _ in own], [steps_of(t, low, width) for low, t in own]
    left = [compose(tables[:2], lows[:2], width), *tables[2:]] if len(tables) > 2 else tables
    pairs = [compose(tables[i : i + 2], lows[i : i + 2], width) for i in range(0, len(tables), 2)]
    for some, at in ((tables, lows), (left, [lows[0], *lows[2:]]), (pairs, lows[::2])):
        whole = compose(some, at, width)
        assert whole.after(None, width) == steps_by_hand(times, -1, width)
        for start in range(lows[0] - width, lows[0]):
            want = steps_by_hand(times, start + width, width)
            assert whole.after(start, width) == (start if want is None else want)
        assert len(whole.upto) <= width + 1
    assert (chain_ends(times, width)[0]) == steps_by_hand(times, int(times[0]), width)


def test_anchored_windows_of_odd_packets(spark):
    rows = [packet(0.5), packet(-3.5), packet(8, v=6), packet(9, v=None), packet(12), (None, *packet(1)[1:]), packet(40_000_000), packet(40_000_010)]
    df = spark.createDataFrame(rows, PACKETS)
    got = sorted(r.ts for r in anchored_windows(df, bucket_widths=1, fan=2).collect())
    assert got == [START + timedelta(seconds=s) for s in (6.5, 22, 40_000_010)]
    old = df.selectExpr("ts - INTERVAL 60 YEARS AS ts", "* EXCEPT (ts)")
    assert anchored_windows(old.unionByName(df), bucket_widths=100_000, fan=2).count() == 7
    assert anchored_windows(df.limit(0)).count() == 0
    assert anchored_windows(df.filter("ip_version = 6")).count() == 0


def test_anchored_windows_with_horizon_label(spark):
    df = spark.createDataFrame([packet(t, dst=d) for d in "xy" for t in range(0, 400, 5)], PACKETS)
    spans = spark.createDataFrame([("x", START + timedelta(seconds=200), START + timedelta(seconds=215))], "dst_ip string, start timestamp, end timestamp")
    got = anchored_windows(df, "dst_ip", intervals=spans, bucket_widths=3, fan=2).collect()
    label = {(r.dst_ip, int((r.ts - START).total_seconds())): r.label for r in got}
    assert len(label) == 2 * 39 and {v for (d, _), v in label.items() if d == "y"} == {"NORMAL"}
    assert [label["x", s] for s in (140, 150, 170, 200, 210, 220)] == ["NEAR-TERM", "NEAR-TERM", "IMMINENT", "IMMINENT", "IMMINENT", "NORMAL"]


def test_variance_of_nearly_equal_gaps(spark):
    """Gaps of 1000 s that differ by microseconds: the difference of large squares would be noise."""
    rng = np.random.default_rng(2)
    times = np.cumsum(np.concatenate(([0], 1_000_000_000 + rng.integers(-5, 6, 400)))).astype("int64")
    rows = [(START + timedelta(microseconds=int(t)), "u", "a", "b", True, 4, 1, 1, True, 0, 1, 1) for t in times]
    got = arrival_gaps(spark.createDataFrame(rows, PACKETS), levels=(1, 3_600)).first()
    gaps = np.diff(times) / 1e6
    exact = float(np.var(np.diff(times) - 1_000_000_000) / 1e12)
    assert got.iat_var == pytest.approx(exact, rel=1e-6) and got.iat_mean == pytest.approx(gaps.mean(), rel=1e-12)


def test_connection_records(spark):
    rows = [packet(0, flags=0x02, win=100), packet(2, src="b", dst="a", orig=False, win=30, flags=0x12), packet(1, uid="stray")]
    head = "uid string, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, proto string, service array<string>, duration double, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long, history string, more int"
    records = [
        ("c", START, "a", 1, "b", 80, "tcp", ["ssl", "http"], 2.0, 500, 60, 4, 0, "ShADtT", 1),
        ("quiet", START, "a", 2, "b", 53, "udp", [], None, None, None, 0, 0, None, 1),
        (None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    out = connection_flows(spark.createDataFrame(records, head), spark.createDataFrame(rows, PACKETS))
    assert out.schema.names == FLOWS.names and [f.dataType for f in out.schema] == [f.dataType for f in FLOWS]
    got = {r.uid: r for r in out.collect()}
    c, quiet = got["c"], got["quiet"]
    assert len(got) == 3 and (c.service, c.avg_win_orig, c.avg_win_resp, c.retrans_orig, c.retrans_resp) == ("http,ssl", 25.0, None, 1, 1)
    assert (c.flag_syn, c.flag_ack, c.iat_mean, c.iat_var, c.min_ttl_orig, c.orig_bytes, c.resp_pkts) == (2, 1, 2.0, 0.0, 64, 500, 0)
    assert (quiet.service, quiet.min_ttl_orig, quiet.avg_win_orig, quiet.flag_syn, quiet.iat_max, quiet.retrans_orig, quiet.frag_count) == ("-", None, None, 0, 0, 0, 0)


def test_flows_in_a_given_number_of_tasks(spark):
    rows = [packet(float(t), uid=f"c{t % 9}", src="a" if t % 2 else "b", orig=bool(t % 2)) for t in range(90)]
    df = spark.createDataFrame(rows, PACKETS)
    dealt = assemble_flows(df, 7)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, assemble_flows(df).collect()))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(uid[^)]*, (\d+)\)", plan)) == {"7"}, plan
