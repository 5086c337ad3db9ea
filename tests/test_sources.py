import pytest
from pyspark.sql import functions as F

from tideglass.operators.windows import window_features
from tideglass.plans.jobs import build_windows, risk_windows_numeric, risk_windows_positional
from tideglass.schemas import POSITIONAL_FLOW_COLUMNS
from tideglass.sources import flow_logs, ground_truth, tables

FIELDS = ["ts", "uid", "id.orig_h", "id.resp_p", "duration", "orig_bytes", "resp_bytes"]


def write_log(path, fields, rows):
    lines = ["#separator \\x09", "#set_separator\t,", "#fields\t" + "\t".join(fields)]
    lines += ["\t".join(map(str, r)) for r in rows] + ["#close\t2018"]
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture
def logs(tmp_path):
    a = [(1518598803.5, f"C{i}", "10.0.0.1", 80 + i, "-", 100 * i, "-") for i in range(4)]
    write_log(tmp_path / "a.log", FIELDS, a)
    other = ["uid", "ts", "id.orig_h", "orig_bytes", "service"]
    write_log(tmp_path / "b.log", other, [("D1", 1518598839.0, "10.0.0.1", 7, "-"), ("D2", "bad", "10.0.0.2", 1, "http")] )
    (tmp_path / "tiny.log").write_text("#fields\tts\n1\n")
    write_log(tmp_path / "empty.log", FIELDS, [])
    (tmp_path / "noise.log").write_text("nothing here\n" * 20)
    (tmp_path / "skip.txt").write_text("x" * 500)
    return str(tmp_path)


def test_flow_logs(spark, logs):
    flows = flow_logs.read_flow_log(spark, logs)
    assert flows.count() == 6
    assert {c for c in ("src_ip", "dst_port", "service", "source_file")} <= set(flows.columns)
    first = flows.filter("uid = 'C3'").first()
    assert first.duration == 0.0 and first.orig_bytes == 300.0 and first.dst_port == 83
    assert str(first.ts) == "2018-02-14 09:00:03.500000"
    assert flows.filter("uid = 'D2'").first().ts is None
    # columns of another file are null before coercion and count as 0 in means
    merged = build_windows(flows).filter("src_ip = '10.0.0.1'")
    assert merged.count() == 4
    apart = build_windows(flows, by_file=True).filter("src_ip = '10.0.0.1'")
    assert apart.count() == 2


def test_no_log(spark, tmp_path):
    (tmp_path / "x.log").write_text("short")
    with pytest.raises(ValueError):
        flow_logs.read_flow_log(spark, str(tmp_path))


def test_corrupt_lines(spark, tmp_path):
    rows = [(1518598803, "C1", "h", 80, 1, 2, 3), (1518598804, "C2", "h", 80, 1, 2, 3)]
    write_log(tmp_path / "a.log", FIELDS, rows)
    with open(tmp_path / "a.log", "a") as f:
        f.write("1518598805\tC3\n")
    assert flow_logs.read_flow_log(spark, str(tmp_path)).count() == 3
    kept = flow_logs.read_flow_log(spark, str(tmp_path), corrupt=True).collect()
    assert [r.uid for r in kept if r._corrupt_record is not None] == ["C3"]


def test_ground_truth(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        "Flow ID, Source IP, Timestamp, Label\n"
        "1, 1.1.1.1 ,05/07/2017 9:05,Web Attack \x96 XSS\n"
        "2,2.2.2.2,5/7/2017 10:00:01,BENIGN\n"
        "3,3.3.3.3,never,DDoS\n".encode("latin-1")
    )
    (tmp_path / "b.csv").write_text("Label,src_ip,timestamp\n DDoS ,4.4.4.4,2018-02-14 09:00:00\nWeb Attack – XSS,6.6.6.6,2018-02-14\nodd,5.5.5.5,14/02/2018 9:00\n")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    got = {r.src_ip.strip(): (str(r.ts), r.stage) for r in ground_truth.read_labelled_flows(spark, str(tmp_path)).collect()}
    assert got == {
        "1.1.1.1": ("2017-07-05 09:05:00", 2), "2.2.2.2": ("2017-07-05 10:00:01", 0),
        "6.6.6.6": ("2018-02-14 00:00:00", 2),
        "4.4.4.4": ("2018-02-14 09:00:00", 4), "5.5.5.5": ("2018-02-14 09:00:00", 0),
    }


def test_places_of_columns():
    assert ground_truth.role_places(["Src IP", "Timestamp", "Label", "source ip2"]) == {"src_ip": 3, "ts": 1, "label": 2}
    assert ground_truth.role_places(["x"]) == {}


def test_header_behind_long_comments(spark, tmp_path):
    rows = [(1518598803, f"C{i}", "h", 80, 1, 2, 3) for i in range(50)]
    write_log(tmp_path / "a.log", FIELDS, rows)
    write_log(tmp_path / "b.log", FIELDS, rows)
    long = tmp_path / "b.log"
    long.write_text(("#" + "x" * 999 + "\n") * 2_100 + long.read_text())
    assert flow_logs.read_flow_log(spark, str(tmp_path)).count() == 100


def test_skipped_files_are_listed(spark, logs):
    got = {r.source_file.rsplit("/", 1)[1]: r.reason for r in flow_logs.skipped_logs(spark, logs).collect()}
    assert got == {"tiny.log": "too small", "noise.log": "no header"}


def test_quoted_and_marked_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Src IP","Timestamp","Label"\n1.1.1.1,05-07-2017 9:05,BENIGN\n')
    (tmp_path / "b.csv").write_text("\ufeffsrc_ip,timestamp,label\n2.2.2.2,2018/02/14 09:00,BENIGN\n3.3.3.3,2018-02-14 09:00:00.123,DDoS\n4.4.4.4,5 July 2017 09:05,DDoS\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    got = {r.src_ip: str(r.ts) for r in ground_truth.read_labelled_flows(spark, str(tmp_path)).collect()}
    assert got == {"1.1.1.1": "2017-07-05 09:05:00", "2.2.2.2": "2018-02-14 09:00:00", "3.3.3.3": "2018-02-14 09:00:00.123000", "4.4.4.4": "2017-07-05 09:05:00"}
    assert [r.source_file.rsplit("/", 1)[1] for r in ground_truth.skipped_truth_files(spark, str(tmp_path)).collect()] == ["c.csv"]


def test_numeric_flows(spark, tmp_path):
    names = [" Timestamp", " Label", " SYN Flag Count", " Average Packet Size", " Flow Duration",
             " Total Fwd Packets", " Total Backward Packets", "Flow Bytes/s", " Flow Packets/s"]
    rows = ["05/07/2017 9:00:00,BENIGN,1,10,5,2,3,9,Infinity", "05/07/2017 9:00:05,DDoS,0,20,5,2,3,9,4",
            "05/07/2017 9:01:00,,0,30,,2,3,9,NaN", "x,BENIGN,0,1,1,1,1,1,1"]
    (tmp_path / "day.csv").write_text("\n".join([",".join(names), *rows]) + "\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    flows = ground_truth.read_numeric_flows(spark, str(tmp_path))
    assert flows.count() == 3 and sorted(r[0] for r in flows.select("Flow Packets/s").collect()) == [0.0, 0.0, 4.0]
    out = risk_windows_numeric(flows).orderBy("ts").collect()
    assert len(out) == 7
    assert [r.attack_active for r in out] == [1, 0, 0, 0, 0, 0, 1]
    assert [r.label for r in out] == ["IMMINENT", "NEAR-TERM", "NEAR-TERM", "IMMINENT", "IMMINENT", "IMMINENT", "IMMINENT"]
    assert out[0].connections_per_sec == 0.2 and out[-1].connections_per_sec == 0.0
    assert out[1].connections_per_sec_diff == pytest.approx(-0.2) and out[1].connections_1m_avg == pytest.approx(0.1)


def test_positional_flows(spark, tmp_path):
    assert len(POSITIONAL_FLOW_COLUMNS) == 49
    def line(**kw):
        return ",".join(str(kw.get(c, "0")) for c in POSITIONAL_FLOW_COLUMNS)
    rows = [line(Stime=1421927414, dur=0, sbytes=10, dbytes=10, Spkts=1, Dpkts=1, state="con", Label=0),
            line(Stime=1421927434, dur=2, sbytes=10, dbytes=10, Spkts=0, Dpkts=0, state="FIN", Label=1),
            line(Stime="x", Label=1)]
    (tmp_path / "UNSW-NB15_1.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "UNSW-NB15_LIST.csv").write_text("a,b\n")
    flows = ground_truth.read_positional_flows(spark, str(tmp_path))
    assert flows.count() == 2
    a, b = flows.orderBy("ts").collect()
    assert (a.avg_packet_size, a.flow_packets_s, a.syn_equivalent, a.attack) == (10.0, 20000.0, 1, 0)
    assert (b.avg_packet_size, b.flow_packets_s, b.syn_equivalent, b.attack) == (0.0, 0.0, 0, 1)
    assert [r.label for r in risk_windows_positional(flows).orderBy("ts").collect()] == ["IMMINENT"] * 3


def test_window_tables(spark, logs, tmp_path):
    windows = window_features(flow_logs.read_flow_log(spark, logs))
    path = str(tmp_path / "w")
    tables.append_windows(windows, path)
    tables.append_windows(windows, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 * windows.count() and "day" in back.columns
    csv = str(tmp_path / "csv")
    tables.append_csv(windows.withColumnRenamed("src_ip", "id.orig_h"), csv)
    again = tables.read_windows_csv(spark, csv)
    assert again.columns[0] == "src_ip" and again.count() == windows.count()
    assert again.agg(F.sum("orig_bytes")).first()[0] == windows.agg(F.sum("orig_bytes")).first()[0]
    tables.save_report(windows.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().n == windows.count()
