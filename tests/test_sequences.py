import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.functions.scalar import clean_numeric
from tideglass.operators import sequences as S
from tideglass.operators.timeline import POS, row_index

SCHEMA = "src_ip string, ts timestamp, a double, b double, stage int, prob double"


def series(at, lengths, gap=10):
    return [
        (k, at(i * gap), float(i), float(-i), i % 5, float(i % 2))
        for k, n in lengths.items()
        for i in range(n)
    ]


@pytest.mark.parametrize("bucket", [30, 86_400])
@pytest.mark.parametrize("parts", [1, 7])
def test_counts_and_contents(spark, at, bucket, parts):
    lengths = {"one": 1, "five": 5, "six": 6, "seven": 7, "twelve": 12, "thirteen": 13, "hot": 400}
    df = spark.createDataFrame(series(at, lengths) + [(None, at(0), 1.0, 1.0, 0, 0.0)], SCHEMA).repartition(parts)
    fixed = S.make_sequences(df, features=["a", "b"], bucket_seconds=bucket).collect()
    count = {k: sum(r.src_ip == k for r in fixed) for k in lengths}
    assert count == {k: n // 6 for k, n in lengths.items()}
    for r in fixed:
        first = r.seq_id * 6
        assert r.x == [[float(i), float(-i)] for i in range(first, first + 6)]
        assert (r.label, r.prob) == ((first + 5) % 5, float((first + 5) % 2))
        assert (r.start_ts, r.end_ts) == (at(first * 10), at((first + 5) * 10))
    for step in (None, 10):
        slid = S.sliding_sequences(df, features=["a", "b"], bucket_seconds=bucket, step=step, chunk=8).collect()
        count = {k: sum(r.src_ip == k for r in slid) for k in lengths}
        assert count == {k: max(n - 6, 0) for k, n in lengths.items()}
        for r in slid:
            i = int((r.ts - at(0)).total_seconds()) // 10
            assert r.x == [[float(j), float(-j)] for j in range(i - 6, i)]


def test_scenario_counts(spark, at):
    lengths = {"172.31.2.10": 60, "18.219.9.1": 120, "172.31.3.55": 50}
    df = spark.createDataFrame(series(at, lengths), SCHEMA)
    assert S.make_sequences(df, features=["a"]).count() == 38
    assert S.sliding_sequences(df, features=["a"]).count() == 212


def test_without_key(spark, at):
    df = spark.createDataFrame(series(at, {"x": 9}), SCHEMA).drop("src_ip")
    out = S.sliding_sequences(df, key=None, features=["a"])
    assert [r.src_ip for r in out.collect()] == ["Unknown"] * 3


def test_row_index_with_ties(spark, at):
    rng = np.random.default_rng(0)
    rows = [(str(k), at(int(t)), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500)))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    out = row_index(df, "k", "ts", ("i",), 7).collect()
    for k in "012":
        want = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        assert [r.i for r in sorted((r for r in out if r.k == k), key=lambda r: r[POS])] == want
        assert sorted(r[POS] for r in out if r.k == k) == list(range(1, len(want) + 1))


def test_silence_then_clean(spark):
    rows = [(0.0, 0.0, 0.0), (float("nan"), None, 0.0), (float("inf"), 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "orig_bytes double, resp_bytes double, orig_pkts double")
    kept = clean_numeric(S.drop_silent(df), ["orig_bytes", "resp_bytes", "orig_pkts"]).collect()
    assert sorted(tuple(r) for r in kept) == [(0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 2.0, 0.0)]


def test_flatten_is_row_major(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "x array<array<double>>")
    assert S.flatten_sequence(df).first().flat == [1.0, 2.0, 3.0, 4.0]
    assert list(df.select(S.sequence_vector().alias("v")).first().v) == [1.0, 2.0, 3.0, 4.0]
    assert S.explode_steps(df, ["p", "q"]).collect() == [(1.0, 2.0), (3.0, 4.0)]
    assert df.select(F.size("x")).first()[0] == 2
