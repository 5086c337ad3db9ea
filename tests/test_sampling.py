import pytest
from pyspark.sql import functions as F

from tideglass.operators import sampling as S
from tideglass.operators.joins import null_safe_join


@pytest.fixture
def rows(spark):
    # one class holds most rows
    return spark.range(6_000).select(
        "id", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 50 == 3, 2).otherwise(0).alias("label")
    )


def counts(df):
    return {r.label: r["count"] for r in df.groupBy("label").count().collect()}


def test_caps_are_exact_and_stable(rows):
    full = counts(rows)
    out = S.cap_by_class(rows, "label", {0: 777, 2: 10_000, 1: 0})
    assert counts(out) == {0: 777, 2: full[2]}
    for n in (1, 7):
        again = S.cap_by_class(rows.repartition(n), "label", {0: 777, 2: 10_000, 1: 0})
        assert again.exceptAll(out).count() == 0 and again.count() == out.count()
    other = S.cap_by_class(rows, "label", {0: 777}, seed=7)
    assert other.filter("label = 0").exceptAll(out).count() > 0


def test_cap_takes_lowest_hashes(rows):
    out = {r.id for r in S.cap_by_class(rows, "label", {0: 50}).filter("label = 0").collect()}
    best = rows.filter("label = 0").orderBy(S.row_hash(42, "id"), "id").limit(50)
    assert out == {r.id for r in best.collect()}


def test_null_class_is_kept(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 0)], "id long, label int")
    assert S.cap_by_class(df, "label", {0: 1}).count() == 2


def test_balance_rules(spark, rows):
    full = counts(rows)
    attacks = full[1] + full[2]
    assert counts(S.balance_sequences(rows, "label", floor=10))[0] == 2 * attacks
    assert counts(S.balance_sequences(rows, "label", floor=5_000))[0] == min(full[0], 5_000)
    only = rows.filter("label = 0")
    assert S.balance_sequences(only, "label", floor=100).count() == 100
    named = rows.withColumn("label", F.element_at(F.array(*map(F.lit, ["NORMAL", "ELEVATED", "IMMINENT"])), F.col("label") + 1))
    out = counts(S.balance_risk(named, ratio=1))
    assert out == {"NORMAL": full[1], "ELEVATED": full[1], "IMMINENT": full[2]}
    none = named.filter("label <> 'ELEVATED'")
    assert counts(S.balance_risk(none)) == {"NORMAL": full[0], "IMMINENT": full[2]}


def test_splits(rows):
    part = S.hash_split(rows).groupBy("part").count().collect()
    share = {r.part: r["count"] / 6_000 for r in part}
    assert share["train"] == pytest.approx(0.8, abs=0.02)
    strat = S.stratified_split(rows, "label")
    for label, n in counts(rows).items():
        got = {r.part: r["count"] for r in strat.filter(F.col("label") == label).groupBy("part").count().collect()}
        test = round(n * 0.2)
        assert got["test"] == test and got["validation"] == int((n - test) * 0.1 + 0.5)
        assert sum(got.values()) == n


def test_chronological_split(spark, at):
    df = spark.createDataFrame([(i, at(i)) for i in range(100)], "id int, ts timestamp")
    out = S.chronological_split(df)
    assert out.filter("part = 'train'").count() == 80
    assert out.filter("part = 'test'").agg(F.min("id")).first()[0] == 80


def test_fraction_sample(rows):
    out = counts(S.sample_by_class(rows, "label", {0: 0.05}))
    full = counts(rows)
    assert out[1] == full[1] and out[2] == full[2]
    assert out[0] / full[0] == pytest.approx(0.05, abs=0.02)


def test_fuse(spark, at):
    a = spark.createDataFrame([(at(0), 1.0, 1, "NORMAL")], "Timestamp timestamp, x double, attack_active int, label string")
    b = spark.createDataFrame([(2.0, "IMMINENT"), (2.0, "IMMINENT")], "x double, label string")
    out = S.fuse({"a": a, "b": b})
    assert set(out.columns) == {"x", "label", "dataset", "y"}
    assert sorted((r.dataset, r.x, r.y) for r in out.collect()) == [("a", 1.0, 0), ("b", 2.0, 3), ("b", 2.0, 3)]


def test_null_safe_join(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (None, 20)], "k int, w int")
    assert sorted(null_safe_join(left, right, "k", "left").select("v", "w").collect()) == [("a", 10), ("b", 20)]


def test_null_labels_are_split_like_a_class(spark):
    df = spark.range(100).selectExpr("cast(id as string) id", "case when id % 2 = 0 then 'x' end label")
    out = S.stratified_split(df, "label").groupBy("label", "part").count().collect()
    assert {(r.label, r.part): r["count"] for r in out if r.label is None} == {(None, "test"): 10, (None, "validation"): 4, (None, "train"): 36}


def test_shuffle_is_reproducible(rows):
    a = [r.id for r in S.shuffle_rows(rows).limit(20).collect()]
    assert a == [r.id for r in S.shuffle_rows(rows.repartition(5)).limit(20).collect()]
    assert a != sorted(a)


def test_rank_of_a_shuffled_order(spark):
    df = spark.range(3_000).selectExpr("cast(id as string) id", "1 as rank").repartition(7)
    want = [r.id for r in S.shuffle_rows(df, 7).collect()]
    got = sorted((r.place, r.id) for r in S.shuffle_rank(df, 7, out="place").collect())
    assert [p for p, _ in got] == list(range(1, 3_001)) and [i for _, i in got] == want
    assert S.shuffle_rank(df.limit(0)).count() == 0
