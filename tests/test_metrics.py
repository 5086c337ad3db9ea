import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import metrics as M


def pairs(spark, rows):
    return spark.createDataFrame(rows, "y int, p int")


def test_report(spark):
    df = pairs(spark, [(0, 0)] * 5 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2 + [(2, 3)])
    got = {r["class"]: r for r in M.classification_report(df, "y", "p").collect()}
    assert got[0].precision == pytest.approx(5 / 7) and got[0].recall == pytest.approx(5 / 6)
    assert got[2].f1 == 0 and got[2].support == 1
    assert got[3].precision == 0 and got[3].recall == 0 and got[3].support == 0
    s = M.report_summary(df, "y", "p").first()
    assert s.accuracy == pytest.approx(7 / 11) and s.rows == 11
    assert s.macro_f1 == pytest.approx(sum(r.f1 for r in got.values()) / 4)
    assert s.weighted_f1 == pytest.approx(sum(r.f1 * r.support for r in got.values()) / 11)
    fp = {0: (2, 5), 1: (1, 7), 2: (0, 10), 3: (1, 11)}
    want = sum(a / b for a, b in fp.values()) / 4
    assert M.macro_fpr(df, "y", "p").first()[0] == pytest.approx(want)


def test_distribution_and_weights(spark):
    df = pairs(spark, [(0, 0)] * 6 + [(1, 0)] * 2)
    got = {r["class"]: (r.n, r.pct) for r in M.class_distribution(df, "y", range(3)).collect()}
    assert got == {0: (6, 75.0), 1: (2, 25.0), 2: (0, 0.0)}
    w = {r["class"]: r.weight for r in M.class_weights(df, "y", range(3)).collect()}
    assert w == {0: pytest.approx(8 / 12), 1: 2.0, 2: 1.0}
    assert M.class_distribution(df.filter("y = 9"), "y", [1]).first().pct == 0.0
    assert M.with_class_weight(df, "y").agg(F.sum("weight")).first()[0] == pytest.approx(8)


@pytest.mark.parametrize("bins", [2, 5, 256])
def test_curves_brute_force(spark, bins):
    rng = np.random.default_rng(bins)
    y = rng.integers(0, 3, 200)
    scores = rng.integers(0, 12, (200, 3)) / 12  # many ties
    df = spark.createDataFrame([(int(a), [float(v) for v in s]) for a, s in zip(y, scores)], "y int, probs array<double>")
    got = {r["class"]: r for r in M.ovr_curves(df, "y", "probs", 3, bins).collect()}
    for c in range(3):
        pos, neg = scores[y == c, c], scores[y != c, c]
        diff = pos[:, None] - neg[None, :]
        assert got[c].roc_auc == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())
        ap = 0.0
        for t in np.unique(scores[:, c])[::-1]:
            hit = (pos == t).sum() / len(pos)
            ap += hit * (pos >= t).sum() / ((pos >= t).sum() + (neg >= t).sum())
        assert got[c].average_precision == pytest.approx(ap)
    w = M.weighted_ovr(M.ovr_curves(df, "y", "probs", 3, bins)).first()
    n = [int((y == c).sum()) for c in range(3)]
    assert w.roc_auc == pytest.approx(sum(got[c].roc_auc * n[c] for c in range(3)) / 200)


def test_average_precision_is_a_step_sum(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5)]
    df = spark.createDataFrame([(y, [1 - p, p]) for y, p in rows], "y int, probs array<double>")
    got = {r["class"]: r.average_precision for r in M.ovr_curves(df, "y", "probs", 2).collect()}
    assert got[1] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)


def test_absent_class_has_no_score(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (0, [0.6, 0.4])], "y int, probs array<double>")
    got = {r["class"]: r.roc_auc for r in M.ovr_curves(df, "y", "probs", 2).collect()}
    assert got == {0: None, 1: None}


def test_losses(spark):
    df = spark.createDataFrame([(0, [0.25, 0.75]), (1, [0.0, 1.0])], "y int, probs array<double>")
    ce = -math.log(0.25)
    assert M.reduce_loss(df, M.cross_entropy("y", "probs")).first().loss == pytest.approx(ce / 2)
    assert M.reduce_loss(df, M.focal("y", "probs"), "sum").first().loss == pytest.approx(0.75**2 * ce)
    each = M.reduce_loss(df, M.focal("y", "probs", weights=[2.0, 1.0]), "none").collect()
    assert each[0].loss == pytest.approx((1 - math.exp(-2 * ce)) ** 2 * 2 * ce)
    b = M.reduce_loss(df, M.binary_cross_entropy("y", F.lit(0.5)), "sum").first().loss
    assert b == pytest.approx(2 * math.log(2))
    with pytest.raises(ValueError):
        M.reduce_loss(df, F.lit(1), "median")


def test_best_model(spark):
    df = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "model string, macro_f1 double")
    assert tuple(M.best_model(df).first()) == ("a", 0.9)
