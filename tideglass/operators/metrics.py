"""Class counts, confusion matrix, reports, ranking metrics, losses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.joins import null_safe_join

CLIP = 1e-15


def class_distribution(
    df: DataFrame, label: str, classes: Mapping | Sequence | None = None
) -> DataFrame:
    """Rows and percent per class; listed classes without rows show 0."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    if classes is not None:
        kind = df.schema[label].dataType.simpleString()
        listed = df.sparkSession.createDataFrame([(c,) for c in classes], f"class {kind}")
        counts = (
            counts.unionByName(listed.withColumn("n", F.lit(0).cast("long")))
            .groupBy("class")
            .agg(F.sum("n").alias("n"))
        )
    share = F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(F.lit(0))))
    return counts.withColumn("pct", F.coalesce(share, F.lit(0.0)))


def class_weights(df: DataFrame, label: str, classes: Sequence | None = None) -> DataFrame:
    """n / (k · n_c) per class that occurs; a listed class without rows gets 1."""
    dist = class_distribution(df, label, classes)
    total = Window.partitionBy(F.lit(0))
    k = F.sum((F.col("n") > 0).cast("int")).over(total)
    weight = F.try_divide(F.sum("n").over(total).cast("double"), k * F.col("n"))
    return dist.select("class", "n", F.coalesce(weight, F.lit(1.0)).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(
        F.col("class").alias(label), F.col("weight").alias(out)
    )
    return null_safe_join(df, weights, label, "left")


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class_counts(matrix: DataFrame) -> DataFrame:
    """Hits, true rows and predicted rows of every class in truth or prediction."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    n = F.col("n")
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.cast("long").alias("tp"), n.alias("support"), zero.alias("predicted")),
        F.struct(F.col("pred").alias("class"), zero.alias("tp"), zero.alias("support"), n.alias("predicted")),
    )
    return (
        matrix.select(F.explode(sides).alias("s"))
        .groupBy("s.class")
        .agg(
            F.sum("s.tp").alias("tp"),
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
        )
    )


def _ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero division counts as 0.

    Covers every class of truth or prediction, like the macro mean does.
    """
    counts = per_class_counts(confusion_matrix(df, label, pred))
    return counts.select(
        "class",
        _ratio("tp", "predicted").alias("precision"),
        _ratio("tp", "support").alias("recall"),
        _ratio(F.col("tp") * 2, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def report_summary(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: accuracy, macro and weighted means."""
    report = classification_report(df, label, pred)
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    # The support-weighted mean of the recalls is the accuracy.
    return report.agg(
        weighted("recall").alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
        total.alias("rows"),
    )


def macro_fpr(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Mean over the classes of FP / (FP + TN)."""
    counts = per_class_counts(confusion_matrix(df, label, pred))
    rows = F.sum("support").over(Window.partitionBy(F.lit(0)))
    fp = F.col("predicted") - F.col("tp")
    return counts.withColumn("fpr", _ratio(fp, rows - F.col("support"))).agg(
        F.avg("fpr").alias("macro_fpr")
    )


def ovr_curves(df: DataFrame, label: str, probs: str, classes: int, bins: int = 256) -> DataFrame:
    """ROC-AUC and average precision per class, each against the rest.

    Rows collapse to counts per (class, score). The running sums over the sorted
    scores are cut into ``bins`` ranges of about equally many scores each, so
    that no task sorts all scores of a class; the ranges are joined by totals.
    """
    if bins < 2:
        raise ValueError("at least two ranges are needed")
    scored = df.select(F.col(label).alias("_y"), F.posexplode(probs).alias("class", "score"))
    scored = scored.filter(F.col("class") < classes)
    hit = (F.col("_y") == F.col("class")).cast("long")
    counts = (
        scored.groupBy("class", "score")
        .agg(F.sum(F.coalesce(hit, F.lit(0))).alias("pos"), F.count(F.lit(1)).alias("n"))
        .withColumn("neg", F.col("n") - F.col("pos"))
    )
    cuts = [i / bins for i in range(1, bins)]
    splits = counts.groupBy("class").agg(F.percentile_approx("score", cuts, 2_000).alias("_cuts"))
    # Every 16th cut narrows the search down to 16 of them.
    splits = splits.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % 16 == 15))

    def under(array: Column | str) -> Column:
        return F.size(F.filter(array, lambda c: c < F.col("score")))

    binned = (
        null_safe_join(counts, splits, "class")
        .withColumn("_bin", under("_coarse") * 16)
        .withColumn("_bin", F.col("_bin") + under(F.slice("_cuts", F.col("_bin") + 1, 16)))
        .drop("_cuts", "_coarse")
    )
    totals = binned.groupBy("class", "_bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    above = Window.partitionBy("class").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("class")
    totals = totals.select(
        "class",
        "_bin",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("q").over(above), F.lit(0)).alias("_q0"),
        F.sum("p").over(whole).alias("_p"),
        F.sum("q").over(whole).alias("_q"),
    )
    upto = Window.partitionBy("class", "_bin").orderBy(F.desc("score"))
    tp = F.col("_p0") + F.sum("pos").over(upto)
    fp = F.col("_q0") + F.sum("neg").over(upto)
    # A pair counts one if the positive scores higher, one half on a tie.
    won = F.col("pos") * (F.col("_q") - F.col("_fp") + F.col("neg") / 2)
    gained = F.col("pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    return (
        binned.join(totals, ["class", "_bin"])
        .withColumns({"_tp": tp, "_fp": fp})
        .groupBy("class")
        .agg(
            F.max("_p").alias("positives"),
            F.try_divide(F.sum(won), F.max("_p") * F.max("_q").cast("double")).alias("roc_auc"),
            F.try_divide(F.sum(gained), F.max("_p")).alias("average_precision"),
        )
    )


def weighted_ovr(curves: DataFrame) -> DataFrame:
    """Means of ``ovr_curves`` weighted by the positives of each class."""

    def weighted(c: str) -> Column:
        w = F.when(F.col(c).isNotNull(), F.col("positives"))
        return F.try_divide(F.sum(F.col(c) * w), F.sum(w))

    return curves.agg(
        weighted("roc_auc").alias("roc_auc"),
        weighted("average_precision").alias("average_precision"),
    )


def cross_entropy(label: Column | str, probs: Column | str, weights: Sequence[float] | None = None) -> Column:
    """-ln of the probability of the true class, times its class weight."""
    label = F.col(label) if isinstance(label, str) else label
    probs = F.col(probs) if isinstance(probs, str) else probs
    p = F.get(probs, label.cast("int"))
    loss = -F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(CLIP)))
    if weights is not None:
        loss = loss * F.get(F.array(*map(F.lit, weights)), label.cast("int"))
    return loss


def focal(label: Column | str, probs: Column | str, gamma: float = 2.0, weights: Sequence[float] | None = None) -> Column:
    """(1 - p)^gamma times the cross entropy; p is exp(-weighted entropy)."""
    ce = cross_entropy(label, probs, weights)
    return F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce


def binary_cross_entropy(target: Column | str, prob: Column | str) -> Column:
    target = F.col(target) if isinstance(target, str) else target
    prob = F.col(prob) if isinstance(prob, str) else prob
    p = F.greatest(F.least(prob, F.lit(1 - CLIP)), F.lit(CLIP))
    return -(target * F.log(p) + (1 - target) * F.log(1 - p))


def reduce_loss(df: DataFrame, loss: Column, how: str = "mean", out: str = "loss", weight: Column | None = None) -> DataFrame:
    """``mean`` (divided by the sum of ``weight`` if given), ``sum`` or ``none``."""
    if how == "none":
        return df.withColumn(out, loss)
    if how == "sum":
        return df.agg(F.sum(loss).alias(out))
    if how == "mean":
        total = F.sum(weight) if weight is not None else F.count(loss)
        return df.agg(F.try_divide(F.sum(loss), total).alias(out))
    raise ValueError(f"unknown reduction {how!r}")


def activity(df: DataFrame, key: str = "src_ip", ts: str = "ts") -> DataFrame:
    """Distinct sources and the covered time range."""
    return df.agg(
        F.count_distinct(key).alias("sources"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def best_model(scores: DataFrame, model: str = "model", score: str = "macro_f1") -> DataFrame:
    """The model of highest score; the first by name on ties."""
    top = scores.agg(F.max(score).alias("_top"))
    return (
        null_safe_join(scores.withColumn("_k", F.lit(0)), top.withColumn("_k", F.lit(0)), "_k")
        .filter(F.col(score) == F.col("_top"))
        .agg(F.min(model).alias(model), F.max(score).alias(score))
    )
