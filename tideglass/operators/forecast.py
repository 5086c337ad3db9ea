"""Scored sequences to timelines, alerts, views and explanations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.dimensions import STAGE_NAMES
from tideglass.functions.scalar import lookup, time_text
from tideglass.functions.scores import argmax, next_stage, percent_weights, softmax, status_band
from tideglass.operators.joins import null_safe_join
from tideglass.operators.timeline import DAY, POS, over_frames, row_index


def interpret(df: DataFrame, logits: str = "logits", prob: str = "prob", names: Mapping = STAGE_NAMES) -> DataFrame:
    """Logits and a 0-1 probability to stage, confidence, next stage and status."""
    return (
        df.withColumn("probs", softmax(logits))
        .withColumns({"stage": argmax("probs"), "confidence": F.array_max("probs") * 100})
        .withColumns(
            {
                "threat_prob": F.col(prob) * 100,
                "stage_name": lookup("stage", names),
            }
        )
        .withColumns(
            {
                "next_stage": next_stage("threat_prob", "stage", last=max(names)),
                "status": status_band("confidence", "stage"),
            }
        )
    )


def timeline(
    predictions: DataFrame, key: str = "src_ip", ts: str = "ts", bucket_seconds: int = DAY
) -> DataFrame:
    """Numbered points of each source: window, time, probability, stage, confidence."""
    return row_index(predictions, key, ts, (), bucket_seconds).select(
        key,
        (F.col(POS) - 1).alias("window"),
        time_text(ts).alias("time"),
        "threat_prob", "stage_name", "confidence",
    )


def stage_alerts(
    predictions: DataFrame,
    key: str | None = "src_ip",
    ts: str = "ts",
    prob: str = "threat_prob",
    stage: str = "stage",
    threshold: float = 75,
    critical: float = 90,
    tie: Sequence[str] = (),
    bucket_seconds: int = DAY,
) -> DataFrame:
    """An alert whenever a threatening prediction has another stage than the
    alert before it. Equal stages in between are not repeated."""
    loud = predictions.filter(F.col(prob) > threshold)
    numbered = row_index(loud, key, ts, tie, bucket_seconds)
    out = over_frames(numbered, key, lambda w: {"_before": F.lag(stage).over(w)}, 1)
    changed = F.col("_before").isNull() | (F.col("_before") != F.col(stage))
    severity = F.when(F.col(prob) > critical, "critical").otherwise("warning")
    return out.filter(changed).withColumn("severity", severity).drop("_before", POS)


def newest(df: DataFrame, n: int, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The ``n`` latest rows, latest first."""
    return df.orderBy(F.desc(ts), *tie).limit(n)


def first_rows(df: DataFrame, n: int, key: str, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by source and time."""
    return df.orderBy(key, ts, *tie).limit(n)


def telemetry(
    predictions: DataFrame, windows: DataFrame, width: int, n: int = 100, key: str = "src_ip", ts: str = "ts"
) -> DataFrame:
    """Latest scored windows with their measured flow and SYN rates."""
    latest = newest(predictions, n, ts, (key,)).select(key, ts, "stage_name", "threat_prob")
    rates = windows.select(
        key, ts,
        (F.col("flow_count") / width).alias("connections_per_sec"),
        (F.col("flag_syn") / width).alias("syn_rate"),
    )
    return null_safe_join(rates, latest, [key, ts])


def history(predictions: DataFrame, n: int, key: str = "src_ip", ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` predictions of every source; ranked within each input
    partition first, so a busy source sends few rows on."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), *tie)
    return predictions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def current_status(predictions: DataFrame, key: str = "src_ip", ts: str = "ts") -> DataFrame:
    """Newest prediction of each source with its forecast."""
    last = F.max_by(F.struct("stage", "stage_name", "confidence", "threat_prob"), ts)
    return (
        predictions.groupBy(key)
        .agg(F.max(ts).alias(ts), last.alias("p"))
        .select(key, ts, "p.*")
        .withColumns(
            {
                "next_stage": next_stage("threat_prob", "stage"),
                "status": status_band("confidence", "stage"),
            }
        )
    )


def criticality_score(
    df: DataFrame, assets: DataFrame, key: str = "src_ip", prob: str = "prob", weight: str = "weight", default: float = 1.0
) -> DataFrame:
    """Probability times the weight of the asset, at most 1."""
    joined = null_safe_join(df, assets.select(key, F.col(weight).alias("_w")), key, "left")
    score = F.least(F.lit(1.0), F.col(prob) * F.coalesce("_w", F.lit(default)))
    return joined.withColumn("risk_score", score).drop("_w")


def top_k_features(weights: Column | str, names: Sequence[str], k: int = 8) -> Column:
    """The ``k`` largest shares as an array of (feature, share), largest first;
    equal shares keep the order of ``names``."""
    shares = percent_weights(weights)
    labels = F.array(*[F.lit(n) for n in names])
    ranked = F.array_sort(
        F.transform(shares, lambda s, i: F.struct((-s).alias("minus"), i.alias("i")))
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda r: F.struct(F.get(labels, r["i"]).alias("feature"), (-r["minus"]).alias("share")),
    )


def linear_contributions(
    x: Column | str, coefficients: Sequence[float], means: Sequence[float]
) -> Column:
    """Exact contribution of each feature of a linear score: coef · (x - mean)."""
    x = F.col(x) if isinstance(x, str) else x
    params = F.array(
        *[F.struct(F.lit(float(c)).alias("c"), F.lit(float(m)).alias("m")) for c, m in zip(coefficients, means)]
    )
    return F.zip_with(x, params, lambda v, p: p["c"] * (v - p["m"]))


def explain(
    df: DataFrame, x: str, coefficients: Sequence[float], means: Sequence[float], names: Sequence[str], k: int = 8
) -> DataFrame:
    """Adds ``contributions`` and the ``top`` features of a linear model."""
    return df.withColumn("contributions", linear_contributions(x, coefficients, means)).withColumn(
        "top", top_k_features("contributions", names, k)
    )
