"""Windows to fixed-length sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions.scalar import finite
from tideglass.operators.timeline import CHUNK, DAY, POS, as_keys, index_series, over_frames, row_index
from tideglass.schemas import SEQUENCE_LENGTH, WINDOW_FEATURES

SILENCE_COLUMNS = ("orig_bytes", "resp_bytes", "orig_pkts")


def drop_silent(df: DataFrame, cols: Sequence[str] = SILENCE_COLUMNS) -> DataFrame:
    """Keep rows in which at least one of ``cols`` is positive.

    NaN is not positive here, though Spark orders it above every number.
    """
    keep = F.lit(False)
    for c in cols:
        keep = keep | (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) > 0)
    return df.filter(keep)


def step_vector(features: Sequence[str]) -> Column:
    return F.array(*[finite(c) for c in features])


def make_sequences(
    df: DataFrame,
    key: str = "src_ip",
    ts: str = "ts",
    features: Sequence[str] = WINDOW_FEATURES,
    n: int = SEQUENCE_LENGTH,
    label: str = "stage",
    prob: str = "prob",
    tie: Sequence[str] = (),
    bucket_seconds: int = DAY,
) -> DataFrame:
    """Non-overlapping runs of ``n`` rows per source; the rest of fewer than
    ``n`` rows is dropped. Label and probability come from the last row.

    Groups hold exactly ``n`` rows, however long the series of a source is.
    """
    rows = df.filter(F.col(key).isNotNull()).select(
        key, ts, *tie, step_vector(features).alias("_x"),
        F.col(label).alias("_label"), F.col(prob).alias("_prob"),
    )
    numbered = row_index(rows, key, ts, tie, bucket_seconds)
    # Running number of the sequence within its source, from 0.
    seq = F.floor((F.col(POS) - 1) / F.lit(n)).cast("long")
    steps = F.array_sort(F.collect_list(F.struct(POS, "_x")))
    return (
        numbered.groupBy(key, seq.alias("seq_id"))
        .agg(
            F.min(ts).alias("start_ts"),
            F.max(ts).alias("end_ts"),
            F.transform(steps, lambda s: s["_x"]).alias("x"),
            F.max_by("_label", POS).alias("label"),
            F.max_by("_prob", POS).alias("prob"),
        )
        .filter(F.size("x") == n)
    )


def sliding_sequences(
    df: DataFrame,
    key: str | None = "src_ip",
    ts: str = "ts",
    features: Sequence[str] = WINDOW_FEATURES,
    n: int = SEQUENCE_LENGTH,
    keep: Sequence[str] = (),
    step: int | None = None,
    tie: Sequence[str] = (),
    bucket_seconds: int = DAY,
    chunk: int = CHUNK,
    partitions: int | None = None,
) -> DataFrame:
    """The ``n`` rows before each row, as a sequence stamped with that row's
    time. A source with r rows gives max(r - n, 0) sequences. Without a key all
    rows form one series named ``Unknown``."""
    keys = as_keys(key)
    rows = df.dropna(subset=keys) if keys else df
    rows = rows.select(*keys, ts, *tie, *keep, step_vector(features).alias("_x"))
    numbered = index_series(rows, keys, ts, step, tie, bucket_seconds)
    out = over_frames(
        numbered, keys, lambda w: {"x": F.collect_list("_x").over(w.rowsBetween(-n, -1))}, n, chunk, partitions
    ).filter(F.size("x") == n)
    if not keys:
        out = out.withColumn("src_ip", F.lit("Unknown"))
    return out.select(*(keys or ["src_ip"]), ts, *keep, "x")


def flatten_sequence(df: DataFrame, x: str = "x", out: str = "flat") -> DataFrame:
    """All features of the first step, then of the second, and so on."""
    return df.withColumn(out, F.flatten(x))


def sequence_vector(x: Column | str = "x") -> Column:
    """The flattened sequence as a ``pyspark.ml`` vector."""
    return array_to_vector(F.flatten(x))


def explode_steps(df: DataFrame, features: Sequence[str], x: str = "x") -> DataFrame:
    """One row per step, with the features as columns."""
    steps = df.select(F.explode(x).alias("_s"))
    return steps.select(*[F.col("_s")[i].alias(c) for i, c in enumerate(features)])
