"""Labels: from dictionaries, from ground truth, from the time to an attack."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.dimensions import NO_RISK, RISK_HORIZONS
from tideglass.functions.scalar import lookup, strip
from tideglass.operators.timeline import BUCKET, DAY, as_keys, bucket, event_horizon, split_hot


def map_label(df: DataFrame, label: str, stages: Mapping[str, int], out: str = "stage") -> DataFrame:
    """Trimmed text label to stage by a fixed dictionary; unknown labels are 0."""
    return df.withColumn(out, lookup(strip(label), stages, 0))


def map_label_table(
    df: DataFrame, label: str, dim: DataFrame, dim_label: str, dim_stage: str, out: str = "stage"
) -> DataFrame:
    """Same, with the dictionary as a table. No broadcast is forced: Spark
    broadcasts the dictionary when its size is known to be small."""
    dim = dim.select(F.col(dim_label).alias("_label"), F.col(dim_stage).alias("_stage"))
    joined = df.withColumn("_label", strip(label)).join(dim, "_label", "left")
    return joined.withColumn(out, F.coalesce("_stage", F.lit(0))).drop("_label", "_stage")


def malicious(df: DataFrame, stage: str = "stage") -> DataFrame:
    return df.filter(F.col(stage) > 0)


def attack_database(truth: DataFrame, src: str = "src_ip", stage: str = "stage") -> DataFrame:
    """Worst stage per source over all ground-truth rows with an attack.

    Sources are trimmed before grouping, so that each occurs once.
    """
    return (
        malicious(truth, stage)
        .filter(F.col(src).isNotNull())
        .groupBy(strip(src).alias("src_ip"))
        .agg(F.max(stage).alias("stage"))
    )


def label_by_entity(
    windows: DataFrame,
    database: DataFrame,
    key: str = "src_ip",
    db_key: str = "src_ip",
    db_stage: str = "stage",
    label: str = "stage",
    prob: str = "prob",
    salts: int = 8,
) -> DataFrame:
    """Stage and probability of each window from its source alone.

    ``database`` has one row per source. The join is salted: windows of one busy
    source go to ``salts`` tasks and the database row is repeated for each. A
    database small enough is broadcast by Spark's own size check instead.
    """
    db = database.select(F.col(db_key).alias("_key"), F.col(db_stage).cast("int").alias("_stage"))
    db = db.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = windows.withColumns(
        {"_key": strip(F.col(key).cast("string")), "_salt": split_hot(salts, *windows.columns)}
    )
    return (
        keyed.join(db, ["_key", "_salt"], "left")
        .withColumns(
            {
                label: F.coalesce("_stage", F.lit(0)),
                prob: F.when(F.col("_stage").isNotNull(), 1.0).otherwise(0.0),
            }
        )
        .drop("_key", "_salt", "_stage")
    )


def label_by_attackers(
    windows: DataFrame,
    stages: Mapping[str, int],
    key: str = "src_ip",
    label: str = "stage",
    prob: str = "prob",
) -> DataFrame:
    """Same, from a fixed address dictionary: a literal lookup, no join."""
    stage = lookup(strip(F.col(key).cast("string")), stages)
    return windows.withColumn("_stage", stage).withColumns(
        {
            label: F.coalesce("_stage", F.lit(0)),
            prob: F.when(F.col("_stage").isNotNull(), 1.0).otherwise(0.0),
        }
    ).drop("_stage")


def label_by_entity_window(
    windows: DataFrame,
    truth: DataFrame,
    width: int,
    key: str = "src_ip",
    ts: str = "ts",
    truth_key: str = "src_ip",
    truth_ts: str = "ts",
    truth_stage: str = "stage",
    label: str = "stage",
) -> DataFrame:
    """Worst ground-truth stage of the same source in the same window, else 0."""
    worst = (
        truth.filter(F.col(truth_key).isNotNull() & F.col(truth_ts).isNotNull())
        .groupBy(
            strip(F.col(truth_key).cast("string")).alias("_key"),
            F.window(F.col(truth_ts), f"{width} seconds").alias("_w"),
        )
        .agg(F.max(truth_stage).alias("_stage"))
        .select("_key", F.col("_w.start").alias("_start"), "_stage")
    )
    keyed = windows.withColumns(
        {"_key": strip(F.col(key).cast("string")), "_start": F.window(F.col(ts), f"{width} seconds")["start"]}
    )
    return (
        keyed.join(worst, ["_key", "_start"], "left")
        .withColumn(label, F.coalesce("_stage", F.lit(0)))
        .drop("_key", "_start", "_stage")
    )


def horizon_class(
    active: Column,
    gap: Column,
    horizons: Sequence[tuple[str, float]] = RISK_HORIZONS,
    default: str = NO_RISK,
) -> Column:
    """Risk class from "attack running" and the seconds to the next one."""
    out = F.when(active, F.lit(horizons[0][0]))
    for name, limit in horizons:
        out = out.when(gap <= limit, F.lit(name))
    return out.otherwise(F.lit(default))


def label_by_intervals(
    windows: DataFrame,
    intervals: DataFrame,
    ts: str = "ts",
    by: str | Sequence[str] | None = None,
    horizons: Sequence[tuple[str, float]] = RISK_HORIZONS,
    label: str = "label",
    **spread,
) -> DataFrame:
    """Risk class from a table of attack intervals (``start``, ``end``).

    ``ts`` is the *end* of the window. Inside a closed interval the class is the
    first of ``horizons``; else the distance to the next start decides.
    """
    reach = max(limit for _, limit in horizons)
    timed = event_horizon(windows, intervals, by, ts, reach, **spread)
    return timed.withColumn(
        label, horizon_class(F.col("_inside"), F.col("_gap"), horizons)
    ).drop("_inside", "_gap")


def lookahead_label(
    windows: DataFrame,
    by: str | Sequence[str] | None,
    ts: str = "ts",
    active: str = "attack_active",
    horizons: Sequence[tuple[str, float]] = RISK_HORIZONS,
    label: str = "label",
    bucket_seconds: int = DAY,
) -> DataFrame:
    """Risk class from the next window with an attack in the same series.

    Distances run from window start to window start and must be positive. A
    series is cut into time buckets. Windows with an attack are copied into the
    earlier buckets they can be seen from, so one shuffle is enough, and a task
    never needs more of a series than one bucket.
    """
    keys = as_keys(by)
    us = 1_000_000
    reach = max(limit for _, limit in horizons)
    size = max(bucket_seconds, int(reach) + 1)
    t = F.unix_micros(ts)
    home = bucket(ts, size)
    first = F.floor((t - int(reach * us)) / F.lit(size * us)).cast("long")
    attack = F.coalesce(F.col(active) == 1, F.lit(False))
    seen_from = F.when(attack, F.sequence(home, first, F.lit(-1).cast("long"))).otherwise(F.array(home))
    spread = windows.select("*", F.posexplode(seen_from).alias("_copy", BUCKET)).withColumn("_t", t)
    later = Window.partitionBy(*keys, BUCKET).orderBy(F.desc("_t")).rangeBetween(
        Window.unboundedPreceding, -1
    )
    gap = (F.min(F.when(attack, F.col("_t"))).over(later) - F.col("_t")) / F.lit(us)
    return (
        spread.withColumn(label, horizon_class(attack, gap, horizons))
        .filter(F.col("_copy") == 0)
        .drop("_copy", BUCKET, "_t")
    )


def clear_of_boundaries(
    windows: DataFrame,
    intervals: DataFrame,
    margin: float,
    ts: str = "ts",
    by: str | Sequence[str] | None = None,
    horizons: Sequence[tuple[str, float]] = RISK_HORIZONS,
    **spread,
) -> DataFrame:
    """Drop windows closer than ``margin`` seconds to a limit between classes."""
    reach = max(limit for _, limit in horizons) + margin
    timed = event_horizon(windows, intervals, by, ts, reach, **spread)
    gap = F.col("_gap")
    near = F.lit(False)
    for _, limit in horizons:
        near = near | (F.abs(gap - limit) < margin)
    keep = F.col("_inside") | ~F.coalesce(near, F.lit(False))
    return timed.filter(keep).drop("_inside", "_gap")


def attack_intervals(
    flows: DataFrame, by: Sequence[str], ts: str, attack: Column
) -> DataFrame:
    """First and last attack flow per group as an interval table."""
    return flows.filter(attack).groupBy(*by).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def stage_table(spark: SparkSession, stages: Mapping[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(stages.items()), "label string, stage int")
