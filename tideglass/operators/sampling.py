"""Class caps, balancing, splits and fusion, all by row hash.

Which rows are taken depends only on seed and row id, never on partitioning.
Exact quotas are met without sorting a class: a histogram over hash prefixes
finds the prefix in which the quota is reached, only the rows of that prefix
are ranked, and their rank yields one cut per class. The rows themselves are
then filtered by comparing with the cut; they are not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.dimensions import RISK_CLASSES
from tideglass.functions.hashing import SPACE, below, row_hash
from tideglass.functions.scalar import drop_columns, lookup
from tideglass.operators.joins import null_safe_join
from tideglass.operators.scaling import exact_quantiles
from tideglass.operators.sequences import drop_silent
from tideglass.operators.timeline import offsets

PREFIX_BITS = 16
#: Ranges of the hash whose rows are numbered apart.
RANK_PARTS = 4_096


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def hash_cuts(df: DataFrame, label: str, quotas: DataFrame, seed, row_id: str) -> DataFrame:
    """First (hash, id) beyond each quota: (label, which, cut).

    ``quotas`` is (label, which, quota); ``which`` tells several quotas of a
    class apart. A class with no more rows than its quota gets no row here.
    """
    hashed = df.select(
        F.col(label).alias("_label"),
        F.struct(row_hash(seed, row_id).alias("h"), F.col(row_id).alias("id")).alias("_key"),
    ).withColumn("_bin", F.shiftright("_key.h", 32 - PREFIX_BITS))
    bins = hashed.groupBy("_label", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_bin")
    quota = quotas.select(
        F.col(label).alias("_label"), "which", F.col("quota").cast("long").alias("_quota")
    )
    edges = (
        bins.withColumn("_sum", F.sum("_n").over(upto))
        .transform(lambda d: null_safe_join(d, quota, "_label"))
        .filter((F.col("_sum") > F.col("_quota")) & (F.col("_sum") - F.col("_n") <= F.col("_quota")))
        .select(
            "_label", "_bin", "which", (F.col("_quota") - F.col("_sum") + F.col("_n")).alias("_left")
        )
    )
    rank = Window.partitionBy("_label", "which").orderBy("_key")
    return (
        null_safe_join(hashed, edges, ["_label", "_bin"])
        .withColumn("_rn", F.row_number().over(rank))
        .filter(F.col("_rn") == F.col("_left") + 1)
        .select(F.col("_label").alias(label), "which", F.col("_key").alias("_cut"))
    )


def mark_quotas(
    df: DataFrame, label: str, quotas: DataFrame, seed, row_id: str, names: Sequence[str]
) -> DataFrame:
    """Adds a flag per name: true for the ``quota`` rows of lowest hash per class.

    Classes without a quota of that name are wholly true. ``row_id`` must be
    unique. All quotas are met in the same passes over the data.
    """
    cuts = hash_cuts(df, label, quotas, seed, row_id).groupBy(label).agg(
        *[F.max(F.when(F.col("which") == n, F.col("_cut"))).alias(f"_cut_{n}") for n in names]
    )
    key = F.struct(row_hash(seed, row_id).alias("h"), F.col(row_id).alias("id"))
    flags = {n: F.col(f"_cut_{n}").isNull() | (key < F.col(f"_cut_{n}")) for n in names}
    out = null_safe_join(df, cuts, label, "left").withColumns(flags)
    return out.drop(*[f"_cut_{n}" for n in names])


def _quota_table(df: DataFrame, label: str, caps: Mapping) -> DataFrame:
    rows = [(k, int(v)) for k, v in caps.items()]
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"`{label}` {kind}, quota long")


def cap_by_class(
    df: DataFrame, label: str, caps: Mapping | DataFrame, seed=42, row_id: str = "id"
) -> DataFrame:
    """At most ``caps[class]`` rows of each listed class, exactly that many if
    there are enough; other classes are kept whole."""
    quotas = caps if isinstance(caps, DataFrame) else _quota_table(df, label, caps)
    quotas = quotas.withColumn("which", F.lit("_in"))
    return mark_quotas(df, label, quotas, seed, row_id, ["_in"]).filter("_in").drop("_in")


def sample_by_class(
    df: DataFrame, label: str, fractions: Mapping, seed=42, row_id: str = "id"
) -> DataFrame:
    """A share of each listed class; other classes are kept whole."""
    keep = F.lit(None).cast("boolean")
    for cls, share in fractions.items():
        keep = F.when(F.col(label) == F.lit(cls), below(seed, row_id, share)).otherwise(keep)
    return df.filter(F.coalesce(keep, F.lit(True)))


def balance_active(
    df: DataFrame, label: str = "stage", normal: int = 0, budget: int = 15_000, seed=42, row_id: str = "id"
) -> DataFrame:
    """Windows with traffic; the normal class is capped."""
    return cap_by_class(drop_silent(df), label, {normal: budget}, seed, row_id)


def balance_sequences(
    df: DataFrame,
    label: str = "label",
    normal: int = 0,
    floor: int = 5_000,
    ratio: int = 2,
    seed=42,
    row_id: str = "id",
) -> DataFrame:
    """All attack sequences and max(ratio · attacks, floor) normal ones at most."""
    attack = F.col(label) != normal
    quota = df.agg(
        F.lit(normal).cast(df.schema[label].dataType).alias(label),
        F.greatest(F.count_if(attack) * ratio, F.lit(floor)).alias("quota"),
    )
    return cap_by_class(df, label, quota, seed, row_id)


def balance_risk(
    df: DataFrame,
    label: str = "label",
    capped: Sequence[str] = ("NORMAL", "IMMINENT"),
    rare: Sequence[str] = ("ELEVATED", "NEAR-TERM"),
    ratio: int = 5,
    seed=42,
    row_id: str = "id",
) -> DataFrame:
    """Cap the large classes at ``ratio`` times the larger rare class, unless
    there is no rare row at all."""
    target = reduce(
        lambda a, b: F.greatest(a, b), [F.count_if(F.col(label) == r) for r in rare]
    ) * ratio
    quotas = (
        df.agg(target.alias("quota"))
        .filter("quota > 0")
        .select(F.explode(F.array(*[F.lit(c) for c in capped])).alias(label), "quota")
    )
    return cap_by_class(df, label, quotas, seed, row_id)


def hash_split(
    df: DataFrame, fraction: float = 0.8, seed=42, row_id: str = "id", out: str = "part"
) -> DataFrame:
    """Random split into ``train`` and ``test``."""
    return df.withColumn(out, F.when(below(seed, row_id, fraction), "train").otherwise("test"))


def stratified_split(
    df: DataFrame,
    label: str,
    test: float = 0.2,
    validation: float = 0.1,
    seed=42,
    row_id: str = "id",
    out: str = "part",
) -> DataFrame:
    """Exact shares per class: ``test`` of all rows, then ``validation`` of the rest.

    One hash order serves both cuts: the lowest hashes of a class are its test
    rows, the next ones its validation rows.
    """
    test_n = F.round(F.col("n") * test).cast("long")
    both_n = test_n + F.round((F.col("n") - test_n) * validation).cast("long")
    each = F.array(
        F.struct(F.lit("_test").alias("which"), test_n.alias("quota")),
        F.struct(F.lit("_both").alias("which"), both_n.alias("quota")),
    )
    quotas = class_counts(df, label).select(label, F.inline(each))
    part = F.when(F.col("_test"), "test").when(F.col("_both"), "validation").otherwise("train")
    marked = mark_quotas(df, label, quotas, seed, row_id, ["_test", "_both"])
    return marked.withColumn(out, part).drop("_test", "_both")


def chronological_split(df: DataFrame, ts: str = "ts", fraction: float = 0.8, out: str = "part") -> DataFrame:
    """Earlier rows train, later rows test, cut at a quantile of time."""
    micros = df.select(F.unix_micros(ts).cast("double").alias("t"))
    cut = exact_quantiles(micros, ["t"], [fraction])["t"][0]
    early = F.unix_micros(ts).cast("double") < F.lit(cut)
    return df.withColumn(out, F.when(early, "train").otherwise("test"))


def stack(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def fuse(
    parts: Mapping[str, DataFrame],
    label: str = "label",
    classes: Mapping[str, int] = RISK_CLASSES,
    drop: Sequence[str] = ("timestamp", "ts", "attack_active"),
) -> DataFrame:
    """Several labelled window tables as one, with class number and origin."""
    ready = [
        drop_columns(df, drop).withColumn("dataset", F.lit(name)) for name, df in parts.items()
    ]
    return stack(*ready).withColumn("y", lookup(label, classes))


def shuffle_rows(df: DataFrame, seed=42, row_id: str = "id") -> DataFrame:
    """A reproducible random order."""
    return df.orderBy(row_hash(seed, row_id), row_id)


def shuffle_rank(df: DataFrame, seed=42, row_id: str = "id", out: str = "rank") -> DataFrame:
    """Adds the place, from 1, that a row has in the order of ``shuffle_rows``.

    No task sorts all rows: the hash is cut into ``RANK_PARTS`` even ranges, a small table counts the rows of the earlier
    ones, and rows are numbered inside their range. Rows with equal ids get different places in no fixed order.
    """
    numbered = df.withColumn("_hash", row_hash(seed, row_id)).withColumn("_range", F.floor(F.col("_hash") / F.lit(SPACE // RANK_PARTS)))
    before = offsets(numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")), [], "_range", "_n", "_before").drop("_n")
    inside = Window.partitionBy("_range").orderBy("_hash", row_id)
    # At most RANK_PARTS rows of two numbers.
    placed = numbered.withColumn("_rn", F.row_number().over(inside)).join(F.broadcast(before), "_range")
    return placed.withColumn(out, F.col("_rn") + F.col("_before")).drop("_hash", "_range", "_rn", "_before")


def with_row_key(df: DataFrame, cols: Sequence[str], out: str = "id") -> DataFrame:
    """A text id from the columns that identify a row."""
    return df.withColumn(out, F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
