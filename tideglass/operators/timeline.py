"""Row frames over long series without one task per series.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole series into one
task, so a source that sends a third of all traffic sets the run time. The
helpers here cut every series into pieces of bounded length first:

* ``row_index`` numbers the rows of a series: row numbers inside time buckets
  plus the row counts of the earlier buckets (a small table).
* ``frame_chunks`` cuts a numbered series into chunks of fixed size and copies
  the few rows a backward frame needs from the chunk before, so that row frames
  can run per chunk. A chunk never holds more than ``chunk + before`` rows.
* ``event_horizon`` finds the events around each row: what earlier and later
  events mean for a time bucket comes from a scan over a table of buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideglass.operators.joins import null_safe_join

DAY = 86_400
CHUNK = 4_096
SERIES = "_series"
BUCKET = "_bucket"
POS = "_pos"
PIECE = "_piece"
HALO = "_halo"


def as_keys(key: str | Sequence[str] | None) -> list[str]:
    if key is None:
        return []
    return [key] if isinstance(key, str) else list(key)


def bucket(ts: Column | str, seconds: int) -> Column:
    """Number of the epoch-aligned bucket a timestamp falls into."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1_000_000))).cast("long")


def offsets(counts: DataFrame, keys: Sequence[str], part: str, value: str, out: str) -> DataFrame:
    """Total of ``value`` over the earlier parts of each series.

    ``counts`` has one row per series and part, so its groups are as long as
    the number of parts, not the number of rows.
    """
    by = list(keys) or [F.lit(0)]
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("long"))


def row_index(
    df: DataFrame,
    key: str | Sequence[str] | None,
    ts: str,
    tie: Sequence[str] = (),
    bucket_seconds: int = DAY,
) -> DataFrame:
    """Adds ``_pos``: 1, 2, 3 … in time order within each series.

    Every row gets a number: rows without a key are one series, rows without a
    time come first. ``tie`` orders rows of the same time. The time bucket bounds the rows one
    task sorts; choose it so that a bucket of one series fits a task.
    """
    keys = as_keys(key)
    parted = df.withColumn(BUCKET, bucket(ts, bucket_seconds))
    counts = parted.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = offsets(counts, keys, BUCKET, "_n", "_before").drop("_n")
    inside = Window.partitionBy(*keys, BUCKET).orderBy(ts, *tie)
    return (
        parted.withColumn("_rn", F.row_number().over(inside))
        .transform(lambda d: null_safe_join(d, before, [*keys, BUCKET]))
        .withColumn(POS, F.col("_rn") + F.col("_before"))
        .drop("_rn", "_before", BUCKET)
    )


def dense_index(df: DataFrame, ts: str, step: int) -> DataFrame:
    """``_pos`` for a series known to hold one row per ``step`` seconds.

    Needs no shuffle: in a gap-filled series the time itself is the position.
    """
    return df.withColumn(POS, bucket(ts, step))


def frame_chunks(df: DataFrame, before: int, chunk: int = CHUNK) -> DataFrame:
    """Adds ``_piece`` and ``_halo``; repeats the last ``before`` rows of a
    chunk at the head of the next one, marked ``_halo``."""
    if before > chunk:
        raise ValueError("a frame cannot be longer than a chunk")
    home = F.floor(F.col(POS) / F.lit(chunk)).cast("long")
    seen_next = F.pmod(F.col(POS), F.lit(chunk)) >= chunk - before
    pieces = F.when(seen_next, F.array(home, home + 1)).otherwise(F.array(home))
    return df.select("*", F.posexplode(pieces).alias(HALO, PIECE)).withColumn(
        HALO, F.col(HALO) == 1
    )


def over_frames(
    df: DataFrame,
    key: str | Sequence[str] | None,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    chunk: int = CHUNK,
    partitions: int | None = None,
) -> DataFrame:
    """Adds columns computed over row frames of a numbered series.

    ``columns`` makes named columns from the window spec, for example
    ``lambda w: {"mean": F.avg("x").over(w.rowsBetween(-5, 0))}``. No frame may
    reach back further than ``before`` rows, or forward at all. ``partitions``
    fixes the number of tasks, for costly Python work on the result; otherwise
    adaptive execution sizes them by bytes.
    """
    spec = Window.partitionBy(*as_keys(key), PIECE).orderBy(POS)
    out = frame_chunks(df, before, chunk)
    if partitions:
        out = out.repartition(partitions, *as_keys(key), PIECE)
    out = out.withColumns(columns(spec))
    return out.filter(~F.col(HALO)).drop(HALO, PIECE)


def index_series(
    df: DataFrame,
    key: str | Sequence[str] | None,
    ts: str,
    step: int | None = None,
    tie: Sequence[str] = (),
    bucket_seconds: int = DAY,
) -> DataFrame:
    """``dense_index`` if the spacing is known, else ``row_index``."""
    if step is not None:
        return dense_index(df, ts, step)
    return row_index(df, key, ts, tie, bucket_seconds)


def split_hot(splits: int, *spread: Column | str) -> Column:
    """A stable salt in [0, splits) that spreads one hot group over tasks."""
    return F.pmod(F.xxhash64(*spread), F.lit(splits)).cast("int")


def event_horizon(
    df: DataFrame,
    events: DataFrame,
    by: str | Sequence[str] | None,
    ts: str,
    horizon: float,
    bucket_seconds: int = 600,
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``_inside`` and ``_gap`` for each row of ``df``.

    ``events`` has ``by`` plus ``start`` and ``end``. ``_inside`` tells whether
    some event covers ``ts`` (both ends included); ``_gap`` is the number of
    seconds to the nearest later start, null beyond ``horizon``.

    No pairs are formed and no event is copied. A table with one row per series
    and time bucket says which buckets hold rows and events; a scan over it
    gives each bucket the latest end of all earlier events and the next start
    of all later ones. Both join the bucket as two more events, and running
    aggregates inside the bucket do the rest, so one shuffle moves the rows
    whatever the length of an event. ``bucket_seconds`` bounds what a task sorts.
    Without keys many rows share a time, so each time is looked up once. With
    keys, ``partitions`` fixes the number of tasks that sort; else Spark chooses.
    """
    keys = as_keys(by)
    if not keys:
        return null_safe_join(df, _horizons(df.select(ts).distinct(), events, keys, ts, horizon, bucket_seconds), ts, "left")
    return _horizons(df, events, keys, ts, horizon, bucket_seconds, partitions)


def _horizons(
    df: DataFrame,
    events: DataFrame,
    keys: list[str],
    ts: str,
    horizon: float,
    bucket_seconds: int,
    partitions: int | None = None,
) -> DataFrame:
    us = 1_000_000
    own = (
        events.filter(F.col("start").isNotNull() & (F.col("end") >= F.col("start")))
        .select(
            *keys,
            bucket("start", bucket_seconds).alias(BUCKET),
            F.unix_micros("start").alias("_t"),
            F.unix_micros("end").alias("_end"),
        )
        .groupBy(*keys, BUCKET, "_t")
        .agg(F.max("_end").alias("_end"))
    )
    rows = df.withColumns({BUCKET: bucket(ts, bucket_seconds), "_t": F.unix_micros(ts)})
    held = own.groupBy(*keys, BUCKET).agg(F.min("_t").alias("_first"), F.max("_end").alias("_last"))
    seen = rows.filter(F.col("_t").isNotNull()).select(*keys, BUCKET).distinct()
    table = held.unionByName(seen, allowMissingColumns=True).groupBy(*keys, BUCKET).agg(
        F.max("_first").alias("_first"), F.max("_last").alias("_last")
    )
    series = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = series.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    later = series.orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carried = table.withColumns({"_before": F.max("_last").over(earlier), "_after": F.min("_first").over(later)})
    # One event that ends as late as any before, set before all rows; one that begins as early as any after.
    edges = carried.select(
        *keys,
        BUCKET,
        F.explode(
            F.array(
                F.struct((F.col(BUCKET) * F.lit(bucket_seconds * us) - 1).alias("_t"), F.col("_before").alias("_end")),
                F.struct(F.col("_after").alias("_t"), F.col("_after").alias("_end")),
            )
        ).alias("_edge"),
    ).select(*keys, BUCKET, "_edge.*").filter(F.col("_end").isNotNull())
    both = (
        rows.withColumn("_row", F.lit(True))
        .unionByName(own, allowMissingColumns=True)
        .unionByName(edges, allowMissingColumns=True)
    )
    if partitions:
        both = both.repartition(partitions, *keys, BUCKET)
    part = Window.partitionBy(*keys, BUCKET)
    # A range frame takes in events that start at the very same time.
    upto = part.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = part.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("_row").isNull(), F.col("_t"))
    gap = (F.col("_next") - F.col("_t")) / F.lit(us)
    return (
        both.withColumns({"_reach": F.max("_end").over(upto), "_next": F.min(start).over(behind)})
        .filter(F.col("_row"))
        .withColumns(
            {
                "_inside": F.coalesce(F.col("_reach") >= F.col("_t"), F.lit(False)),
                "_gap": F.when(gap <= horizon, gap),
            }
        )
        .drop(BUCKET, "_t", "_row", "_end", "_reach", "_next")
    )
