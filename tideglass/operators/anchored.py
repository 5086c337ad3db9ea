"""Packet-anchored windows as a scan over step functions.

A window opens at a packet and closes at the first packet ``width`` or more later, which opens the next one, so every
start depends on the one before. For a time bucket, the last start a chain of windows reaches there is a rising step
function of the time the chain may enter with. Step functions of neighbouring buckets compose to one of both, and
composition is associative: tables of ``FAN`` buckets are merged in each round until one is left (up), then the true
entry of each bucket is handed back through the same rounds (down). No task ever holds more than ``FAN`` of these short
tables, or the packet times of one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.functions.scalar import tcp_flag
from tideglass.operators.labels import RISK_HORIZONS, label_by_intervals
from tideglass.operators.timeline import as_keys
from tideglass.session import written_table

MICROS = 1_000_000
#: Tables merged by one task in one round.
FAN = 32
#: Stands for null in a column of longs.
NONE = np.iinfo("int64").min


@dataclass
class Steps:
    """A chain that may enter up to ``upto[i]``, but not up to the one before, ends with a window opened at ``last[i]``.

    Entries after ``top`` open nothing here. Entries that no chain from an earlier bucket can have are left out.
    """

    upto: np.ndarray
    last: np.ndarray
    top: int

    def after(self, start: int | None, width: int) -> int:
        """The last start of a chain whose last start before was ``start``; none yet for the first packets."""
        if start is None:
            return int(self.last[0])
        entry = start + width
        return start if entry > self.top else int(self.last[np.searchsorted(self.upto, entry)])


def chain_ends(times: np.ndarray, width: int) -> np.ndarray:
    """For each time: the last window start reached if a window opens there."""
    nxt = np.searchsorted(times, times + width)
    here = np.arange(len(times))
    jump = np.where(nxt < len(times), nxt, here)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return times[jump]
        jump = further


def _reduced(upto: np.ndarray, last: np.ndarray, top: int, reach: int) -> Steps:
    """Without the rows behind the first that takes all entries below ``reach``, and without repeated results."""
    m = min(int(np.searchsorted(upto, reach)), len(upto) - 1) + 1
    keep = np.append(last[1:m] != last[: m - 1], True)
    return Steps(upto[:m][keep], last[:m][keep], top)


def steps_of(times: np.ndarray, low: int, width: int) -> Steps:
    """Of one bucket that begins at ``low``, from its sorted distinct times."""
    return _reduced(times, chain_ends(times, width), int(times[-1]), low + width)


def compose(tables: Sequence[Steps], lows: Sequence[int], width: int) -> Steps:
    """Of neighbouring buckets in time order."""
    done = tables[-1]
    for table, low in zip(tables[-2::-1], lows[-2::-1], strict=True):
        entry = table.last + width
        place = np.minimum(np.searchsorted(done.upto, entry), len(done.upto) - 1)
        last = np.where(entry > done.top, table.last, done.last[place])
        beyond = done.upto > table.top
        done = _reduced(np.append(table.upto, done.upto[beyond]), np.append(last, done.last[beyond]), done.top, low + width)
    return done


def _tables(rows: dict[str, np.ndarray]) -> list[tuple[int, Steps]]:
    """The tables of steps in rows ordered by ``_b`` and ``_upto``."""
    b = rows["_b"]
    cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
    return [(int(b[i]), Steps(rows["_upto"][i:j], rows["_last"][i:j], int(rows["_top"][i]))) for i, j in zip(cuts[:-1], cuts[1:])]


def each_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[dict], dict], schema: T.StructType) -> DataFrame:
    """``run`` on the long columns of each group of ``rows``, in the order of ``order``; its columns beside the keys in ``schema``.

    A task reads its groups as one sorted stream of Arrow batches, so a small group costs no call of Python of its own,
    and only the group that a batch ends in is held. Nulls in long columns are ``NONE``, both ways. Keys are not null.
    """
    added = [f.name for f in schema if f.name not in keys]
    kept = [f.name for f in schema if f.name in keys]
    longs = [c for c in rows.columns if c not in keys]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            columns = {c: table[c].fill_null(NONE).to_numpy() for c in longs}
            parts = [run({c: v[i:j] for c, v in columns.items()}) for i, j in zip(cuts[:-1], cuts[1:])]
            owners = pa.array(np.repeat(cuts[:-1], [len(p[added[0]]) for p in parts]))
            own = [pa.concat_arrays(table[c].take(owners).chunks or [pa.array([], table[c].type)]) for c in kept]
            values = [np.concatenate([p[c] for p in parts]).astype("int64") for c in added]
            arrays = dict(zip([*kept, *added], [*own, *[pa.array(v, mask=v == NONE) for v in values]]))
            return pa.record_batch([arrays[f.name] for f in schema], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            new = np.zeros(table.num_rows - 1, bool)
            for c in keys:
                new |= pc.not_equal(table[c].slice(1), table[c].slice(0, table.num_rows - 1)).to_numpy().astype(bool)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            if len(cuts) > 1:
                yield done(table.slice(0, cuts[-1]), cuts)
            held = table.slice(cuts[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield done(table, [0, table.num_rows])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(cut, schema)


def anchored_windows(
    packets: DataFrame,
    key: str | Sequence[str] | None = None,
    ts: str = "ts",
    width: int = 10,
    bucket_widths: int = 60,
    intervals: DataFrame | None = None,
    horizons: Sequence[tuple[str, float]] = RISK_HORIZONS,
    fan: int = FAN,
) -> DataFrame:
    """Rates, distinct sources and mean packet size of packet-anchored windows.

    ``ts`` is start + ``width``. The window that is still open at the end of a series is not reported. Only IPv4 packets
    count, if the table tells the version; packets without time or key open nothing. A task holds the distinct times of
    one series within ``bucket_widths`` widths, or ``fan`` tables of steps. With ``intervals`` (``start``, ``end``, and
    the keys if there are any) the windows get the risk class ``label`` of their end.
    """
    if "ip_version" in packets.columns:
        packets = packets.filter(F.col("ip_version") == 4)
    keys = as_keys(key)
    step, size = width * MICROS, width * bucket_widths * MICROS
    group = keys or ["_series"]
    base = packets if keys else packets.withColumn("_series", F.lit(0))
    base = base.dropna(subset=[ts, *group]).withColumn("_t", F.unix_micros(ts))
    zero = base.agg(F.min("_t")).first()[0] or 0
    times = base.select(*group, "_t").distinct().withColumn("_b", F.floor((F.col("_t") - F.lit(zero)) / F.lit(size)).cast("long"))
    key_fields = [base.schema[k] for k in group]

    def schema(ddl: str) -> T.StructType:
        return T.StructType(key_fields + T.StructType.fromDDL(ddl).fields)

    steps_schema = schema("_b long, _upto long, _last long, _top long")
    up_schema = schema("_up long, _upto long, _last long, _top long")
    opens_schema = schema("_b long, _open long, _final long")

    def steps_rows(s: Steps) -> dict[str, np.ndarray]:
        return {"_upto": s.upto, "_last": s.last, "_top": np.full(len(s.upto), s.top)}

    def leaves(rows: dict) -> dict:
        return steps_rows(steps_of(rows["_t"], zero + int(rows["_at"][0]) * size, step))

    def merged(level: int):
        def run(rows: dict) -> dict:
            parts = _tables(rows)
            lows = [zero + b * size * fan**level for b, _ in parts]
            return steps_rows(compose([s for _, s in parts], lows, step))

        return run

    def entered(rows: dict) -> dict:
        start = None if rows["_open"][0] == NONE else int(rows["_open"][0])
        found, opens = _tables(rows), []
        for _, s in found:
            opens.append(NONE if start is None else start)
            start = s.after(start, step)
        return {"_b": np.array([b for b, _ in found]), "_open": np.array(opens), "_final": rows["_final"][: len(found)]}

    # Up: each level has one table of steps for ``fan`` tables of the level below.
    parent = F.floor(F.col("_b") / F.lit(fan)).cast("long")
    levels = [written_table(each_group(times.withColumn("_at", F.col("_b")), [*group, "_b"], ["_t"], leaves, steps_schema), "steps")]
    most = levels[0].agg(F.max("_b")).first()[0] or 0
    while most > 0:
        level = len(levels) - 1
        above = each_group(levels[-1].withColumn("_up", parent), [*group, "_up"], ["_b", "_upto"], merged(level), up_schema)
        levels.append(written_table(above.withColumnRenamed("_up", "_b"), "steps"))
        most //= fan
    # Down: a series enters its one table without an open window, and learns its last start from it.
    opens = levels[-1].groupBy(*group, "_b").agg(F.lit(None).cast("long").alias("_open"), F.min_by("_last", "_upto").alias("_final"))
    for below in levels[-2::-1]:
        entry = opens.withColumnRenamed("_b", "_up")
        opens = each_group(below.withColumn("_up", parent).join(entry, [*group, "_up"]), [*group, "_up"], ["_b", "_upto"], entered, opens_schema)

    def walk(rows: dict) -> dict:
        t, opened = rows["_t"], int(rows["_open"][0])
        starts = [] if opened == NONE else [opened]
        at = int(np.searchsorted(t, opened + step)) if starts else 0
        while at < len(t):
            starts.append(int(t[at]))
            at = int(np.searchsorted(t, t[at] + step))
        s = np.array(starts, dtype="int64")
        return {"_t": t, "_start": s[np.searchsorted(s, t, side="right") - 1], "_final": rows["_final"]}

    entries = times.join(opens, [*group, "_b"])
    assigned = each_group(entries, [*group, "_b"], ["_t"], walk, schema("_t long, _start long, _final long")).filter("_start < _final").drop("_final")
    syn = F.coalesce(F.col("is_tcp"), F.lit(False)) & tcp_flag("tcp_flags", "syn")
    counted = base.groupBy(*group, "_t", "src_ip").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(syn).alias("_syn"),
        F.sum(F.col("frame_len").cast("long")).alias("_bytes"),
    )
    windows = (
        counted.join(assigned, [*group, "_t"])
        .groupBy(*group, "_start")
        .agg(
            (F.sum("_n") / F.lit(float(width))).alias("connections_per_sec"),
            (F.sum("_syn") / F.lit(float(width))).alias("syn_rate"),
            F.count_distinct("src_ip").alias("unique_source_ips"),
            (F.sum("_bytes") / F.sum("_n")).alias("avg_packet_size"),
        )
    )
    out = windows.select(
        *keys,
        F.timestamp_micros(F.col("_start") + F.lit(step)).alias("ts"),
        "connections_per_sec", "syn_rate", "unique_source_ips", "avg_packet_size",
    )
    return out if intervals is None else label_by_intervals(out, intervals, "ts", keys, horizons)
