"""Packets to connection records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.functions.scalar import TCP_FLAGS, retransmitted, tcp_flag
from tideglass.schemas import FLOWS

MICROS = 1_000_000


def arrival_gaps(
    packets: DataFrame, uid: str = "uid", ts: str = "ts", levels: Sequence[int] = (1, 3_600), partitions: int | None = None
) -> DataFrame:
    """Mean, maximum and population variance of the time between packets.

    A connection may be long and busy, so its packets are never sorted in one
    piece. Packets of the same microsecond are merged first; gaps are then
    summed within seconds, between the seconds of an hour, and between hours.
    One task sorts at most a million rows of a connection at a time. A span
    keeps its number of gaps, their mean and the sum ``m2`` of squared distances
    from it; spans merge by their means, so no large squares are subtracted from
    each other. The mean of a span's gaps is its length by their number.
    ``partitions`` is the number of tasks, the session's unless given.
    """
    us = F.lit(float(MICROS))
    timed = packets.select(uid, F.unix_micros(ts).alias("lo"))
    if partitions:
        timed = timed.repartition(partitions, uid, "lo")
    rows = timed.groupBy(uid, "lo").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"hi": F.col("lo"), "m2": F.lit(0.0), "top": F.lit(0.0)})

    def mean_gap(length: Column, n: Column) -> Column:
        return F.coalesce(F.try_divide(length / us, n - 1), F.lit(0.0))

    for size in (*levels, None):
        span = F.floor(F.col("lo") / F.lit(size * MICROS)) if size else F.lit(0)
        rows = rows.withColumn("_span", span.cast("long"))
        if partitions:
            rows = rows.repartition(partitions, uid, *(["_span"] if size else []))
        whole = Window.partitionBy(uid, "_span")
        gap = (F.col("lo") - F.lag("hi").over(whole.orderBy("lo"))) / us
        mean = mean_gap(F.max("hi").over(whole) - F.min("lo").over(whole), F.sum("n").over(whole))
        off = mean_gap(F.col("hi") - F.col("lo"), F.col("n")) - F.col("_mean")
        between = F.col("_gap") - F.col("_mean")
        rows = (
            rows.withColumns({"_gap": gap, "_mean": mean})
            .groupBy(uid, "_span")
            .agg(
                F.min("lo").alias("lo"),
                F.max("hi").alias("hi"),
                F.sum("n").alias("n"),
                F.sum(F.col("m2") + (F.col("n") - 1) * off * off + F.coalesce(between * between, F.lit(0.0))).alias("m2"),
                F.max(F.greatest("top", F.coalesce("_gap", F.lit(0.0)))).alias("top"),
            )
        )
    return rows.select(
        uid,
        mean_gap(F.col("hi") - F.col("lo"), F.col("n")).alias("iat_mean"),
        F.col("top").alias("iat_max"),
        F.coalesce(F.try_divide(F.col("m2"), F.col("n") - 1), F.lit(0.0)).alias("iat_var"),
    )


def _packet_facts(packets: DataFrame, partitions: int | None = None) -> DataFrame:
    """What packets tell about a connection; TCP windows as sums ``_win_orig`` and ``_win_resp``.

    With ``partitions`` all packets of a connection pass one of so many tasks, which keeps running aggregates only.
    """
    orig, v4 = F.col("is_orig"), F.col("ip_version") == 4
    tcp = F.coalesce(F.col("is_tcp"), F.lit(False))

    def side(value: Column | str, mine: Column) -> Column:
        return F.when(mine, F.col(value) if isinstance(value, str) else value)

    aggs = [
        F.min("ts").alias("ts"),
        F.max(F.when(orig, F.col("src_ip")).otherwise(F.col("dst_ip"))).alias("src_ip"),
        F.max(F.when(orig, F.col("dst_ip")).otherwise(F.col("src_ip"))).alias("dst_ip"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(float(MICROS))).alias("duration"),
    ]
    for name, mine in (("orig", orig), ("resp", ~orig)):
        aggs += [
            F.count_if(mine).alias(f"{name}_pkts"),
            F.min(side("ttl", mine & v4)).alias(f"min_ttl_{name}"),
            F.max(side("ttl", mine & v4)).alias(f"max_ttl_{name}"),
            F.min(side("ip_len", mine & v4)).alias(f"payload_min_{name}"),
            F.max(side("ip_len", mine & v4)).alias(f"payload_max_{name}"),
            F.sum(F.when(mine, F.when(tcp, F.col("tcp_win")).otherwise(0))).alias(f"_win_{name}"),
        ]
    for flag in TCP_FLAGS:
        aggs.append(F.count_if(tcp & tcp_flag("tcp_flags", flag)).alias(f"flag_{flag}"))
    dealt = packets.repartition(partitions, "uid") if partitions else packets
    facts = dealt.groupBy("uid").agg(*aggs).withColumn("frag_count", F.lit(0))
    return facts.join(arrival_gaps(packets, partitions=partitions), "uid")


def _mean_windows() -> dict[str, Column]:
    return {f"avg_win_{s}": F.try_divide(F.col(f"_win_{s}"), F.col(f"{s}_pkts")) for s in ("orig", "resp")}


def assemble_flows(packets: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per connection from its packets alone.

    Lifetimes and lengths count IPv4 packets only; TCP windows are summed over
    the TCP packets of a side and divided by all packets of that side. Byte
    counts, service and history come from the connection record, see
    :func:`connection_flows`.
    """
    return _packet_facts(packets, partitions).withColumns(_mean_windows()).drop("_win_orig", "_win_resp")


def connection_flows(connections: DataFrame, packets: DataFrame, partitions: int | None = None) -> DataFrame:
    """Full flow records: the connection record joined with what its packets tell.

    ``connections`` has ``uid``, ``ts``, addresses, ports, ``proto``, ``service`` (text, or an array that is written in
    order with commas), ``duration``, bytes and packets of both sides and ``history``. Every connection gives one row
    of the schema ``FLOWS``. Times, addresses and counts are those of the record, and TCP
    windows are divided by its packet counts; a connection without packets has no lifetimes, lengths and windows, and
    zeros for flags and gaps. Packets of no connection are left out. Both sides are hashed by ``uid`` once.
    """
    own = [*FLOWS.fieldNames()[:8], "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "history"]
    facts = _packet_facts(packets, partitions).drop("ts", "src_ip", "dst_ip", "duration", "orig_pkts", "resp_pkts")
    own_rows = connections.select(*own)
    joined = (own_rows.repartition(partitions, "uid") if partitions else own_rows).join(facts, "uid", "left").withColumns(_mean_windows())
    if isinstance(connections.schema["service"].dataType, T.ArrayType):
        joined = joined.withColumn("service", F.nullif(F.array_join(F.array_sort("service"), ","), F.lit("")))
    full = joined.withColumns(
        {
            "service": F.coalesce("service", F.lit("-")),
            "retrans_orig": retransmitted("history", "t"),
            "retrans_resp": retransmitted("history", "T"),
            **{c: F.coalesce(c, F.lit(0)) for c in ("frag_count", *[f"flag_{f}" for f in TCP_FLAGS])},
            **{c: F.coalesce(c, F.lit(0.0)) for c in ("iat_mean", "iat_max", "iat_var")},
        }
    )
    return full.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in FLOWS])
