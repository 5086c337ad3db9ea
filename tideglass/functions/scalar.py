"""Cleaning, parsing and flag columns. All native expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tried in order on text with ``/`` between the parts of a date. A month first
# is read only where no day-first reading exists.
DAY_FIRST_FORMATS = (
    "d/M/yyyy[ H:mm[:ss[.SSSSSSSSS]]]",
    "d/M/yyyy h:mm[:ss] a",
    "yyyy/M/d[ H:mm[:ss[.SSSSSSSSS]]]",
    "yyyy/M/d h:mm[:ss] a",
    "M/d/yyyy[ H:mm[:ss[.SSSSSSSSS]]]",
    "M/d/yyyy h:mm[:ss] a",
    "d/M/yy[ H:mm[:ss]]",
    "d MMMM yyyy[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
    "MMMM d yyyy[ H:mm[:ss]]",
    "MMM d yyyy[ H:mm[:ss]]",
)

# --- fixed values: TCP header flag bits --------------------------------------
TCP_FLAGS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Text or number to double; ``-``, unparsable text, NaN and null become 0.

    ``try_cast`` because a plain cast of ``-`` raises under ANSI mode.
    """
    value = _col(c).try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


def to_number(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in cols if c in df.columns})


def finite(c: Column | str) -> Column:
    """Null, NaN and both infinities become 0."""
    c = _col(c)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c.cast("double"))


def clean_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols})


def epoch_ts(c: Column | str) -> Column:
    """Epoch seconds (text or number) to timestamp, null if unparsable."""
    return F.timestamp_seconds(_col(c).try_cast("double"))


def parse_ts_dayfirst(c: Column | str, formats: Iterable[str] = DAY_FIRST_FORMATS) -> Column:
    """First format that fits wins; null if none does.

    Day, month and year may be parted by ``/``, ``-`` or ``.``, and date and
    time by a space or ``T``; names of months are English.
    """
    text = F.regexp_replace(strip(c), r"^(\d{1,4})[-./](\d{1,2})[-./](\d{1,4})", "$1/$2/$3")
    text = F.regexp_replace(F.regexp_replace(text, r"^(\S+)T(?=\d)", "$1 "), r"[\s,]+", " ")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, tabs and newlines included."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def byte_ratio(orig: Column | str = "orig_bytes", resp: Column | str = "resp_bytes") -> Column:
    return _col(orig) / (_col(resp) + F.lit(1e-9))


def attack_flag(label: Column | str, benign: Iterable[str] = ("BENIGN", "NORMAL")) -> Column:
    """1 for every label that is not benign; a missing label counts as an attack."""
    known = F.upper(_col(label)).isin(*benign)
    return F.when(known, F.lit(0)).otherwise(F.lit(1))


def syn_state(state: Column | str, states: Iterable[str] = ("REQ", "CON", "INT")) -> Column:
    """Connection states that stand for a connection attempt."""
    return F.coalesce(F.upper(_col(state)).isin(*states), F.lit(False)).cast("int")


def tcp_flag(flags: Column | str, name: str) -> Column:
    return F.coalesce(_col(flags).bitwiseAND(F.lit(TCP_FLAGS[name])) != 0, F.lit(False))


def retransmitted(history: Column | str, letter: str) -> Column:
    """1 if the connection history holds the letter (case matters)."""
    return F.coalesce(_col(history).contains(letter), F.lit(False)).cast("int")


def service_list(service: Column | str) -> Column:
    """Aggregate: the distinct services as one sorted text, ``-`` if none."""
    joined = F.array_join(F.array_sort(F.collect_set(_col(service))), ",")
    return F.when(joined == "", F.lit("-")).otherwise(joined)


def derive_flow_features(df: DataFrame) -> DataFrame:
    """Packet totals, mean packet size and packet rate of a positional flow row.

    A flow without packets has mean size 0, and a zero duration counts as 0.1 ms.
    """
    spkts, dpkts, sbytes, dbytes, dur = (
        number(c) for c in ("Spkts", "Dpkts", "sbytes", "dbytes", "dur")
    )
    packets = spkts + dpkts
    return df.withColumns(
        {
            "total_packets": packets,
            "total_bytes": sbytes + dbytes,
            "avg_packet_size": F.coalesce(F.try_divide(sbytes + dbytes, packets), F.lit(0.0)),
            "flow_packets_s": packets / F.when(dur == 0, F.lit(1e-4)).otherwise(dur),
            "syn_equivalent": syn_state("state"),
        }
    )


def conform(
    df: DataFrame,
    features: Iterable[str],
    keep: Iterable[str] = (),
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """``keep`` plus ``features`` in that order; absent features become 0.0."""
    df = df.withColumnsRenamed(dict(renames or {}))
    have = set(df.columns)
    cols = [F.col(c) for c in keep]
    cols += [
        F.col(c).cast("double").alias(c) if c in have else F.lit(0.0).alias(c) for c in features
    ]
    return df.select(*cols)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop by name, whatever the case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def lookup(c: Column | str, table: Mapping, default=None) -> Column:
    """Literal dictionary lookup for small fixed tables."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[_col(c)]
    return found if default is None else F.coalesce(found, F.lit(default))


def class_name(c: Column | str, names: Mapping[int, str]) -> Column:
    return lookup(c, names)


def time_text(ts: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_col(ts), pattern)
