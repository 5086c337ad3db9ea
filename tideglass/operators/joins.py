"""Joins that treat nulls as equal keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(df: DataFrame, other: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Like ``df.join(other, on, how)``, but a null key meets a null key.

    For inner, left and semi or anti joins; the key columns of ``df`` stay.
    """
    keys = [on] if isinstance(on, str) else list(on)
    renamed = other.withColumnsRenamed({k: f"_other_{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other_{i}")) for i, k in enumerate(keys)])
    return df.join(renamed, same, how).drop(*[f"_other_{i}" for i in range(len(keys))])
