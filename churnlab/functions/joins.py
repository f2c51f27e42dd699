"""Joining row-level data to a one-row-per-group table.

``per_group`` writes the small side once to the checkpoint folder, so the
passes that share it do not recompute it.  No broadcast is forced: AQE knows the
materialised size in bytes and broadcasts or splits skewed partitions from that.
Group keys may be null, so joins compare them null-safe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cumulative import materialize


def per_group(small: DataFrame) -> DataFrame:
    """The one-row-per-group side of a join, materialised once."""
    return materialize(small)


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, where null equals null; the keys come from ``left``."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys])
    return left.join(other, same, how).drop(*[f"_k_{k}" for k in keys])
