"""Deterministic per-key pseudo-random numbers.

``hash_unit(key, salt)`` maps a key to a double in [0, 1) from the first 32
bits of ``md5(key || ':' || salt)``.  It replaces unseeded ``rand()``: the
draw is a pure function of the key, so it is stable across retries, stages
and lost executors, and any SQL engine with ``md5`` reproduces it:

    ('0x' || substr(md5(CAST(k AS VARCHAR) || ':' || salt), 1, 8))::BIGINT / 4294967296.0
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_unit(key: str | Column, salt: str = "") -> Column:
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(k.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def hash_unit_sql(key: str, salt: str = "") -> str:
    """The same draw as a DuckDB expression (used by the oracles)."""
    return (f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT "
            f"/ {TWO_32})")


def hash_60(key: str | Column, salt: str = "") -> Column:
    """The first 60 bits of the same digest, as a whole number."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(f":{salt}"))), 1, 15), 16, 10).cast("bigint")


def hash_60_sql(key: str, salt: str = "") -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 15))::BIGINT"
