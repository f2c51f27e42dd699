"""Sampling and splitting (R1-R4) on the deterministic key hash.

Membership is a pure function of (key, salt): stable across retries and
executor loss, reproducible by any SQL engine, and computed with a filter or
projection only - no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_60, hash_unit
from ..functions.selection import kth_smallest


def with_split(df: DataFrame, key: str, test: float = 0.25, salt: str = "split",
               col: str = "split") -> DataFrame:
    """Add ``split`` = 'test' for about ``test`` of the keys, else 'train' (R2)."""
    return df.withColumn(col, F.when(hash_unit(key, salt) < test, "test").otherwise("train"))


def train_test_split(df: DataFrame, key: str, test: float = 0.25, salt: str = "split"):
    """Return ``(train, test)``; both are filters over the same input."""
    u = hash_unit(key, salt)
    return df.filter(u >= test), df.filter(u < test)


def assign_folds(df: DataFrame, key: str, k: int = 5, salt: str = "fold",
                 col: str = "fold") -> DataFrame:
    """Integer fold 0..k-1 per key for ``CrossValidator(foldCol=...)``."""
    return df.withColumn(col, F.floor(hash_unit(key, salt) * k).cast("int"))


def with_validation_flag(df: DataFrame, key: str, frac: float = 0.2, salt: str = "valid",
                         col: str = "is_valid") -> DataFrame:
    """Boolean hold-out column for ``validationIndicatorCol``."""
    return df.withColumn(col, hash_unit(key, salt) < frac)


def _parts(df: DataFrame, key: str, salt: str, sizes: list[int], col: str) -> DataFrame:
    """Add the number of the part (from 0) of each row: parts of these sizes in the order of the key's hash."""
    ends = [sum(sizes[:i + 1]) for i in range(len(sizes) - 1)]
    drawn = hash_60(key, salt)
    cuts = kth_smallest(df.select(drawn.alias("h")), "h", [e for e in ends if e > 0]) if sum(sizes) else []
    cuts = [-1] * (len(ends) - len(cuts)) + cuts
    part = sum(((drawn > c).cast("int") for c in cuts), F.lit(0))
    return df.withColumn(col, part)


def exact_split(df: DataFrame, key: str, test: float = 0.25, salt: str = "split", col: str = "split") -> DataFrame:
    """``split`` as ``with_split``, with exactly ceil(``test`` x rows) test rows (R2).

    The test rows are those of the smallest key hashes; the hash at the border is found by
    ``kth_smallest``, so no task orders the rows.  Rows that share a key stay together, so
    repeated keys may make the part larger.  Keys may not be null.
    """
    n = df.count()
    size = min(n, math.ceil(n * test))
    return _parts(df, key, salt, [size, n - size], "_part") \
        .withColumn(col, F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")


def exact_folds(df: DataFrame, key: str, k: int = 5, salt: str = "fold", col: str = "fold") -> DataFrame:
    """Folds 0..k-1 by ascending key hash whose sizes differ by one row at most, the first ones larger."""
    n = df.count()
    return _parts(df, key, salt, [n // k + (i < n % k) for i in range(k)], col)


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """Positives and negatives in one job (A1)."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"),
                 F.count_if(F.col(label) == 0).alias("n")).first()
    return int(row["p"]), int(row["n"])


def keep_probability(pos: int, neg: int, ratio: float = 1.5) -> float:
    return ratio * pos / (neg + 1e-6)


def downsample_negatives(df: DataFrame, label: str, key: str, ratio: float = 1.5,
                         salt: str = "neg") -> DataFrame:
    """Keep all positives and a negative with p = ratio * P / (N + 1e-6).

    A single OR filter replaces the reference's filter + union; p >= 1 keeps
    every row.  Rows whose label is neither 0 nor 1 are dropped.
    """
    pos, neg = class_counts(df, label)
    p = keep_probability(pos, neg, ratio)
    y = F.col(label)
    return df.filter((y == 1) | ((y == 0) & (hash_unit(key, salt) <= F.lit(p))))
