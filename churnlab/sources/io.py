"""Scans and sinks.

Everything stays distributed: tables are read lazily so Catalyst can push
filters and column pruning into the Parquet scan, and results are written by
the executors.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, name_or_path: str, base: str | None = None) -> DataFrame:
    """Catalog table, a Parquet path, or ``<base>/<name>.parquet``."""
    if base is not None:
        return spark.read.parquet(os.path.join(base, f"{name_or_path}.parquet"))
    if name_or_path.endswith(".parquet") or "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def write_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Overwrite sink (S5): a catalog table by name or a path."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in name:
        writer.save(name)
    else:
        writer.saveAsTable(name)


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its maker of paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> int:
    """Overwrite the table at ``path`` in stages (S5); returns its rows.

    The new table is written beside the old one, read back and compared (rows and columns),
    and only then takes its place by a rename; the old one goes last.  A job that fails before
    leaves the old table as it is, and ``df`` may read from ``path`` itself.  A failure between
    the two renames puts the old table back.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    fresh, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    fs, make = _fs(spark, path)
    seen = Observation()
    try:
        out = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt).mode("error")
        (out.partitionBy(*partition_by) if partition_by else out).save(fresh)
        back = spark.read.format(fmt).load(fresh)
        rows = back.count()
        if rows != seen.get["rows"] or sorted(back.columns) != sorted(df.columns):
            raise ValueError(f"{fresh} is not what was written")
        had = fs.exists(make(path))
        if had and not fs.rename(make(path), make(old)):
            raise OSError(f"cannot move {path}")
        try:
            if not fs.rename(make(fresh), make(path)):
                raise OSError(f"cannot move {fresh}")
        except Exception:
            if had:
                fs.rename(make(old), make(path))
            raise
        if had:
            fs.delete(make(old), True)
        return rows
    finally:
        fs.delete(make(fresh), True)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header row."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV source with an explicit schema, never inferred."""
    return spark.read.option("header", True).schema(schema).csv(path)


def preview(df: DataFrame, order_by: list[str], offset: int = 0, n: int = 20) -> DataFrame:
    """Deterministic slice for display (S6): explicit order, then offset/limit."""
    return df.orderBy(*order_by).offset(offset).limit(n)
