"""Tables written to the shared folder, and columns every operator needs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import ensure_checkpoint_dir

#: Rows of fixed-width columns (at most three longs) that may be broadcast: under 100 MB in memory.
BROADCAST_ROWS = 2_000_000


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage: the files are in the shared folder, so they survive lost
    executors.  Only small columns are stored this way (ids, hashes, counts).
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"llm-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (stored, fixed-width columns) marked for broadcast if its row count proves it small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


UNNAMED = "__row_without_id"


def with_ids(docs: DataFrame, id_col: str, *others: DataFrame) -> DataFrame:
    """``docs`` with an id for every row: rows without one are stored with ids above all of ``docs`` and ``others``.

    If there are any, the column ``UNNAMED`` says which; ``without_made_ids`` takes both back.
    """
    unnamed = docs.where(F.col(id_col).isNull())
    if not unnamed.limit(1).count():
        return docs
    tops = [x.agg(F.max(F.col(id_col).cast("long"))).first()[0] for x in (docs, *others)]
    top = max((x for x in tops if x is not None), default=0)
    rows = stored(unnamed.withColumn(UNNAMED, F.monotonically_increasing_id()))
    return docs.where(F.col(id_col).isNotNull()).withColumn(UNNAMED, F.lit(None).cast("long")).unionByName(rows) \
        .withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(top + 1).cast("long") + F.col(UNNAMED)))


def without_made_ids(named: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``with_ids(docs)`` with the ids of ``docs``."""
    if UNNAMED in named.columns:
        named = named.withColumn(id_col, F.when(F.col(UNNAMED).isNull(), F.col(id_col)).cast(docs.schema[id_col].dataType))
    return named.select(*docs.columns)


def without_rows(docs: DataFrame, id_col: str, rejected: Callable[[DataFrame], DataFrame], *others: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in the column ``doc_id`` of ``rejected(docs)``.

    Every row without an id is a document of its own.
    """
    named = with_ids(docs, id_col, *others)
    bad = stored(rejected(named).select(F.col("doc_id").alias(id_col)).distinct())
    return without_made_ids(named.join(bounded(bad), id_col, "left_anti"), docs, id_col)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
