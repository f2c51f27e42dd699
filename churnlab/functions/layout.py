"""Rows laid out for jobs that read them many times.

A table made by shuffles has as many partitions as those shuffles, often far more than its
rows are worth.  One job does not mind; a fit that runs hundreds of them over the same rows
pays for each task every time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

#: Rows for which there is a task.
TASK_ROWS = 20_000


def laid_out(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """All rows of ``df``, persisted in about one partition for each ``rows`` of them (never more than it has); unpersist when done."""
    return df.coalesce(max(1, -(-df.count() // rows))).persist()


def task_count(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Partitions for about as many rows as ``df`` has: one for each ``rows`` of them, and one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


@contextmanager
def stored(df: DataFrame, *by: str) -> Iterator[DataFrame]:
    """The rows of ``df`` as files in the shared checkpoint folder, those of each value of the columns ``by`` apart; they are
    deleted at the end.

    A persisted table still carries every step that made it in each task of each job, which the
    task has to unpack first.  Of a stored one a task only knows its files.
    """
    from ..sources.session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"rows-{uuid.uuid4().hex}")
    try:
        df.write.partitionBy(*by).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
