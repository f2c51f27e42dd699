"""Sums of whole arrays, one row for each task and key.

Spark's ``Summarizer`` adds up vectors in the JVM: each task combines its own rows before
the shuffle, and a reducer holds one vector for a key, however many tasks there were.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_arrays(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, col): the elementwise sum of the array<double> column ``col`` (of one length for a key) over the rows of each key."""
    rows = df.select(*keys, array_to_vector(F.col(col)).alias("_v"))
    return rows.groupBy(*keys).agg(Summarizer.sum(rows["_v"]).alias("_s")).select(*keys, vector_to_array("_s").alias(col))
