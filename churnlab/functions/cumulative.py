"""Running sums over a total order without a single-task window.

An unpartitioned ``Window.orderBy`` moves every row into one task.  Here the
ordered rows are cut into range buckets (split points from
``approxQuantile``: B numbers on the driver), each bucket gets the total of
all earlier buckets from a B-row table, and the running sum inside a bucket
is a window partitioned by the bucket.  With B = ceil(rows / rows_per_bucket)
every task sees at most about ``rows_per_bucket`` rows.

Callers pass tables that are already aggregated to one row per order value
(for example one row per distinct score), so a value shared by many input
rows is a single row here and cannot skew a bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ROWS_PER_BUCKET = 2_000_000


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used for small derived tables that several passes read (count, split
    points, the windowed pass): the upstream plan runs once, lineage is cut,
    and the files survive lost executors.  The folder is the session's
    ``spark.checkpoint.dir`` (a local one is made only when unset).
    """
    from ..sources.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bucketize(df: DataFrame, order_col: str, rows_per_bucket: int) -> tuple[DataFrame, int]:
    n = df.count()
    buckets = max(1, math.ceil(n / rows_per_bucket))
    if buckets == 1:
        return df.withColumn("_bucket", F.lit(0.0)), 1
    probs = [i / buckets for i in range(1, buckets)]
    splits = sorted(set(df.approxQuantile(order_col, probs, 1.0 / (4 * buckets))))
    splits = [-math.inf] + splits + [math.inf]
    b = Bucketizer(splits=splits, inputCol="_ord", outputCol="_bucket", handleInvalid="keep")
    tagged = b.transform(df.withColumn("_ord", F.col(order_col).cast("double"))).drop("_ord")
    return tagged, len(splits) - 1


def running_sums(df: DataFrame, order_col: str, cols: list[str], by: list[str] | None = None,
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
                 suffix: str = "_before") -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over rows of the same ``by`` group with a
    smaller ``order_col``.

    ``order_col`` must be unique per row within a group (aggregate first).
    Buckets are global ranges of ``order_col``; the offsets table has one row
    per (group, bucket).
    """
    by = list(by or [])
    tagged, buckets = _bucketize(materialize(df), order_col, rows_per_bucket)
    local = Window.partitionBy(*by, "_bucket").orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, -1)
    out = tagged.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(local), F.lit(0)) for c in cols})
    if buckets == 1:
        return out.withColumns({f"{c}{suffix}": F.col(f"_l_{c}") for c in cols}) \
            .drop("_bucket", *[f"_l_{c}" for c in cols])
    totals = tagged.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    prior = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(prior), F.lit(0))
                                              .alias(f"_o_{c}") for c in cols])
    # one row per (group, bucket); a group key may be null
    from .joins import join_groups
    joined = join_groups(out, materialize(offsets), [*by, "_bucket"])
    return joined.withColumns({f"{c}{suffix}": F.col(f"_l_{c}") + F.col(f"_o_{c}") for c in cols}) \
        .drop("_bucket", *[f"_l_{c}" for c in cols], *[f"_o_{c}" for c in cols])
