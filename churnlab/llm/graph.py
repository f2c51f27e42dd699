"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); the component is its smallest id.

    Hash-to-min with pointer jumping: each round an id takes the smallest label
    among its neighbours and then that label's own label, until nothing changes.
    Minima are combined before the shuffle, so a hub with very many links is one
    row per task there.  Nothing is collected but the count of changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                    .select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b") \
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("up"))
        new = stored(lower.join(up, "low", "left")
                     .select("id", F.least("low", F.coalesce("up", "low")).alias("component"),
                             (F.least("low", F.coalesce("up", "low")) != F.col("component")).alias("changed")))
        labels = new.select("id", "component")
        if not new.where("changed").limit(1).count():
            return labels
