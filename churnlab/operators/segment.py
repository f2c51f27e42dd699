"""Customer segmentation.

Training is Spark ML ``KMeans`` (k-means|| initialisation, distributed Lloyd
iterations: centres broadcast, partial sums reduced per iteration).  Best of
n restarts uses explicit distinct seeds and keeps the *lowest* cost.
Assignment to given centres is a JVM-side expression, no model object needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sum_arrays


def _assembled(df: DataFrame, cols: list[str], out: str = "_features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def kmeans_fit(df: DataFrame, cols: list[str], k: int, seed: int, max_iter: int = 100,
               tol: float = 1e-4):
    """One k-means fit; returns ``(model, training_cost)``."""
    km = KMeans(featuresCol="_features", predictionCol="cls_label", k=k, maxIter=max_iter,
                seed=seed, tol=tol)
    model = km.fit(_assembled(df, cols))
    return model, float(model.summary.trainingCost)


def kmeans_best_of(df: DataFrame, cols: list[str], k: int, seeds: list[int],
                   max_iter: int = 100, parallelism: int | None = None):
    """Fit once per seed and keep the lowest within-cluster cost (M4).

    The fits are independent Spark jobs submitted from a thread pool, so they
    share the executors instead of queueing.  Returns ``(best_model,
    [(seed, cost), ...])`` with ties going to the earlier seed.  Persist
    ``df`` first: every fit rescans it.
    """
    from concurrent.futures import ThreadPoolExecutor
    workers = max(1, min(len(seeds), parallelism or len(seeds)))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        fits = list(pool.map(lambda s: kmeans_fit(df, cols, k, s, max_iter), seeds))
    costs = [(s, cost) for s, (_, cost) in zip(seeds, fits)]
    best = min(range(len(fits)), key=lambda i: (fits[i][1], i))
    return fits[best][0], costs


def hashed_starts(df: DataFrame, cols: list[str], key: str, k: int, seeds: list[int]) -> list[np.ndarray]:
    """For each seed, the ``k`` distinct points of the smallest key hashes as first centres (fewer if there are no more)."""
    out = []
    for seed in seeds:
        point = F.array(*[F.col(c).cast("double") for c in cols])
        first = df.groupBy(point.alias("p")).agg(F.min(F.xxhash64(key, F.lit(seed))).alias("h"))
        out.append(np.array([r["p"] for r in first.orderBy("h", "p").limit(k).collect()]).reshape(-1, len(cols)))
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centre of each row, and its squared distance."""
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def kmeans_restarts(df: DataFrame, cols: list[str], starts: list[np.ndarray], max_iter: int = 100,
                    tol: float = 1e-4) -> list[tuple[np.ndarray, float, int]]:
    """All restarts of k-means in one pass per iteration (M4): ``(centres, cost, iterations)`` of each start.

    A task assigns its rows to the centres of every restart that still moves and adds up
    (restart, centre) sums; Spark adds those up as whole arrays.  A restart has settled when no
    centre moves by more than ``tol``; a centre without rows stays.  The cost is that of the
    returned centres.  Persist ``df`` first.
    """
    sc = df.sparkSession.sparkContext
    rows = df.select(*[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    centres = [np.array(s, dtype=float) for s in starts]
    iterations, cost, live = [0] * len(starts), [0.0] * len(starts), [i for i, s in enumerate(starts) if len(s)]

    def sums(which: list[int]) -> dict[int, np.ndarray]:
        shared = sc.broadcast({i: centres[i] for i in which})

        def run(batches):
            total = {i: np.zeros((len(c), len(cols) + 2)) for i, c in shared.value.items()}
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                for i, c in shared.value.items():
                    at, d = _nearest(x, c)
                    np.add.at(total[i], at, np.column_stack((x, np.ones(len(x)), d)))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))],
                                             names=["restart", "sums"])

        found = sum_arrays(rows.mapInArrow(run, "restart int, sums array<double>"), ["restart"], "sums").collect()
        shared.unpersist()
        return {r["restart"]: np.array(r["sums"]).reshape(-1, len(cols) + 2) for r in found}

    for _ in range(max_iter):
        if not live:
            break
        moved = []
        for i, total in sorted(sums(live).items()):
            n = total[:, -2:-1]
            new = np.where(n > 0, total[:, :-2] / np.maximum(n, 1), centres[i])
            far = np.sqrt(((new - centres[i]) ** 2).sum(axis=1)).max()
            centres[i], iterations[i] = new, iterations[i] + 1
            if far > tol:
                moved.append(i)
        live = moved
    for i, total in sums([i for i, c in enumerate(centres) if len(c)]).items():
        cost[i] = float(total[:, -1].sum())
    return list(zip(centres, cost, iterations, strict=True))


def assign(model, df: DataFrame, cols: list[str]) -> DataFrame:
    """Cluster label per row from a fitted model (M5)."""
    out = model.transform(_assembled(df, cols))
    return out.drop("_features").withColumn("cls_label", F.col("cls_label").cast("int"))


def squared_distances(cols: list[str], centers: list[list[float]]) -> list[Column]:
    return [sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(cols, center)), F.lit(0.0))
            for center in centers]


def kmeans_assign(df: DataFrame, cols: list[str], centers: list[list[float]]) -> DataFrame:
    """Nearest of the given centres (first on ties) and its squared distance."""
    d = F.array(*squared_distances(cols, centers))
    return (df.withColumn("_d", d)
            .withColumn("dist2", F.array_min("_d"))
            .withColumn("cls_label", (F.array_position("_d", F.col("dist2")) - 1).cast("int"))
            .drop("_d"))


def kmeans_cost(df: DataFrame, cols: list[str], centers: list[list[float]]) -> DataFrame:
    """Within-cluster sum of squared distances for given centres."""
    return kmeans_assign(df, cols, centers).agg(F.sum("dist2").alias("cost"),
                                                F.count(F.lit(1)).alias("n"))


def segment_profile(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Mean of each feature and size per cluster (A2), aliased ``avg_<col>``."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("size"),
                              *[F.avg(c).alias(f"avg_{c}") for c in cols])
