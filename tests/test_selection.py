"""Exact split sizes, distributed selection, restarts, sums of arrays, exact AUC of many models, staged overwrite, report tables."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.functions import ranked, selection, vectors
from churnlab.operators import boost, prepare, report, sampling, segment
from churnlab.plans import flows
from churnlab.sources.io import replace_table


def test_kth_smallest(spark):
    r = random.Random(3)
    values = [r.randrange(1 << 60) for _ in range(300)] + [7] * 50 + [(1 << 60) - 1]
    df = spark.createDataFrame([(v,) for v in values], "h long").repartition(4)
    ranks = [1, 50, 51, 200, len(values)]
    assert selection.kth_smallest(df, "h", ranks) == [sorted(values)[k - 1] for k in ranks]
    with pytest.raises(ValueError):
        selection.kth_smallest(df, "h", [len(values) + 1])


@pytest.mark.parametrize("n", [0, 1, 3, 4, 103])
def test_exact_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "user_id")
    split = sampling.exact_split(df, "user_id")
    assert split.columns == ["user_id", "split"] and split.where("split = 'test'").count() == math.ceil(n / 4) and split.count() == n
    sizes = [r["count"] for r in sampling.exact_folds(df, "user_id", 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sum(sizes) == n and (not sizes or max(sizes) - min(sizes) <= 1) and sizes == sorted(sizes, reverse=True)


def test_repeated_keys_stay_together(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(30)], "user_id long")
    folds = sampling.exact_folds(df, "user_id", 5)
    assert folds.groupBy("user_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_sum_arrays(spark):
    rows = [(k, [float(k * i), 1.0, i / 7]) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(9)
    found = {r.k: r.v for r in vectors.sum_arrays(df, ["k"], "v").collect()}
    for k in range(3):
        np.testing.assert_allclose(found[k], np.sum([v for j, v in rows if j == k], axis=0))


def test_auc_of_many_models(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    scores = [np.round(rng.normal(size=400) + s * y, d) for s, d in ((1, 3), (0.2, 0), (0, 9))]
    df = spark.createDataFrame([(int(y[i]), *(float(s[i]) for s in scores)) for i in range(400)], "y int, a double, b double, c double").repartition(5)
    rows = ranked.entries_of(df, ["a", "b", "c", "y"], lambda c: ((i, c[i], c[3]) for i in range(3)))
    found = ranked.auc_of_entries(rows)
    for i, s in enumerate(scores):
        pos, neg = s[y == 1], s[y == 0]
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert found[i] == (pytest.approx(want, abs=1e-12), len(pos), len(neg))
    one_class = ranked.auc_of_entries(ranked.entries_of(df.where("y = 1"), ["a", "y"], lambda c: [(0, c[0], c[1])]))
    assert one_class[0][0] is None


def test_staged_auc_equals_one_prefix_at_a_time(spark):
    from churnlab.operators.metrics import roc_auc
    data = flows.split_prepared(spark, "/root/testdata/sf0.001").where("split = 'test'").persist()
    found = {r.iteration: r.auc for r in boost.staged_auc(flows.FROZEN, data, "churn_100").collect()}
    for k in (1, 2, 3):
        scored = data.select("churn_100", flows.FROZEN.margin_expr(k).alias("m"))
        assert found[k] == pytest.approx(roc_auc(scored, "m", "churn_100"), abs=1e-12)


def test_restarts_equal_separate_fits(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 2)) + c for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double").repartition(4).persist()
    starts = segment.hashed_starts(df, ["a", "b"], "id", 3, [1, 2, 3])
    assert all(s.shape == (3, 2) for s in starts)
    for start, (centres, cost, n) in zip(starts, segment.kmeans_restarts(df, ["a", "b"], starts, 50), strict=True):
        want = start.copy()
        for step in range(1, 51):
            at = ((x[:, None] - want) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[at == j].mean(axis=0) if (at == j).any() else want[j] for j in range(3)])
            far = np.sqrt(((new - want) ** 2).sum(axis=1)).max()
            want = new
            if far <= 1e-4:
                break
        np.testing.assert_allclose(centres, want, atol=1e-9)
        assert n == step and cost == pytest.approx(((x[:, None] - want) ** 2).sum(axis=2).min(axis=1).sum())
    few = df.limit(2)
    assert [len(s) for s in segment.hashed_starts(few, ["a", "b"], "id", 3, [1])] == [2]
    (centres, cost, n), = segment.kmeans_restarts(df.limit(0), ["a", "b"], [np.zeros((0, 2))])
    assert cost == 0 and n == 0


def test_replace_table_keeps_the_old_one_on_failure(spark, tmp_path):
    path = str(tmp_path / "table")
    assert replace_table(spark.range(10), path) == 10

    def broken(batches):
        for batch in batches:
            yield batch.slice(0, 3)
            raise RuntimeError("halfway")
    with pytest.raises(Exception, match="halfway"):
        replace_table(spark.range(100, 200, 1, 4).mapInArrow(broken, "id long"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))
    assert replace_table(spark.read.parquet(path).where("id > 6"), path) == 3
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [7, 8, 9]
    assert os.listdir(tmp_path) == ["table"]
    assert replace_table(spark.range(4).withColumn("p", F.col("id") % 2), path, partition_by=["p"]) == 4
    assert replace_table(spark.range(0), path) == 0 and spark.read.schema("id long").parquet(path).count() == 0


def test_correlation_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 23)) + np.linspace(0, 1e6, 23)
    x[:, 5] = 3.0
    x[rng.random(x.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(23)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in cols)).repartition(5)
    import pandas as pd
    want = pd.DataFrame(x, columns=cols).corr()
    for per_pass, per_row in ((1 << 23, 1 << 17), (6 * 23 * 7, 6 * 23 * 2)):
        monkeypatch.setattr(prepare, "PASS_DOUBLES", per_pass)
        monkeypatch.setattr(prepare, "BLOCK_DOUBLES", per_row)
        rows = prepare.correlation_matrix(df, cols).collect()
        assert len(rows) == 23 * 23
        for r in rows:
            if "c5" in (r.feature_a, r.feature_b):
                assert r.corr is None
            else:
                assert r.corr == pytest.approx(want.loc[r.feature_a, r.feature_b], abs=1e-9)


def test_density_sums_in_small_steps(spark, monkeypatch):
    rows = [(i, "f", float(i % 3), math.sin(i) * (i % 3)) for i in range(60)]
    long = spark.createDataFrame(rows, "id long, feature string, value double, shap double").repartition(5)
    one = {(r.value, r.i): (r.x, r.density) for r in report.shap_density(long, "f", 20, 30).collect()}
    monkeypatch.setattr(report, "HELD_GRIDS", 0)
    two = {(r.value, r.i): (r.x, r.density) for r in report.shap_density(long, "f", 20, 30).collect()}
    assert one.keys() == two.keys() and len(one) == 61 and one[0.0, 0] == (0.0, None)
    assert all(two[k][1] == pytest.approx(v[1]) for k, v in one.items() if v[1] is not None)


def test_band_and_swarm_of_odd_features(spark):
    rows = [(i, "flat", 0.5, 0.1) for i in range(5)] + [(i, "two", i / 5, 0.3 * i / 5 + 0.1) for i in range(5)] + [(4, "two", 0.5, None)]
    long = spark.createDataFrame(rows, "id long, feature string, value double, shap double")
    band = report.shap_regression_band(long, ["flat", "two", "none"], "id", replicates=30, gridsize=4).collect()
    assert {r.feature for r in band} == {"flat", "two"} and len(band) == 8
    for r in band:
        if r.feature == "flat":
            assert r.fit is None and r.low is None
        else:
            assert r.low <= r.fit + 1e-9 and r.fit == pytest.approx(0.3 * r.x + 0.1) and r.high >= r.fit - 1e-9
    swarm = report.shap_beeswarm(long, "id", 5, 3).collect()
    assert all(sum(r.feature == f for r in swarm) <= 3 for f in ("flat", "two"))
    assert {(r.bin, r.layer, r.offset) for r in swarm if r.feature == "flat"} == {(0, 0, 0), (0, 1, 1), (0, 2, -1)}
    assert report.shap_beeswarm(long.limit(0), "id").count() == 0
