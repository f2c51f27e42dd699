"""Exact AUC, threshold sweep and loss on hand-made fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.functions.cumulative import running_sums
from churnlab.operators import metrics


def pair_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    total = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return total / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def ties(spark):
    rng = np.random.default_rng(11)
    scores = [float(x) for x in rng.integers(0, 12, 300) / 10]
    labels = [int(x) for x in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(list(zip(range(300), labels, scores)), "id long, label int, score double")
    return df, scores, labels


@pytest.mark.parametrize("rows_per_bucket", [2_000_000, 3])
def test_auc_with_ties_matches_pair_count(ties, rows_per_bucket):
    df, scores, labels = ties
    got = metrics.roc_auc_table(df, "score", "label", rows_per_bucket=rows_per_bucket).first()
    assert got["auc"] == pytest.approx(pair_auc(scores, labels), abs=1e-12)


def test_auc_by_group_with_buckets(ties):
    df, scores, labels = ties
    g = df.withColumn("g", (F.col("id") % 3).cast("int"))
    out = {r["g"]: r["auc"] for r in metrics.roc_auc_table(g, "score", "label", by=["g"],
                                                            rows_per_bucket=4).collect()}
    for k in range(3):
        sel = [(s, y) for i, (s, y) in enumerate(zip(scores, labels)) if i % 3 == k]
        assert out[k] == pytest.approx(pair_auc(*zip(*sel)), abs=1e-12)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 1, 0.3), (2, 1, 0.7)], "id long, label int, score double")
    assert metrics.roc_auc(df, "score", "label") is None


def test_running_sums_bucketed_equals_single(spark):
    df = spark.createDataFrame([(float(i), i % 5) for i in range(200)], "o double, v int")
    a = {r["o"]: r["v_before"] for r in running_sums(df, "o", ["v"]).collect()}
    b = {r["o"]: r["v_before"] for r in running_sums(df, "o", ["v"], rows_per_bucket=7).collect()}
    assert a == b
    assert a[10.0] == sum(i % 5 for i in range(10))


def test_threshold_strict_greater(spark):
    rows = [(1, 1, 0.30), (2, 0, 0.30), (3, 1, 0.31), (4, 0, 0.2)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    curve = {r["threshold"]: r for r in metrics.f1_curve(df, "score", "label", [0.30, 0.31]).collect()}
    assert curve[0.30]["tp"] == 1 and curve[0.30]["fp"] == 0
    assert curve[0.31]["tp"] == 0


def test_grid_is_exact_decimals():
    grid = metrics.threshold_grid()
    assert len(grid) == 31 and grid[1] == 0.21 and grid[-1] == 0.5


def test_report_zero_denominators(spark):
    df = spark.createDataFrame([(1, 0, 0.1)], "id long, label int, score double")
    r = metrics.classification_report(df, "score", "label", 0.5).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["accuracy"] == 1.0
