"""A key holding a third of all rows: results stay exact, plans stay split."""

import io
import contextlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.operators import metrics, prepare, report


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    keys = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 200, n))
    vals = rng.normal(size=n).round(3)
    labels = rng.integers(0, 2, n)
    rows = [(int(i), int(k), float(v), int(y)) for i, (k, v, y) in enumerate(zip(keys, vals, labels))]
    return spark.createDataFrame(rows, "id long, k long, v double, y int"), keys, vals, labels


def test_dedup_hot_key(skewed):
    df, keys, vals, _ = skewed
    out = {r["k"]: r["v"] for r in prepare.dedup(df, "k", ["v"]).collect()}
    assert out[0] == max(v for k, v in zip(keys, vals) if k == 0)
    assert len(out) == len(set(keys))


def test_box_stats_hot_group(skewed):
    df, keys, vals, _ = skewed
    out = {r["k"]: r for r in report.box_stats(df.where(F.col("k") <= 3), ["k"], "v",
                                                rows_per_bucket=50).collect()}
    hot = vals[keys == 0]
    q1, med, q3 = np.percentile(hot, [25, 50, 75])
    assert (out[0]["q1"], out[0]["median"], out[0]["q3"]) == pytest.approx((q1, med, q3))
    assert out[0]["n"] == len(hot)


def test_group_table_is_broadcast(skewed):
    df, _, _, _ = skewed
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        out = report.box_stats(df, ["k"], "v")
        out.collect()  # AQE chooses by the bytes it has seen
        out.explain()
    assert "BroadcastHashJoin" in plan.getvalue()


def test_auc_by_hot_group(skewed):
    df, keys, vals, labels = skewed
    got = {r["k"]: r["auc"] for r in metrics.roc_auc_table(df.where(F.col("k") == 0), "v", "y",
                                                          by=["k"], rows_per_bucket=40).collect()}
    pos = vals[(keys == 0) & (labels == 1)]
    neg = vals[(keys == 0) & (labels == 0)]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got[0] == pytest.approx(want, abs=1e-12)
