"""Report and segmentation operators on hand-made fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.operators import report, segment


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = float(i % 4)
        rows.append((i, 0.5, "f", v, float(np.round(rng.normal(0.1 * v, 0.2), 4))))
    return spark.createDataFrame(rows, "id long, base double, feature string, value double, shap double")


def test_histogram_zero_fills_and_counts_everything(long):
    h = report.shap_histogram(long, "f", 20, 0.1).collect()
    by_value = {}
    for r in h:
        by_value.setdefault(r["value"], []).append(r)
    bins = {len(v) for v in by_value.values()}
    assert len(bins) == 1  # every value has the same complete bin range
    assert sum(r["n"] for r in h) == 400
    assert any(r["n"] == 0 for r in h)
    means = {r["value"]: r["mean_shap"] for r in h}
    want = {r["value"]: r["m"] for r in long.groupBy("value").agg(F.avg("shap").alias("m")).collect()}
    assert means == pytest.approx(want)


def test_density_integrates_to_one(long):
    d = report.shap_density(long, "f", 20).collect()
    for v in {r["value"] for r in d}:
        pts = sorted((r["x"], r["density"]) for r in d if r["value"] == v)
        xs, ys = np.array(pts).T
        assert np.trapezoid(ys, xs) == pytest.approx(1.0, abs=0.01)


def test_mean_curve_and_subset(long):
    rows = {r["value"]: r for r in report.shap_mean_curve(long, "f", 2).collect()}
    assert sorted(rows) == [0.0, 1.0, 2.0]
    assert report.shap_subset(long, "f", 3.0).count() == 100


def test_period_gap(spark):
    wide = spark.createDataFrame([("up", 3.0, 1.0), ("down", 1.0, 4.0)], "grp string, m01 double, m02 double")
    out = {r["period"]: r for r in report.period_gap(wide, "grp", "up", "down", ["m01", "m02"]).collect()}
    assert out["m01"]["gap"] == 2.0 and out["m02"]["gap"] == -3.0


def test_explain_cases_orders_by_abs_shap(spark):
    rows = [(1, 0.1, 0.4, 5.0, 1.0, 0.2, -0.3), (2, 0.1, 0.5, 6.0, 2.0, 0.9, 0.1)]
    wide = spark.createDataFrame(rows, "id long, base double, margin double, x_a double, x_b double, "
                                       "shap_a double, shap_b double")
    out = report.explain_cases(wide, F.col("x_a") > 0, "id", ["a", "b"], k=0).collect()
    assert [r["feature"] for r in out] == ["b", "a"] and out[0]["id"] == 1
    second = report.explain_cases(wide, F.col("x_a") > 0, "id", ["a", "b"], k=1).collect()
    assert second[0]["id"] == 2 and second[0]["feature"] == "a"


def test_kmeans_assign_ties_go_to_first_centre(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 2.0)], "id long, z double")
    out = {r["id"]: (r["cls_label"], r["dist2"]) for r in
           segment.kmeans_assign(df, ["z"], [[0.0], [1.0], [3.0]]).collect()}
    assert out[1] == (0, 0.25)  # equidistant from centres 0 and 1
    assert out[2] == (1, 1.0)


def test_best_of_keeps_lowest_cost(spark):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(c, 0.3, size=(40, 2)) for c in ([0, 0], [3, 3], [0, 4])])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "a double, b double").persist()
    model, costs = segment.kmeans_best_of(df, ["a", "b"], k=3, seeds=[1, 2, 3], max_iter=20)
    assert model.summary.trainingCost == pytest.approx(min(c for _, c in costs))


def test_null_groups_survive_any_number_of_buckets(spark):
    rows = [(None if i % 3 == 0 else i % 3, float((i * 37) % 50), i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, x double, y int")
    from churnlab.operators import metrics
    one, many = ({r["g"]: tuple(r) for r in report.box_stats(df, ["g"], "x", rows_per_bucket=n).collect()} for n in (10_000, 10))
    assert set(one) == {None, 1, 2} and one == many
    auc = [{r["g"]: r["auc"] for r in metrics.roc_auc_table(df, "x", "y", by=["g"], rows_per_bucket=n).collect()} for n in (10_000, 10)]
    assert set(auc[0]) == {None, 1, 2} and auc[0] == auc[1]


def test_constant_shap_keeps_its_value_in_the_density(spark):
    long = spark.createDataFrame([(i, "f", float(i % 2), 0.5 if i % 2 else i / 10) for i in range(20)],
                                 "id int, feature string, value double, shap double")
    rows = [r for r in report.shap_density(long, "f", 20).collect() if r["value"] == 1.0]
    assert [(r["i"], r["x"], r["density"]) for r in rows] == [(0, 0.5, None)]


def test_no_training_rows_give_a_null_threshold(spark):
    from churnlab.operators import metrics
    df = spark.createDataFrame([(0.3, 1), (0.6, 0)], "score double, y int")
    assert metrics.best_threshold(df.limit(0), df, "score", "y").first()["threshold"] is None


def test_segment_fits_have_a_task_for_many_rows(spark, monkeypatch):
    from churnlab.plans import flows
    from .conftest import SF_SMALL
    parts, fit = [], segment.kmeans_best_of

    def seen(df, *rest, **options):
        parts.append(df.rdd.getNumPartitions())
        return fit(df, *rest, **options)

    monkeypatch.setattr(flows, "segment_input", lambda s, sf, made=flows.segment_input: made(s, sf).repartition(20))
    monkeypatch.setattr(segment, "kmeans_best_of", seen)
    out = flows.segment_profile_flow(spark, SF_SMALL, k=2, restarts=1, max_iter=2)
    assert parts == [1] and out.count() == 2
