"""Preparation edge cases on hand-made fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from churnlab.functions.hashing import hash_unit
from churnlab.operators import prepare, report, sampling
from churnlab.sources.session import get_session


def test_flags_mixed(spark):
    df = spark.createDataFrame([(1, "Y"), (2, "N"), (3, ""), (4, None), (5, "y")], "id int, flag string")
    out = {r["id"]: r["f"] for r in prepare.encode_flags(df, {"flag": "f"}).collect()}
    assert out == {1: 1, 2: 0, 3: None, 4: None, 5: None}


def test_dedup_is_deterministic(spark):
    rows = [(1, "2024-01-01", 1.0), (1, "2024-01-02", 2.0), (1, "2024-01-02", 3.0), (2, "2024-01-01", 5.0)]
    df = spark.createDataFrame(rows, "id int, updated string, v double") \
        .withColumn("updated", F.col("updated").cast("timestamp_ntz"))
    out = {r["id"]: r["v"] for r in prepare.dedup(df, "id", ["updated"]).collect()}
    assert out == {1: 3.0, 2: 5.0}


def test_fill_nan_and_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 2.5)], "id int, v double")
    out = {r["id"]: r["v"] for r in prepare.fill_missing(df, -1, ["v"]).collect()}
    assert out == {1: -1.0, 2: -1.0, 3: 2.5}


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(i, 7.0) for i in range(5)] + [(9, None)], "id int, v double")
    out = {r["id"]: r["v"] for r in prepare.standardize(df, ["v"]).collect()}
    assert all(out[i] == 0.0 for i in range(5)) and out[9] is None


def test_one_hot_null_is_all_zero_and_limit(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    out = {r["id"]: (r["c_a"], r["c_b"]) for r in prepare.one_hot(df, ["c"]).collect()}
    assert out == {1: (1, 0), 2: (0, 1), 3: (0, 0)}
    with pytest.raises(ValueError):
        prepare.one_hot(df, ["c"], max_categories=1)


def test_woe_zero_cell_and_ignored_values(spark):
    rows = [(1, 1), (1, 1), (0, 1), (1, 0), (0, 0), (0, 2), (1, None)]
    df = spark.createDataFrame(rows, "label int, x int")
    r = report.woe(df, ["x"], "label").first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (2, 1, 1, 1)
    expected = math.log((2 / 3) / (1 / 2)) + math.log((1 / 3) / (1 / 2))
    assert r["woe"] == pytest.approx(expected)
    zero = report.woe(df.where(F.col("label") == 1), ["x"], "label").first()
    assert zero["woe"] is None


def test_hash_split_is_stable_and_proportional(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = sampling.with_split(df, "k").where(F.col("split") == "test").count()
    assert 4500 < a < 5500
    u = [r[0] for r in df.select(hash_unit("k", "x")).limit(5).collect()]
    assert u == [r[0] for r in df.select(hash_unit("k", "x")).limit(5).collect()]
    assert all(0.0 <= v < 1.0 for v in u)


def test_box_stats_matches_numpy(spark):
    import numpy as np
    vals = [1.0, 2.0, 2.0, 3.0, 4.0, 100.0, 5.0, 6.0]
    df = spark.createDataFrame([(0, v) for v in vals], "g int, x double")
    r = report.box_stats(df, ["g"], "x", rows_per_bucket=2).first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3))
    assert r["outliers"] == 1 and r["whisker_high"] == 6.0


def test_unknown_session_option_rejected():
    with pytest.raises(TypeError):
        get_session(memmory="32G")


def test_nan_is_missing_in_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 5.0), (2, float("nan"), 3.0, 5.0), (3, 3.0, 4.0, 5.0), (4, 4.0, 1.0, 5.0)],
                               "id int, a double, b double, c double")
    z = {r["id"]: r["a"] for r in prepare.standardize(df, ["a"]).collect()}
    assert z[2] is None and abs(z[1] + z[3] + z[4]) < 1e-12
    corr = {(r["feature_a"], r["feature_b"]): r["corr"] for r in prepare.correlation_matrix(df, ["a", "b", "c"]).collect()}
    import numpy as np
    assert abs(corr["a", "b"] - np.corrcoef([1, 3, 4], [2, 4, 1])[0, 1]) < 1e-12
    assert corr["a", "a"] == 1.0 and corr["c", "c"] is None and corr["b", "c"] is None
    whole = {(r["feature_a"], r["feature_b"]): r["corr"] for r in prepare.correlation_matrix(df, ["b", "c"]).collect()}
    assert whole["b", "b"] == 1.0 and whole["c", "c"] is None and whole["b", "c"] is None


def test_dotted_categories_and_given_lists(spark):
    df = spark.createDataFrame([(1, "A.B"), (2, None), (3, "C")], "id int, c string")
    out = prepare.fill_missing(prepare.one_hot(df, ["c"]), -1)
    assert out.columns == ["id", "c_A_B", "c_C"]
    given = prepare.one_hot(df, ["c"], categories={"c": ["C", "D"]}).orderBy("id").collect()
    assert [(r["c_C"], r["c_D"]) for r in given] == [(0, 0), (0, 0), (1, 0)]
    filled = prepare.one_hot(df, ["c"], fill="-1")
    assert "c_-1" in filled.columns
    with pytest.raises(ValueError):
        prepare.one_hot(spark.createDataFrame([("a.b",), ("a_b",)], "c string"), ["c"])
    with pytest.raises(ValueError):
        prepare.one_hot(df, ["c"], max_categories=1)


def test_one_hot_lists_all_columns_in_one_job(spark):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    schema = StructType([StructField("a", StringType()), StructField("b", StringType()), StructField("c", IntegerType())])
    df = spark.createDataFrame([("x", "x", 1), ("y", None, 2), (None, "x", None), ("x", "z", 1)], schema)
    sc = spark.sparkContext
    sc.setJobGroup("one_hot", "")
    out = prepare.one_hot(df, ["a", "b"])
    one = len(sc.statusTracker().getJobIdsForGroup("one_hot"))
    sc.setJobGroup("single", "")
    prepare.one_hot(df, ["a"])
    single = len(sc.statusTracker().getJobIdsForGroup("single"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert out.columns == ["c", "a_x", "a_y", "b_x", "b_z"] and one == single
    assert [tuple(r) for r in out.collect()] == [(1, 1, 0, 1, 0), (2, 0, 1, 0, 0), (None, 0, 0, 1, 0), (1, 1, 0, 0, 1)]
    mixed = prepare.one_hot(df, ["a", "c"])
    assert mixed.columns == ["b", "a_x", "a_y", "c_1", "c_2"] and mixed.where("c_1 = 1").count() == 2
