from pyspark.sql import functions as F

from churnlab.sources import fixtures as fx


def test_stores_are_shuffled_once_by_customer(spark):
    orders = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "o_orderkey long, o_custkey long") \
        .selectExpr("*", "timestamp_ntz'2000-05-01' as o_orderdate")
    lines = [(1, 5), (1, 6), (2, 5), (2, None), (3, 6), (3, 11), (4, None)]
    lineitem = spark.createDataFrame([(o, 1, s, 1.0, 10.0, 0.05) for o, s in lines], "l_orderkey long, l_partkey long, l_suppkey long, "
                                     "l_quantity double, l_extendedprice double, l_discount double")
    part = spark.createDataFrame([(1, "PROMO")], "p_partkey long, p_type string")
    supplier = spark.createDataFrame([(5, 1), (6, 2), (6, 3), (6, None)], "s_suppkey long, s_nationkey int")  # a supplier may stand there twice
    out = fx._line_aggregates(orders, lineitem, part, F.broadcast(supplier), fx.boundaries())
    assert {r["user_id"]: (r["distinct_store"], r["distinct_city"]) for r in out.collect()} == {7: (4, 3), 8: (4, 2), 9: (0, 0)}
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if "s_nationkey" in x or "user_id" in x and "l_suppkey" in x]


def test_feature_table_has_no_more_partitions_than_its_rows_are_worth(spark):
    from .conftest import SF_SMALL
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    fx.refresh_feature_table(spark)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert fx.feature_table(spark, SF_SMALL).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        fx.refresh_feature_table(spark)
