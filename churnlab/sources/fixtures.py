"""Per-customer feature table built from the star schema (FIXTURES.md part C).

The reference consumes finished wide feature tables; here they are derived
from ``orders``, ``lineitem``, ``part``, ``supplier``, ``customer`` and
``events`` so that every downstream operator reads data that grows with the
input tables.

Plan shape: three aggregates grouped by the customer key (orders, line items,
events), each computed with map-side partial aggregation (skew safe: a hot
customer is pre-combined inside every map task), then joined on that key.
The aggregate outputs are hash partitioned by the key already, so the joins
reuse that partitioning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import task_count
from ..functions.numeric import rnd
from .io import read_table

# fixed values: weekday prefixes in weekday() order (0 = Monday)
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
# fixed values: part types of the test tables
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
# fixed values: dayparts by event hour, [start, end] inclusive; other hours are late night
DAYPARTS = [("breakfast", 5, 9), ("lunch", 10, 13), ("afternoon", 14, 16), ("dinner", 17, 20)]

DEFAULT_CUT = "2001-01-01"
CHURN_DAYS = 100
RETURN_DAYS = 30


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def _ts(d: dt.date) -> Column:
    return F.lit(d.isoformat()).cast("timestamp_ntz")


def _add_months(d: dt.date, months: int) -> dt.date:
    m = d.month - 1 + months
    return dt.date(d.year + m // 12, m % 12 + 1, 1)


def boundaries(cut: str = DEFAULT_CUT) -> dict[str, dt.date]:
    c = _d(cut)
    return {
        "cut": c,
        "h1": _add_months(c, -12),
        "h2": _add_months(c, -6),
        "churn_end": c + dt.timedelta(days=CHURN_DAYS),
        "return_end": c + dt.timedelta(days=RETURN_DAYS),
    }


def weekday_column_names() -> list[str]:
    out = []
    for d in DAYS:
        out += [f"{d}_tc", f"{d}_maxta", f"{d}_minta", f"{d}_avgta", f"{d}_sumta", f"{d}_std_ta"]
    return out


def _order_aggregates(orders: DataFrame, b: dict) -> DataFrame:
    date = F.col("o_orderdate")
    price = F.col("o_totalprice")
    before = date < _ts(b["cut"])
    first = (date >= _ts(b["h1"])) & (date < _ts(b["h2"]))
    second = (date >= _ts(b["h2"])) & before
    wd = F.weekday(date)
    aggs = [
        F.count_if(before).alias("tc"),
        rnd(F.sum(F.when(before, price)), 2).alias("ta"),
        (F.count_if(second) - F.count_if(first)).alias("tc_diff"),
        rnd(F.coalesce(F.sum(F.when(second, price)), F.lit(0.0))
                - F.coalesce(F.sum(F.when(first, price)), F.lit(0.0)), 2).alias("ta_diff"),
    ]
    for i, d in enumerate(DAYS):
        on_day = before & (wd == i)
        p = F.when(on_day, price)
        aggs += [
            F.count_if(on_day).alias(f"{d}_tc"),
            F.max(p).alias(f"{d}_maxta"),
            F.min(p).alias(f"{d}_minta"),
            # mean as (sum rounded to cents) / count: one IEEE division, identical in any engine
            F.try_divide(rnd(F.sum(p), 2), F.count(p).cast("double")).alias(f"{d}_avgta"),
            rnd(F.sum(p), 2).alias(f"{d}_sumta"),
            rnd(F.stddev_samp(p), 4).alias(f"{d}_std_ta"),
        ]
    aggs += [
        F.count_if(before & (F.col("o_orderpriority") == "1-URGENT")).alias("_urgent"),
        F.count_if(date >= _ts(b["cut"])).alias("_after_churn"),
        F.count_if((date >= _ts(b["cut"])) & (date < _ts(b["return_end"]))).alias("_after_return"),
    ]
    return (
        orders.filter(date < _ts(b["churn_end"]))
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(*aggs)
        .filter(F.col("tc") > 0)
    )


def _line_aggregates(orders, lineitem, part, supplier, b) -> DataFrame:
    """Line-item features per customer.

    Sums, minima, maxima and the discount's moments in integer cents (exact) go
    straight to the customer, combined in the map tasks first.  Stores and
    cities come from the set of suppliers of each customer (at most as many as there
    are suppliers, combined in the map tasks too), so the wide aggregate is never
    shuffled once per supplier, and no ``Expand`` copies line items per distinct
    aggregate.  The sets lie by customer, so the pairs taken from them are counted
    where they are: they are shuffled once, not by (customer, supplier), then
    (customer, nation), then customer.  The sample standard deviation
    comes from the moments: var = (n S2 - S1^2) / (n (n - 1)) / 100^2.
    """
    ob = orders.filter(F.col("o_orderdate") < _ts(b["cut"])).select("o_orderkey", "o_custkey")
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                         "l_extendedprice", "l_discount")
    placed = li.join(ob, li.l_orderkey == ob.o_orderkey)
    disc = F.col("l_discount")
    cents = F.round(disc * 100).cast("bigint")
    n, c1, c2 = F.count(disc), F.sum(cents), F.sum(cents * cents)
    var_cents = F.try_divide((n * c2 - c1 * c1).cast("double"), (n * (n - 1)).cast("double"))
    sums = [
        F.try_divide(rnd(F.sum(disc), 2), n.cast("double")).alias("avg_discount"),
        F.max(disc).alias("max_discount"),
        F.min(disc).alias("min_discount"),
        rnd(F.sum(disc), 2).alias("sum_discount"),
        rnd(F.sqrt(var_cents) / 100.0, 9).alias("std_discount"),
    ]
    types = []
    for t in P_TYPES:
        is_t = F.col("p_type") == t
        types += [rnd(F.sum(F.when(is_t, F.col("l_quantity")).otherwise(0.0)), 2).alias(f"{t.lower()}_sold"),
                  rnd(F.sum(F.when(is_t, F.col("l_extendedprice")).otherwise(0.0)), 2).alias(f"{t.lower()}_sell_price")]
    per_customer = placed \
        .join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left") \
        .groupBy(F.col("o_custkey").alias("user_id")).agg(*sums, *types)
    stores = placed.groupBy(F.col("o_custkey").alias("user_id")).agg(F.collect_set("l_suppkey").alias("_stores")) \
        .select("user_id", F.explode_outer("_stores").alias("l_suppkey")) \
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left") \
        .groupBy("user_id").agg(F.count("l_suppkey").alias("distinct_store"),
                                F.count_distinct("s_nationkey").alias("distinct_city"))
    out = per_customer.join(stores, "user_id")
    first = [c for c in per_customer.columns if not c.endswith(("_sold", "_sell_price"))]
    return out.select(*first, "distinct_store", "distinct_city", *[c for c in per_customer.columns if c not in first])


def _event_aggregates(events: DataFrame) -> DataFrame:
    hour = F.hour("ts")
    aggs = []
    covered = F.lit(False)
    for name, lo, hi in DAYPARTS:
        in_part = hour.between(lo, hi)
        covered = covered | in_part
        aggs.append(F.count_if(in_part).alias(f"{name}_ev"))
    aggs.append(F.count_if(~covered).alias("latenight_ev"))
    aggs.append(F.max((F.col("event_type") == "purchase").cast("int")).alias("if_purchase_ev"))
    return events.groupBy("user_id").agg(*aggs)


def customer_features(spark: SparkSession, base: str, cut: str = DEFAULT_CUT) -> DataFrame:
    """One row per customer with an order before ``cut``.

    Columns: ``user_id``, ``c_mktsegment``, order features, weekday features,
    line-item features, event dayparts (null for customers without events),
    two Y/N flags (null when fewer than 3 orders) and the labels ``churn_100``
    (no order within 100 days after the cut) and ``re1`` (an order within 30
    days after the cut) as the last two columns.
    """
    b = boundaries(cut)
    orders = read_table(spark, "orders", base)
    o = _order_aggregates(orders, b)
    li = _line_aggregates(orders, read_table(spark, "lineitem", base),
                          read_table(spark, "part", base), read_table(spark, "supplier", base), b)
    ev = _event_aggregates(read_table(spark, "events", base))
    cust = read_table(spark, "customer", base).select(
        F.col("c_custkey").alias("user_id"), "c_mktsegment")
    few = F.col("tc") < 3
    df = (
        o.join(li, "user_id", "left")
        .join(ev, "user_id", "left")
        .join(cust, "user_id", "left")
        .withColumn("his_value_seeker_flag",
                    F.when(few, F.lit(None)).when(F.col("avg_discount") > 0.05, "Y").otherwise("N"))
        .withColumn("his_travel_flag",
                    F.when(few, F.lit(None))
                    .when(F.col("_urgent") > 0.2 * F.col("tc"), "Y").otherwise("N"))
        .withColumn("churn_100", (F.col("_after_churn") == 0).cast("int"))
        .withColumn("re1", (F.col("_after_return") > 0).cast("int"))
    )
    cols = (
        ["user_id", "c_mktsegment", "tc", "ta", "tc_diff", "ta_diff"]
        + weekday_column_names()
        + ["avg_discount", "max_discount", "min_discount", "sum_discount", "std_discount",
           "distinct_store", "distinct_city"]
        + [f"{t.lower()}_{k}" for t in P_TYPES for k in ("sold", "sell_price")]
        + [f"{n}_ev" for n, _, _ in DAYPARTS] + ["latenight_ev", "if_purchase_ev"]
        + ["his_value_seeker_flag", "his_travel_flag", "churn_100", "re1"]
    )
    return df.select(*cols)


_STORE: dict = {}


def feature_table(spark: SparkSession, base: str, cut: str = DEFAULT_CUT) -> DataFrame:
    """``customer_features`` materialised once per session and reused by every report.

    Persisted with MEMORY_AND_DISK (blocks lost with an executor are rebuilt
    from lineage).  This plays the role of the stored feature table the
    reference reads; ``refresh_feature_table`` drops it.  It has at most as many
    partitions as its rows (one per customer) are worth, whatever the shuffles
    had: every report, and a fit some hundred times, pays for each of them.
    """
    from pyspark import StorageLevel
    key = (spark.sparkContext.applicationId, base, cut)
    df = _STORE.get(key)
    if df is None:
        parts = task_count(read_table(spark, "customer", base))
        df = customer_features(spark, base, cut).coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
        _STORE[key] = df
    return df


def refresh_feature_table(spark: SparkSession | None = None) -> None:
    for key in list(_STORE):
        if spark is None or key[0] == spark.sparkContext.applicationId:
            _STORE.pop(key).unpersist()


def numeric_feature_names() -> list[str]:
    """Default model features: every numeric column except id and labels."""
    return (
        ["tc", "ta", "tc_diff", "ta_diff"] + weekday_column_names()
        + ["avg_discount", "max_discount", "min_discount", "sum_discount", "std_discount",
           "distinct_store", "distinct_city"]
        + [f"{t.lower()}_{k}" for t in P_TYPES for k in ("sold", "sell_price")]
        + [f"{n}_ev" for n, _, _ in DAYPARTS] + ["latenight_ev", "if_purchase_ev"]
    )


def monthly_change(spark: SparkSession, base: str, cut: str = DEFAULT_CUT,
                   threshold: float = 200.0) -> DataFrame:
    """Share of customers whose monthly spend rose / fell by more than ``threshold``.

    Months are the 12 calendar months before ``cut``; the change of a month is
    its spend minus the previous month's (a month without orders spends 0).
    Population: customers with an order before ``cut``.  Output is the wide
    two-row shape ``grp`` (``up``/``down``) x ``m01..m12`` in percent.

    One pass over orders grouped by customer (13 conditional sums), one global
    aggregate, no join.
    """
    b = boundaries(cut)
    start = _add_months(b["cut"], -13)
    orders = read_table(spark, "orders", base)
    date = F.col("o_orderdate")
    months = [_add_months(start, i) for i in range(14)]
    spend = [
        F.coalesce(F.sum(F.when((date >= _ts(months[i])) & (date < _ts(months[i + 1])),
                                F.col("o_totalprice"))), F.lit(0.0)).alias(f"_s{i}")
        for i in range(13)
    ]
    per_cust = (
        orders.filter(date < _ts(b["cut"]))
        .groupBy("o_custkey")
        .agg(*spend)
    )
    change = [F.col(f"_s{i}") - F.col(f"_s{i - 1}") for i in range(1, 13)]
    totals = per_cust.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(c > threshold).alias(f"_up{i + 1}") for i, c in enumerate(change)],
        *[F.count_if(c < -threshold).alias(f"_dn{i + 1}") for i, c in enumerate(change)],
    )
    def pct(c):
        return rnd(F.lit(100.0) * F.col(c) / F.col("_n"), 6)

    rows = F.array(
        F.struct(F.lit("up").alias("grp"), *[pct(f"_up{m}").alias(f"m{m:02d}") for m in range(1, 13)]),
        F.struct(F.lit("down").alias("grp"), *[pct(f"_dn{m}").alias(f"m{m:02d}") for m in range(1, 13)]),
    )
    return totals.select(F.inline(rows))
