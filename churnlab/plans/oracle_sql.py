"""DuckDB SQL oracles for the contract queries.

Each builder returns an ANSI SQL string over the pre-registered views.  They
are written independently of the Spark code paths (different formulation
where it matters: closed-form Shapley values by subset enumeration, rank
based AUC, explicit CASE trees) so that agreement is evidence of
correctness.
"""

from __future__ import annotations

from ..sources import fixtures as fx


def _ts(d) -> str:
    return f"TIMESTAMP '{d.isoformat()} 00:00:00'"


def customer_features_sql(cut: str = fx.DEFAULT_CUT) -> str:
    b = fx.boundaries(cut)
    cut_ts, h1, h2 = _ts(b["cut"]), _ts(b["h1"]), _ts(b["h2"])
    before = f"o_orderdate < {cut_ts}"
    first = f"(o_orderdate >= {h1} AND o_orderdate < {h2})"
    second = f"(o_orderdate >= {h2} AND {before})"
    day_cols = []
    for i, d in enumerate(fx.DAYS):
        on = f"({before} AND isodow(o_orderdate) - 1 = {i})"
        p = f"CASE WHEN {on} THEN o_totalprice END"
        day_cols += [
            f"CAST(count_if({on}) AS BIGINT) AS {d}_tc",
            f"max({p}) AS {d}_maxta",
            f"min({p}) AS {d}_minta",
            f"round(sum({p}), 2) / CAST(count({p}) AS DOUBLE) AS {d}_avgta",
            f"round(sum({p}), 2) AS {d}_sumta",
            f"round(stddev_samp({p}), 4) AS {d}_std_ta",
        ]
    type_cols = []
    for t in fx.P_TYPES:
        type_cols += [
            f"round(sum(CASE WHEN p_type = '{t}' THEN l_quantity ELSE 0.0 END), 2) AS {t.lower()}_sold",
            f"round(sum(CASE WHEN p_type = '{t}' THEN l_extendedprice ELSE 0.0 END), 2) "
            f"AS {t.lower()}_sell_price",
        ]
    ev_cols, covered = [], []
    for name, lo, hi in fx.DAYPARTS:
        cond = f"hour(ts) BETWEEN {lo} AND {hi}"
        covered.append(cond)
        ev_cols.append(f"CAST(count_if({cond}) AS BIGINT) AS {name}_ev")
    ev_cols.append(f"CAST(count_if(NOT ({' OR '.join(covered)})) AS BIGINT) AS latenight_ev")
    ev_cols.append("max(CAST(event_type = 'purchase' AS INTEGER)) AS if_purchase_ev")
    cols = ", ".join(fx.weekday_column_names())
    tcols = ", ".join(f"{t.lower()}_{k}" for t in fx.P_TYPES for k in ("sold", "sell_price"))
    ecols = ", ".join([f"{n}_ev" for n, _, _ in fx.DAYPARTS] + ["latenight_ev", "if_purchase_ev"])
    return f"""
WITH o AS (
  SELECT o_custkey AS user_id,
    CAST(count_if({before}) AS BIGINT) AS tc,
    round(sum(CASE WHEN {before} THEN o_totalprice END), 2) AS ta,
    CAST(count_if({second}) - count_if({first}) AS BIGINT) AS tc_diff,
    round(coalesce(sum(CASE WHEN {second} THEN o_totalprice END), 0.0)
          - coalesce(sum(CASE WHEN {first} THEN o_totalprice END), 0.0), 2) AS ta_diff,
    {", ".join(day_cols)},
    count_if({before} AND o_orderpriority = '1-URGENT') AS urgent,
    count_if(o_orderdate >= {cut_ts}) AS after_churn,
    count_if(o_orderdate >= {cut_ts} AND o_orderdate < {_ts(b["return_end"])}) AS after_return
  FROM orders
  WHERE o_orderdate < {_ts(b["churn_end"])}
  GROUP BY o_custkey
  HAVING count_if({before}) > 0
), li AS (
  SELECT o.o_custkey AS user_id,
    round(sum(l_discount), 2) / CAST(count(l_discount) AS DOUBLE) AS avg_discount,
    max(l_discount) AS max_discount,
    min(l_discount) AS min_discount,
    round(sum(l_discount), 2) AS sum_discount,
    round(stddev_samp(l_discount), 9) AS std_discount,
    CAST(count(DISTINCT l_suppkey) AS BIGINT) AS distinct_store,
    CAST(count(DISTINCT s_nationkey) AS BIGINT) AS distinct_city,
    {", ".join(type_cols)}
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE o.o_orderdate < {cut_ts}
  GROUP BY o.o_custkey
), ev AS (
  SELECT user_id, {", ".join(ev_cols)} FROM events GROUP BY user_id
)
SELECT o.user_id, c.c_mktsegment, o.tc, o.ta, o.tc_diff, o.ta_diff, {cols},
  li.avg_discount, li.max_discount, li.min_discount, li.sum_discount, li.std_discount,
  li.distinct_store, li.distinct_city, {tcols}, {ecols},
  CASE WHEN o.tc < 3 THEN NULL WHEN li.avg_discount > 0.05 THEN 'Y' ELSE 'N' END
    AS his_value_seeker_flag,
  CASE WHEN o.tc < 3 THEN NULL WHEN o.urgent > 0.2 * o.tc THEN 'Y' ELSE 'N' END AS his_travel_flag,
  CAST(o.after_churn = 0 AS INTEGER) AS churn_100,
  CAST(o.after_return > 0 AS INTEGER) AS re1
FROM o
LEFT JOIN li ON o.user_id = li.user_id
LEFT JOIN ev ON o.user_id = ev.user_id
LEFT JOIN customer c ON o.user_id = c.c_custkey
"""


def monthly_change_sql(cut: str = fx.DEFAULT_CUT, threshold: float = 200.0) -> str:
    b = fx.boundaries(cut)
    start = fx._add_months(b["cut"], -13)
    months = [fx._add_months(start, i) for i in range(14)]
    spend = ", ".join(
        f"coalesce(sum(CASE WHEN o_orderdate >= {_ts(months[i])} AND o_orderdate < "
        f"{_ts(months[i + 1])} THEN o_totalprice END), 0.0) AS s{i}"
        for i in range(13)
    )
    up = ", ".join(
        f"round(100.0 * count_if(s{m} - s{m - 1} > {threshold}) / count(*), 6) AS m{m:02d}"
        for m in range(1, 13))
    down = ", ".join(
        f"round(100.0 * count_if(s{m} - s{m - 1} < -{threshold}) / count(*), 6) AS m{m:02d}"
        for m in range(1, 13))
    return f"""
WITH pc AS (
  SELECT o_custkey, {spend} FROM orders WHERE o_orderdate < {_ts(b["cut"])} GROUP BY o_custkey
)
SELECT 'up' AS grp, {up} FROM pc
UNION ALL
SELECT 'down' AS grp, {down} FROM pc
"""


def with_cf(body: str) -> str:
    """Wrap a query over the ``cf`` (customer features) CTE."""
    return f"WITH cf AS ({customer_features_sql()})\n{body}"


def _numeric_cf_columns() -> list[tuple[str, str]]:
    """(name, kind) of the numeric customer-feature columns; kind in double/bigint/int."""
    ints = {"if_purchase_ev", "churn_100", "re1"}
    out = [("user_id", "bigint")]
    for c in fx.numeric_feature_names():
        if c in ints:
            out.append((c, "int"))
        elif c in ("tc", "tc_diff", "distinct_store", "distinct_city") or c.endswith("_tc") \
                or c.endswith("_ev"):
            out.append((c, "bigint"))
        else:
            out.append((c, "double"))
    return out + [("churn_100", "int"), ("re1", "int")]


def encode_flags_sql() -> str:
    return with_cf("""
SELECT user_id,
  CASE WHEN his_travel_flag = 'Y' THEN 1 WHEN his_travel_flag = 'N' THEN 0 END AS travel_flag,
  CASE WHEN his_value_seeker_flag = 'Y' THEN 1 WHEN his_value_seeker_flag = 'N' THEN 0 END
    AS value_seeker_flag
FROM cf""")


def fill_missing_sql() -> str:
    cols = []
    for c, kind in _numeric_cf_columns():
        if kind == "double":
            cols.append(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN -1.0 ELSE {c} END AS {c}")
        else:
            cols.append(f"coalesce({c}, -1) AS {c}")
    return with_cf(f"SELECT {', '.join(cols)}, c_mktsegment FROM cf")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def one_hot_sql() -> str:
    cols = [f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}" for s in SEGMENTS]
    for f in ("his_travel_flag", "his_value_seeker_flag"):
        for v in ("N", "Y"):
            cols.append(f"CASE WHEN {f} = '{v}' THEN 1 ELSE 0 END AS {f}_{v}")
    return with_cf(f"SELECT user_id, {', '.join(cols)} FROM cf")


def split_xy_sql() -> str:
    feats = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ["tc", "ta", "tc_diff", "ta_diff",
                                                               "distinct_store", "avg_discount"])
    return with_cf(f"SELECT user_id, {feats}, CAST(churn_100 AS BIGINT) AS churn_100 FROM cf")


def dedup_orders_sql() -> str:
    return """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST,
    o_orderkey DESC NULLS LAST, o_orderstatus DESC NULLS LAST, o_totalprice DESC NULLS LAST,
    o_orderpriority DESC NULLS LAST) AS rn
  FROM orders) t
WHERE rn = 1"""


def split_sql() -> str:
    from ..functions.hashing import hash_unit_sql
    return with_cf(f"""
SELECT user_id, churn_100,
  CASE WHEN {hash_unit_sql('user_id', 'split')} < 0.25 THEN 'test' ELSE 'train' END AS split
FROM cf""")


def folds_sql() -> str:
    from ..functions.hashing import hash_unit_sql
    return with_cf(f"""
SELECT user_id, churn_100, CAST(floor({hash_unit_sql('user_id', 'fold')} * 5) AS INTEGER) AS fold
FROM cf""")


def downsample_sql() -> str:
    from ..functions.hashing import hash_unit_sql
    return with_cf(f"""
, cnt AS (SELECT count_if(re1 = 1) AS p, count_if(re1 = 0) AS n FROM cf)
SELECT user_id, re1 FROM cf, cnt
WHERE re1 = 1 OR (re1 = 0 AND {hash_unit_sql('user_id', 'neg')} <= 1.5 * p / (n + 1e-6))""")


STD_COLS = ["tc", "ta", "tc_diff", "ta_diff", "distinct_store", "avg_discount", "mon_std_ta"]


def standardize_sql(ddof: int) -> str:
    fn = "stddev_pop" if ddof == 0 else "stddev_samp"
    cols = ", ".join(
        f"round(CASE WHEN {fn}({c}) OVER () = 0 THEN CASE WHEN {c} IS NOT NULL THEN 0.0 END "
        f"ELSE ({c} - avg({c}) OVER ()) / {fn}({c}) OVER () END, 6) AS {c}" for c in STD_COLS)
    return with_cf(f"SELECT user_id, {cols} FROM cf")


CORR_COLS = ["tc", "ta", "tc_diff", "ta_diff", "distinct_store", "distinct_city", "avg_discount",
             "economy_sold", "mon_avgta", "breakfast_ev"]


def correlation_sql() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            v = f"CASE WHEN count({a}) > 1 AND min({a}) <> max({a}) THEN 1.0 END" if a == b else f"corr({a}, {b})"
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({v}, 6) AS corr FROM cf")
    return with_cf("\nUNION ALL\n".join(parts))


# ------------------------------------------------------------------ prepared + frozen model
def _f(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _fill(c: str, kind: str) -> str:
    if kind == "double":
        return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN -1.0 ELSE {c} END"
    return f"coalesce({c}, -1)"


def prep_cte() -> str:
    """``cf`` and ``prep`` CTEs: filled features, one-hot columns, hash split."""
    from ..functions.hashing import hash_unit_sql
    kinds = dict(_numeric_cf_columns())
    feats = [f"{_fill(c, k)} AS {c}" for c, k in kinds.items() if c != "user_id"]
    onehot = [f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}" for s in SEGMENTS]
    for f in ("his_travel_flag", "his_value_seeker_flag"):
        for v in ("N", "Y"):
            onehot.append(f"CASE WHEN {f} = '{v}' THEN 1 ELSE 0 END AS {f}_{v}")
    return (f"WITH cf AS ({customer_features_sql()}),\n"
            f"prep AS (SELECT user_id, {', '.join(feats)}, {', '.join(onehot)},\n"
            f"  CASE WHEN {hash_unit_sql('user_id', 'split')} < 0.25 THEN 'test' ELSE 'train' END"
            f" AS split FROM cf)\n")


def _tree_sql(ens, t: int, known=None, cov=None) -> str:
    """CASE tree; features outside ``known`` are averaged by cover (cov CTE columns)."""
    tree = ens.trees[t]

    def node(n: int) -> str:
        if tree.is_leaf(n):
            return _f(tree.value[n])
        f = ens.features[tree.feature[n]]
        l, r = tree.left[n], tree.right[n]
        if known is None or f in known:
            return f"(CASE WHEN {f} <= {_f(tree.threshold[n])} THEN {node(l)} ELSE {node(r)} END)"
        return (f"(CASE WHEN cov.c_{t}_{l} + cov.c_{t}_{r} = 0 THEN 0.5 * ({node(l)} + {node(r)}) "
                f"ELSE (cov.c_{t}_{l} * {node(l)} + cov.c_{t}_{r} * {node(r)}) / "
                f"(cov.c_{t}_{l} + cov.c_{t}_{r}) END)")

    return node(0)


def margin_sql(ens, n_trees: int | None = None) -> str:
    k = len(ens.trees) if n_trees is None else n_trees
    expr = _f(ens.base)
    for t in range(k):
        expr = f"({expr} + {_tree_sql(ens, t)})"
    return expr


def _conds_sql(ens, t: int) -> dict[int, str]:
    tree = ens.trees[t]
    out = {0: "TRUE"}
    stack = [0]
    while stack:
        n = stack.pop()
        if tree.is_leaf(n):
            continue
        f, thr = ens.features[tree.feature[n]], _f(tree.threshold[n])
        out[tree.left[n]] = f"{out[n]} AND {f} <= {thr}"
        out[tree.right[n]] = f"{out[n]} AND {f} > {thr}"
        stack += [tree.left[n], tree.right[n]]
    return out


def cover_cte(ens) -> str:
    cols = []
    for t in range(len(ens.trees)):
        for n, cond in _conds_sql(ens, t).items():
            cols.append(f"count_if({cond}) AS c_{t}_{n}")
    return f"cov AS (SELECT {', '.join(cols)} FROM prep WHERE split = 'train')"


def shap_exprs(ens) -> tuple[str, dict[str, str]]:
    """Base value and per-feature Shapley value by subset enumeration over each tree."""
    from itertools import combinations
    from math import factorial
    base = _f(ens.base)
    phis: dict[str, list[str]] = {f: [] for f in ens.features}
    for t, tree in enumerate(ens.trees):
        used = sorted({ens.features[tree.feature[n]] for n in tree.nodes() if not tree.is_leaf(n)})
        m = len(used)
        base = f"({base} + {_tree_sql(ens, t, known=set(), cov=True)})"
        for j in used:
            others = [u for u in used if u != j]
            terms = []
            for s in range(m):
                w = factorial(s) * factorial(m - 1 - s) / factorial(m)
                for sub in combinations(others, s):
                    with_j = _tree_sql(ens, t, known=set(sub) | {j})
                    without = _tree_sql(ens, t, known=set(sub))
                    terms.append(f"{_f(w)} * ({with_j} - {without})")
            phis[j].append("(" + " + ".join(terms) + ")")
    return base, {f: (" + ".join(v) if v else "0.0") for f, v in phis.items()}


def frozen_score_sql() -> str:
    from .flows import FROZEN
    return prep_cte() + f"""
SELECT user_id, round(1.0 / (1.0 + exp(-{margin_sql(FROZEN)})), 6) AS score,
  CAST(1.0 / (1.0 + exp(-{margin_sql(FROZEN)})) > 0.5 AS INTEGER) AS prediction
FROM prep"""


def scored_cte() -> str:
    from .flows import FROZEN
    from ..functions.hashing import hash_unit_sql
    return prep_cte() + f""", scored AS (
  SELECT user_id, churn_100, re1, split,
    CAST(floor({hash_unit_sql('user_id', 'fold')} * 5) AS INTEGER) AS fold,
    1.0 / (1.0 + exp(-{margin_sql(FROZEN)})) AS score
  FROM prep)
"""


def _rank_auc(src: str, s: str, y: str, by: str | None = None) -> str:
    """Rank-sum (Mann-Whitney) AUC with midranks for ties - a different formulation."""
    part = f"PARTITION BY {by}, {s}" if by else f"PARTITION BY {s}"
    order = f"PARTITION BY {by} ORDER BY {s}" if by else f"ORDER BY {s}"
    grp_sel = f"{by}, " if by else ""
    grp_by = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {grp_sel}round((sum(CASE WHEN {y} = 1 THEN midrank END) - P * (P + 1) / 2.0) / (P * N), 6)
    AS auc, CAST(P AS BIGINT) AS pos, CAST(N AS BIGINT) AS neg
FROM (
  SELECT {grp_sel}{y},
    count(*) OVER ({order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - (count(*) OVER ({part}) - 1) / 2.0 AS midrank,
    count_if({y} = 1) OVER ({"PARTITION BY " + by if by else ""}) AS P,
    count_if({y} = 0) OVER ({"PARTITION BY " + by if by else ""}) AS N
  FROM {src}) r
{grp_by}{", " if by else "GROUP BY "}P, N"""


def roc_auc_sql() -> str:
    return scored_cte() + ", s3 AS (SELECT round(score, 3) AS s, churn_100 AS y FROM scored)" \
        + _rank_auc("s3", "s", "y")


def roc_auc_by_fold_sql() -> str:
    return scored_cte() + ", s3 AS (SELECT fold, round(score, 3) AS s, churn_100 AS y FROM scored)" \
        + _rank_auc("s3", "s", "y", by="fold")


def _report(src: str, t: str, y: str = "churn_100") -> str:
    return f"""
SELECT tp, fp, tn, fn,
  round(CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + tn + fn) END, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM (SELECT CAST(count_if(score > {t} AND {y} = 1) AS BIGINT) AS tp,
             CAST(count_if(score > {t} AND {y} = 0) AS BIGINT) AS fp,
             CAST(count_if(NOT (score > {t}) AND {y} = 0) AS BIGINT) AS tn,
             CAST(count_if(NOT (score > {t}) AND {y} = 1) AS BIGINT) AS fn FROM {src}) c"""


def classification_report_sql() -> str:
    return scored_cte() + _report("scored", "0.5")


def best_threshold_sql() -> str:
    return scored_cte() + """, grid AS (SELECT i, i / 100.0 AS t FROM range(20, 51) g(i)),
curve AS (
  SELECT i, t, count_if(score > t AND churn_100 = 1) AS tp, count_if(score > t AND churn_100 = 0) AS fp,
    count_if(NOT (score > t) AND churn_100 = 1) AS fn
  FROM grid, scored WHERE split = 'train' GROUP BY i, t),
best AS (
  SELECT t, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
  FROM curve ORDER BY f1 DESC, i ASC LIMIT 1),
rep AS (
  SELECT count_if(score > b.t AND churn_100 = 1) AS tp, count_if(score > b.t AND churn_100 = 0) AS fp,
    count_if(NOT (score > b.t) AND churn_100 = 0) AS tn, count_if(NOT (score > b.t) AND churn_100 = 1) AS fn
  FROM scored, best b WHERE split = 'test')
SELECT b.t AS threshold, round(b.f1, 6) AS train_f1,
  round(CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + tn + fn) END, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM rep, best b"""


EPS_SQL = "CAST(2.220446049250313e-16 AS DOUBLE)"


def log_loss_sql() -> str:
    e = EPS_SQL
    kl = (f"(greatest(1.0 - y, {e}) * ln(greatest(1.0 - y, {e}) / greatest(1.0 - p, {e})) + "
          f"greatest(y, {e}) * ln(greatest(y, {e}) / greatest(p, {e})))")
    ll = f"-(y * ln(greatest(p, {e})) + (1.0 - y) * ln(greatest(1.0 - p, {e})))"
    return scored_cte() + f"""
SELECT round(sum({kl}), 6) AS kl_sum, round(avg({kl}), 6) AS kl_mean, round(avg({ll}), 6) AS log_loss,
  round(avg(CASE WHEN CAST(p > 0.5 AS INTEGER) = churn_100 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(*) AS n
FROM (SELECT score AS p, CAST(churn_100 AS DOUBLE) AS y, churn_100 FROM scored) s"""


WOE_FEATURES = ([f"c_mktsegment_{s}" for s in SEGMENTS]
                + ["his_travel_flag_Y", "his_value_seeker_flag_Y", "if_purchase_ev"])


def woe_sql() -> str:
    parts = []
    for f in WOE_FEATURES:
        parts.append(f"""SELECT '{f}' AS feature,
  CAST(count_if(churn_100 = 1 AND {f} = 1) AS BIGINT) AS a, CAST(count_if(churn_100 = 0 AND {f} = 1) AS BIGINT) AS b,
  CAST(count_if(churn_100 = 1 AND {f} = 0) AS BIGINT) AS c, CAST(count_if(churn_100 = 0 AND {f} = 0) AS BIGINT) AS d
FROM prep""")
    return prep_cte() + f""", cells AS ({" UNION ALL ".join(parts)})
SELECT feature, a, b, c, d,
  round(CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN
    ln((a / (a + c)) / (b / (b + d))) + ln((c / (a + c)) / (d / (b + d))) END, 6) AS woe
FROM cells"""


def _box(src: str, by: str, x: str, digits: int = 6) -> str:
    r = lambda e: f"round({e}, {digits})"
    return f"""q AS (SELECT {by}, count({x}) AS n, quantile_cont({x}, 0.25) AS q1,
    quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3
  FROM {src} WHERE {x} IS NOT NULL GROUP BY {by})
SELECT q.{by} AS {by}, q.n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
  {r(f"min(CASE WHEN {x} >= q1 - 1.5 * (q3 - q1) AND {x} <= q3 + 1.5 * (q3 - q1) THEN {x} END)")} AS whisker_low,
  {r(f"max(CASE WHEN {x} >= q1 - 1.5 * (q3 - q1) AND {x} <= q3 + 1.5 * (q3 - q1) THEN {x} END)")} AS whisker_high,
  CAST(count_if(NOT ({x} >= q1 - 1.5 * (q3 - q1) AND {x} <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS outliers,
  {r(f"avg({x})")} AS mean
FROM {src} s JOIN q ON s.{by} IS NOT DISTINCT FROM q.{by} WHERE {x} IS NOT NULL
GROUP BY q.{by}, q.n, q.q1, q.median, q.q3"""


def box_stats_sql() -> str:
    return with_cf(", " + _box("cf", "c_mktsegment", "ta", 4))


def period_gap_sql() -> str:
    parts = [f"SELECT 'm{m:02d}' AS period, max(CASE WHEN grp = 'up' THEN m{m:02d} END) AS up, "
             f"max(CASE WHEN grp = 'down' THEN m{m:02d} END) AS down FROM mc" for m in range(1, 13)]
    return (f"WITH mc AS ({monthly_change_sql()})\n"
            f"SELECT period, up, down, round(up - down, 6) AS gap FROM ({' UNION ALL '.join(parts)}) t")


# ------------------------------------------------------------------ SHAP oracles
def shap_cte() -> str:
    """``sh`` (wide SHAP of the test split) and ``lg`` (long) CTEs."""
    from .flows import FROZEN, FROZEN_FEATURES
    base, phis = shap_exprs(FROZEN)
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x_{f}" for f in FROZEN_FEATURES)
    ph = ", ".join(f"{phis[f]} AS shap_{f}" for f in FROZEN_FEATURES)
    longs = " UNION ALL ".join(
        f"SELECT user_id, base, '{f}' AS feature, x_{f} AS value, shap_{f} AS shap FROM sh"
        for f in FROZEN_FEATURES)
    return prep_cte() + f""", {cover_cte(FROZEN)},
sh AS (SELECT user_id, churn_100, {base} AS base, {margin_sql(FROZEN)} AS margin, {xs}, {ph}
       FROM prep, cov WHERE split = 'test'),
lg AS ({longs})
"""


def tree_shap_sql() -> str:
    from .flows import FROZEN_FEATURES
    cols = ", ".join(f"x_{f}, round(shap_{f}, 6) AS shap_{f}" for f in FROZEN_FEATURES)
    return shap_cte() + f"SELECT user_id, churn_100, round(base, 6) AS base, round(margin, 6) AS margin, {cols} FROM sh"


def split_importance_sql() -> str:
    from .flows import FROZEN
    parts = []
    for t, tree in enumerate(FROZEN.trees):
        for n in tree.nodes():
            if not tree.is_leaf(n):
                parts.append(f"SELECT '{FROZEN.features[tree.feature[n]]}' AS feature, "
                             f"CAST(c_{t}_{n} AS DOUBLE) AS cover FROM cov")
    return prep_cte() + f""", {cover_cte(FROZEN)}
SELECT feature, count(*) AS splits, sum(cover) AS cover FROM ({" UNION ALL ".join(parts)}) t GROUP BY feature"""


def shap_ranking_sql() -> str:
    return shap_cte() + """
SELECT feature, round(avg(abs(shap)), 6) AS mean_abs_shap,
  CAST(row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature ASC) AS INTEGER) AS ranking
FROM lg GROUP BY feature"""


def shap_dependence_sql() -> str:
    return shap_cte() + """
SELECT user_id, round(base, 6) AS base, feature, value, round(shap, 6) AS shap
FROM lg WHERE feature = 'tc_diff' AND value < 5 AND value > -5"""


def shap_box_sql() -> str:
    return shap_cte() + ", tcd AS (SELECT value, shap FROM lg WHERE feature = 'tc_diff'), " \
        + _box("tcd", "value", "shap", 6)


def shap_mean_curve_sql() -> str:
    return shap_cte() + """
SELECT value, round(avg(shap), 6) AS mean_shap, count(*) AS n
FROM lg WHERE feature = 'tc' AND value <= 20 GROUP BY value"""


def shap_regression_sql() -> str:
    return shap_cte() + """
SELECT feature, round(regr_slope(shap, value), 6) AS slope, round(regr_intercept(shap, value), 6) AS intercept,
  round(regr_r2(shap, value), 6) AS r2, CAST(regr_count(shap, value) AS BIGINT) AS n
FROM lg WHERE feature IN ('avg_discount', 'mon_tc') AND value BETWEEN 0 AND 1 GROUP BY feature"""


def shap_histogram_sql() -> str:
    step = "CAST(0.05 AS DOUBLE)"
    return shap_cte() + f""", b AS (
  SELECT value, shap, CAST(floor(shap / {step}) AS BIGINT) AS bin FROM lg WHERE feature = 'tc' AND value <= 20),
pv AS (SELECT value, avg(shap) AS mean_shap FROM b GROUP BY value),
rng AS (SELECT min(bin) AS b0, max(bin) AS b1 FROM b),
bins AS (SELECT range AS bin FROM rng, range(rng.b0, rng.b1 + 1)),
cnt AS (SELECT value, bin, count(*) AS n FROM b GROUP BY value, bin)
SELECT pv.value, round(pv.mean_shap, 6) AS mean_shap, round(bins.bin * {step}, 6) AS bin_min,
  round((bins.bin + 1) * {step}, 6) AS bin_max, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM pv CROSS JOIN bins LEFT JOIN cnt ON cnt.value = pv.value AND cnt.bin = bins.bin"""


def shap_density_sql() -> str:
    import math
    return shap_cte() + f""", sel AS (SELECT value, shap FROM lg WHERE feature = 'tc_diff' AND value <= 20),
st AS (SELECT value, count(*) AS n, stddev_samp(shap) * pow(count(*), -0.2) * 0.5 AS bw,
         min(shap) AS lo, max(shap) AS hi FROM sel GROUP BY value HAVING stddev_samp(shap) > 0 AND max(shap) > min(shap)),
flat AS (SELECT value, min(shap) AS lo FROM sel GROUP BY value HAVING NOT coalesce(stddev_samp(shap) > 0, false) OR max(shap) = min(shap)),
gr AS (SELECT st.value, g.i, st.lo - 3.0 * st.bw + g.i * ((st.hi - st.lo + 6.0 * st.bw) / 199) AS x, st.n, st.bw
       FROM st, range(0, 200) g(i))
SELECT gr.value, CAST(gr.i AS INTEGER) AS i, round(gr.x, 6) AS x,
  round(sum(exp(-0.5 * ((gr.x - sel.shap) / gr.bw) * ((gr.x - sel.shap) / gr.bw)))
        / (gr.n * gr.bw * {math.sqrt(2 * math.pi)!r}), 6) AS density
FROM gr JOIN sel ON gr.value = sel.value GROUP BY gr.value, gr.i, gr.x, gr.n, gr.bw
UNION ALL SELECT value, 0, round(lo, 6), NULL FROM flat"""


def explain_cases_sql() -> str:
    return shap_cte() + """, pick AS (
  SELECT * FROM sh WHERE x_tc_diff > 1 AND shap_tc_diff < -0.05 ORDER BY user_id LIMIT 1)
SELECT l.user_id, round(l.base, 6) AS base, round(p.margin, 6) AS margin, l.feature, l.value,
  round(l.shap, 6) AS shap
FROM lg l JOIN pick p ON l.user_id = p.user_id"""


def shap_summary_sql() -> str:
    return shap_cte() + """, rk AS (
  SELECT feature, row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature) AS ranking FROM lg GROUP BY feature)
SELECT l.user_id, l.feature, l.value, round(l.shap, 6) AS shap, CAST(rk.ranking AS INTEGER) AS ranking
FROM lg l JOIN rk ON l.feature = rk.feature WHERE rk.ranking <= 3"""


def early_stop_curve_sql() -> str:
    from .flows import FROZEN
    parts = []
    for k in range(1, len(FROZEN.trees) + 1):
        parts.append(f"SELECT {k} AS iteration, churn_100 AS y, {margin_sql(FROZEN, k)} AS m "
                     f"FROM prep WHERE split = 'test'")
    return prep_cte() + f", st AS ({' UNION ALL '.join(parts)})" + \
        _rank_auc("st", "m", "y", by="iteration").replace(
            "SELECT iteration, round(", "SELECT CAST(iteration AS INTEGER) AS iteration, round(", 1)


# ------------------------------------------------------------------ segmentation oracles
def segment_cte() -> str:
    from .flows import SEGMENT_FEATURES
    raw = {
        "travel_flag": "CASE WHEN his_travel_flag = 'Y' THEN 1 WHEN his_travel_flag = 'N' THEN 0 END",
        "value_seeker_flag":
            "CASE WHEN his_value_seeker_flag = 'Y' THEN 1 WHEN his_value_seeker_flag = 'N' THEN 0 END",
    }
    kinds = dict(_numeric_cf_columns())
    cols = []
    for c in SEGMENT_FEATURES:
        if c in raw:
            cols.append(f"coalesce({raw[c]}, -1) AS {c}")
        else:
            cols.append(f"{_fill(c, kinds[c])} AS {c}")
    zs = ", ".join(
        f"CASE WHEN stddev_samp({c}) OVER () = 0 THEN 0.0 "
        f"ELSE ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () END AS {c}_z"
        for c in SEGMENT_FEATURES)
    return with_cf(f""", seg AS (SELECT user_id, {', '.join(cols)} FROM cf WHERE churn_100 = 1),
z AS (SELECT *, {zs} FROM seg)
""")


def _assign_cte() -> str:
    from .flows import FROZEN_CENTERS, SEGMENT_FEATURES
    ds = []
    for center in FROZEN_CENTERS:
        terms = " + ".join(f"pow({c}_z - {_f(v)}, 2)" for c, v in zip(SEGMENT_FEATURES, center))
        ds.append(f"({_f(0.0)} + {terms})")
    k = len(ds)
    cases = []
    for i in range(k - 1):
        cond = " AND ".join(f"d{i} <= d{j}" for j in range(i + 1, k))
        cases.append(f"WHEN {cond} THEN {i}")
    dcols = ", ".join(f"{d} AS d{i}" for i, d in enumerate(ds))
    return segment_cte() + f""", dd AS (SELECT *, {dcols} FROM z),
asg AS (SELECT *, CAST(CASE {' '.join(cases)} ELSE {k - 1} END AS INTEGER) AS cls_label,
  least({', '.join(f'd{i}' for i in range(k))}) AS dist2 FROM dd)
"""


def kmeans_assign_sql() -> str:
    return _assign_cte() + "SELECT user_id, cls_label, round(dist2, 6) AS dist2 FROM asg"


def kmeans_cost_sql() -> str:
    return _assign_cte() + "SELECT round(sum(dist2), 6) AS cost, count(*) AS n FROM asg"


def segment_profile_sql() -> str:
    from .flows import SEGMENT_FEATURES
    avgs = ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in SEGMENT_FEATURES)
    return _assign_cte() + f"SELECT cls_label, count(*) AS size, {avgs} FROM asg GROUP BY cls_label"


# ------------------------------------------------------------------ MLP oracle
def mlp_score_sql() -> str:
    from .flows import MLP_FROZEN_FEATURES, frozen_mlp_weights
    ws = frozen_mlp_weights(len(MLP_FROZEN_FEATURES))
    zs = ", ".join(f"({c} - avg({c}) FILTER (WHERE split = 'train') OVER ()) / "
                   f"stddev_pop({c}) FILTER (WHERE split = 'train') OVER () AS z_{c}"
                   for c in MLP_FROZEN_FEATURES)
    prev = [f"z_{c}" for c in MLP_FROZEN_FEATURES]
    ctes = [f"l0 AS (SELECT user_id, churn_100, {zs} FROM prep)"]
    for layer, (w, b) in enumerate(ws):
        units = []
        for j in range(w.shape[1]):
            lin = f"{_f(b[j])} + " + " + ".join(f"{p} * {_f(w[i, j])}" for i, p in enumerate(prev))
            if layer == 0 or layer == len(ws) - 1:
                units.append(f"({lin}) AS a{layer}_{j}")
            else:
                units.append(f"CASE WHEN ({lin}) < 20 THEN ln(1 + exp({lin})) ELSE ({lin}) END AS a{layer}_{j}")
        ctes.append(f"l{layer + 1} AS (SELECT user_id, churn_100, {', '.join(units)} FROM l{layer})")
        prev = [f"a{layer}_{j}" for j in range(w.shape[1])]
    last = len(ws)
    return prep_cte() + ", " + ",\n".join(ctes) + f"""
SELECT user_id, churn_100,
  round(exp(a{last - 1}_1 - greatest(a{last - 1}_0, a{last - 1}_1)) /
    (exp(a{last - 1}_0 - greatest(a{last - 1}_0, a{last - 1}_1)) + exp(a{last - 1}_1 - greatest(a{last - 1}_0, a{last - 1}_1))), 6) AS score
FROM l{last}"""


# ------------------------------------------------------------------ null groups and odd columns
def box_stats_null_group_sql() -> str:
    return with_cf(""", g AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS seg, ta FROM cf), """
                   + _box("g", "seg", "ta", 4))


def roc_auc_null_group_sql() -> str:
    from ..functions.hashing import hash_unit_sql
    return f"""WITH m AS ({mlp_score_sql()}),
g AS (SELECT nullif(CAST(floor({hash_unit_sql('user_id', 'fold')} * 5) AS INTEGER), 0) AS fold,
             round(score, 6) AS s, churn_100 AS y FROM m WHERE churn_100 IN (0, 1)),
r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY s)
             + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0 AS mid FROM g),
t AS (SELECT fold, sum(CASE WHEN y = 1 THEN mid END) AS mid, CAST(count_if(y = 1) AS BIGINT) AS pos,
             CAST(count_if(y = 0) AS BIGINT) AS neg FROM r GROUP BY fold)
SELECT fold, round(CASE WHEN pos > 0 AND neg > 0 THEN (mid - pos * (pos + 1) / 2.0) / (pos * neg) END, 6) AS auc, pos, neg
FROM t"""


def correlation_odd_sql() -> str:
    cols = ("holey", "flat", "tc", "ta")
    parts = []
    for a in cols:
        for b in cols:
            both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            v = f"CASE WHEN min({a}) <> max({a}) AND min({b}) <> max({b}) THEN " \
                + ("1.0" if a == b else f"corr({a}, {b}) {both}") + " END"
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({v}, 6) AS corr FROM o")
    return with_cf(", o AS (SELECT CASE WHEN tc % 7 <> 0 THEN CAST(tc AS DOUBLE) END AS holey, 3.0::DOUBLE AS flat, tc, ta FROM cf)\n"
                   + "\nUNION ALL\n".join(parts))


def validation_flag_sql() -> str:
    from ..functions.hashing import hash_unit_sql
    return with_cf(f"SELECT user_id, churn_100, {hash_unit_sql('user_id', 'valid')} < 0.2 AS is_valid FROM cf")


def early_stop_pick_sql() -> str:
    return f"""SELECT iteration, auc FROM ({early_stop_curve_sql()}) c
ORDER BY auc DESC, iteration LIMIT 1"""


def fold_means_sql() -> str:
    from ..functions.hashing import hash_unit_sql
    from .flows import FROZEN
    parts = [f"SELECT {k} AS trees, CAST(floor({hash_unit_sql('user_id', 'fold')} * 5) AS INTEGER) AS fold, "
             f"churn_100 AS y, round({margin_sql(FROZEN, k)}, 6) AS m FROM prep" for k in (1, 2, 3)]
    return prep_cte() + f""", st AS ({' UNION ALL '.join(parts)}),
r AS (SELECT trees, fold, y, rank() OVER (PARTITION BY trees, fold ORDER BY m)
             + (count(*) OVER (PARTITION BY trees, fold, m) - 1) / 2.0 AS mid FROM st),
a AS (SELECT trees, fold, round((sum(CASE WHEN y = 1 THEN mid END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
             / (count_if(y = 1) * count_if(y = 0)), 9) AS auc FROM r GROUP BY trees, fold),
m AS (SELECT trees, round(avg(auc), 6) AS mean_auc, count(*) AS folds FROM a GROUP BY trees)
SELECT trees, mean_auc, folds, trees = (SELECT trees FROM m ORDER BY mean_auc DESC, trees LIMIT 1) AS is_best FROM m"""


def shap_subset_sql() -> str:
    return shap_cte() + """
SELECT user_id, value, round(shap, 6) AS shap FROM lg WHERE feature = 'tc_diff' AND value = 1.0"""


def preview_sql() -> str:
    return with_cf("SELECT user_id, tc FROM cf ORDER BY tc, user_id LIMIT 20 OFFSET 5")


def csv_sql() -> str:
    return with_cf("SELECT user_id, c_mktsegment, churn_100 FROM cf")


def mlp_activations_sql() -> str:
    from .flows import MLP_FROZEN_FEATURES, frozen_mlp_weights
    w, b = frozen_mlp_weights(len(MLP_FROZEN_FEATURES))[0]
    zs = ", ".join(f"({c} - avg({c}) FILTER (WHERE split = 'train') OVER ()) / "
                   f"stddev_pop({c}) FILTER (WHERE split = 'train') OVER () AS z_{c}" for c in MLP_FROZEN_FEATURES)
    units = ", ".join("round(" + f"{_f(b[j])} + " + " + ".join(
        f"z_{c} * {_f(w[i, j])}" for i, c in enumerate(MLP_FROZEN_FEATURES)) + f", 6) AS h{j}" for j in range(w.shape[1]))
    return prep_cte() + f", l0 AS (SELECT user_id, {zs} FROM prep)\nSELECT user_id, {units} FROM l0"


# ------------------------------------------------------------------ band, beeswarm, exact sizes, pipeline, sink
def shap_band_sql(replicates: int = 100, gridsize: int = 25) -> str:
    from ..functions.hashing import hash_60_sql
    from ..operators.report import POISSON, PRIME, bootstrap_factors
    factors = ", ".join(f"({r + 1}, {a})" for r, a in enumerate(bootstrap_factors(replicates)))
    drawn = f"CAST((h * a) % {PRIME} AS DOUBLE) / {PRIME}"
    weight = " + ".join(f"CAST({drawn} >= {_f(c)} AS INTEGER)" for c in POISSON)
    return shap_cte() + f""", f(r, a) AS (VALUES (0, 0), {factors}),
b AS (SELECT feature, value AS x, shap AS y, {hash_60_sql('user_id', 'band')} % {PRIME} AS h FROM lg
      WHERE feature IN ('avg_discount', 'mon_tc') AND value BETWEEN 0 AND 1),
w AS (SELECT feature, x, y, r, CASE WHEN r = 0 THEN 1 ELSE {weight} END AS w FROM b, f),
m AS (SELECT feature, r, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w GROUP BY feature, r),
l AS (SELECT feature, r, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, sx, sy, n FROM m WHERE n > 1 AND n * sxx - sx * sx > 1e-12 * n * sxx),
e AS (SELECT feature, min(x) AS x0, max(x) AS x1 FROM b GROUP BY feature),
g AS (SELECT feature, i, x0 + i * ((x1 - x0) / {gridsize - 1}) AS x FROM e, range(0, {gridsize}) t(i)),
p AS (SELECT g.feature, i, x, r, (sy - slope * l.sx) / n + slope * x AS v FROM g JOIN l ON g.feature = l.feature)
SELECT feature, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(max(CASE WHEN r = 0 THEN v END), 6) AS fit,
  round(quantile_cont(CASE WHEN r > 0 THEN v END, 0.025), 6) AS low, round(quantile_cont(CASE WHEN r > 0 THEN v END, 0.975), 6) AS high
FROM p GROUP BY feature, i, x"""


def shap_beeswarm_sql(n: int = 3, sample: int = 150, bins: int = 100) -> str:
    from ..functions.hashing import hash_60_sql
    return shap_cte() + f""", rk AS (
  SELECT feature, row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature) AS ranking FROM lg GROUP BY feature),
ids AS (SELECT user_id, {hash_60_sql('user_id', 'swarm')} AS h FROM lg GROUP BY user_id ORDER BY h LIMIT {sample}),
pt AS (SELECT lg.*, rk.ranking, h, min(shap) OVER q AS lo, max(shap) OVER q AS hi FROM lg JOIN ids USING (user_id) JOIN rk USING (feature)
       WHERE ranking <= {n} WINDOW q AS (PARTITION BY feature)),
bn AS (SELECT *, CASE WHEN hi > lo THEN CAST(floor({bins} * (shap - lo) / (hi - lo) + 0.5) AS INTEGER) ELSE 0 END AS bin FROM pt),
la AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature, bin ORDER BY h) - 1 AS INTEGER) AS layer FROM bn)
SELECT feature, CAST(ranking AS INTEGER) AS ranking, user_id, value, round(shap, 6) AS shap, bin, layer,
  CAST(ceil(layer / 2) * CASE WHEN layer % 2 = 1 THEN 1 ELSE -1 END AS INTEGER) AS "offset" FROM la"""


def split_exact_sql() -> str:
    from ..functions.hashing import hash_60_sql
    return with_cf(f"""SELECT user_id, CASE WHEN row_number() OVER (ORDER BY {hash_60_sql('user_id', 'split')}) <= ceil(count(*) OVER () * 0.25)
  THEN 'test' ELSE 'train' END AS split FROM cf""")


def folds_exact_sql() -> str:
    from ..functions.hashing import hash_60_sql
    return with_cf(f"""SELECT user_id, CAST(ntile(5) OVER (ORDER BY {hash_60_sql('user_id', 'fold')}) - 1 AS INTEGER) AS fold FROM cf""")


def frozen_pipeline_sql() -> str:
    return prep_cte() + "SELECT user_id, round(tc * 0.5, 6) AS half_tc, round(avg_discount * 10.0, 6) AS discount_tenths FROM prep"


def replace_table_sql() -> str:
    return with_cf("SELECT user_id, tc, c_mktsegment FROM cf WHERE tc > 10")


def box_outliers_sql() -> str:
    return with_cf("""SELECT cf.c_mktsegment, ta AS value, count(*) AS n FROM cf JOIN (
  SELECT c_mktsegment, quantile_cont(ta, 0.25) AS q1, quantile_cont(ta, 0.75) AS q3 FROM cf GROUP BY c_mktsegment) q
ON cf.c_mktsegment = q.c_mktsegment WHERE ta < q1 - 0.75 * (q3 - q1) OR ta > q3 + 0.75 * (q3 - q1) GROUP BY cf.c_mktsegment, ta""")
