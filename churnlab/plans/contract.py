"""Contract queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the given tables (or tables Spark derives from them), so
its work grows with the data.  ``ORACLE`` holds the DuckDB SQL for the
queries whose result is fully determined by SQL semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import ranked
from ..functions.cumulative import materialize
from ..functions.layout import laid_out
from ..functions.numeric import rnd, wrap_sql_rounds
from ..sources import fixtures as fx
from . import oracle_sql as osql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = wrap_sql_rounds(sql() if callable(sql) else sql)
        return fn
    return deco


@query("customer_features", osql.customer_features_sql)
def q_customer_features(spark: SparkSession, sf: str) -> DataFrame:
    return fx.customer_features(spark, sf)


@query("monthly_change", osql.monthly_change_sql)
def q_monthly_change(spark: SparkSession, sf: str) -> DataFrame:
    return fx.monthly_change(spark, sf)


# ---------------------------------------------------------------- prepare / sampling
from ..operators import prepare as prep  # noqa: E402
from ..operators import sampling as smp  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

FLAG_MAP = {"his_travel_flag": "travel_flag", "his_value_seeker_flag": "value_seeker_flag"}


@query("encode_flags", osql.encode_flags_sql)
def q_encode_flags(spark, sf):
    cf = fx.feature_table(spark, sf)
    return prep.encode_flags(cf, FLAG_MAP).select("user_id", "travel_flag", "value_seeker_flag")


@query("fill_missing", osql.fill_missing_sql)
def q_fill_missing(spark, sf):
    cf = fx.feature_table(spark, sf)
    cols = [c for c, _ in osql._numeric_cf_columns()]
    return prep.fill_missing(cf.select(*cols, "c_mktsegment"), -1)


@query("one_hot", osql.one_hot_sql)
def q_one_hot(spark, sf):
    cf = fx.feature_table(spark, sf).select(
        "user_id", "c_mktsegment", "his_travel_flag", "his_value_seeker_flag")
    return prep.one_hot(cf, ["c_mktsegment", "his_travel_flag", "his_value_seeker_flag"])


@query("split_xy", osql.split_xy_sql)
def q_split_xy(spark, sf):
    cf = fx.feature_table(spark, sf)
    feats = ["tc", "ta", "tc_diff", "ta_diff", "distinct_store", "avg_discount"]
    cast = prep.cast_columns(cf, {**{c: "double" for c in feats}, "churn_100": "bigint"})
    return prep.split_xy(cast, "user_id", "churn_100", feats)


@query("dedup_customers", osql.dedup_orders_sql)
def q_dedup(spark, sf):
    from ..sources.io import read_table
    orders = read_table(spark, "orders", sf)
    return prep.dedup(orders, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("train_test_split", osql.split_sql)
def q_split(spark, sf):
    cf = fx.feature_table(spark, sf).select("user_id", "churn_100")
    return smp.with_split(cf, "user_id", 0.25)


@query("validation_flag", osql.validation_flag_sql)
def q_valid(spark, sf):
    cf = fx.feature_table(spark, sf).select("user_id", "churn_100")
    return smp.with_validation_flag(cf, "user_id", 0.2)


@query("assign_folds", osql.folds_sql)
def q_folds(spark, sf):
    cf = fx.feature_table(spark, sf).select("user_id", "churn_100")
    return smp.assign_folds(cf, "user_id", 5)


@query("train_test_split_exact", osql.split_exact_sql)
def q_split_exact(spark, sf):
    """75/25 split with exact sizes (R2)."""
    return smp.exact_split(fx.feature_table(spark, sf).select("user_id"), "user_id")


@query("assign_folds_exact", osql.folds_exact_sql)
def q_folds_exact(spark, sf):
    """Five folds whose sizes differ by one at most."""
    return smp.exact_folds(fx.feature_table(spark, sf).select("user_id"), "user_id", 5)


@query("downsample_negatives", osql.downsample_sql)
def q_downsample(spark, sf):
    cf = fx.feature_table(spark, sf).select("user_id", "re1")
    return smp.downsample_negatives(cf, "re1", "user_id", 1.5)


def _rounded(df, cols, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


@query("standardize_pop", lambda: osql.standardize_sql(0))
def q_std_pop(spark, sf):
    cf = fx.feature_table(spark, sf).select("user_id", *osql.STD_COLS)
    return _rounded(prep.standardize(cf, osql.STD_COLS, ddof=0), osql.STD_COLS)


@query("standardize_sample", lambda: osql.standardize_sql(1))
def q_std_samp(spark, sf):
    cf = fx.feature_table(spark, sf).select("user_id", *osql.STD_COLS)
    return _rounded(prep.standardize(cf, osql.STD_COLS, ddof=1), osql.STD_COLS)


@query("correlation_odd_columns", osql.correlation_odd_sql)
def q_corr_odd(spark, sf):
    """A column with NaN, a constant one, and columns without a missing value."""
    cf = fx.feature_table(spark, sf).select(
        F.when(F.col("tc") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("tc").cast("double")).alias("holey"),
        F.lit(3.0).alias("flat"), "tc", "ta")
    return _rounded(prep.correlation_matrix(cf, ["holey", "flat", "tc", "ta"]), ["corr"])


@query("correlation_matrix", osql.correlation_sql)
def q_corr(spark, sf):
    cf = fx.feature_table(spark, sf)
    return _rounded(prep.correlation_matrix(cf, osql.CORR_COLS), ["corr"])


# ---------------------------------------------------------------- metrics (frozen scores)
from ..operators import boost, grid_boost, metrics, report, segment  # noqa: E402
from ..operators import shap as tshap  # noqa: E402
from . import flows  # noqa: E402


@query("gbt_score_frozen", osql.frozen_score_sql)
def q_score_frozen(spark, sf):
    data = flows.prepared_features(spark, sf)
    p = flows.FROZEN.prob_expr()
    return data.select("user_id", rnd(p, 6).alias("score"), (p > 0.5).cast("int").alias("prediction"))


@query("roc_auc", osql.roc_auc_sql)
def q_roc_auc(spark, sf):
    s = flows.frozen_scores(spark, sf).withColumn("score", rnd("score", 3))
    return metrics.roc_auc_table(s, "score", "churn_100").withColumn("auc", rnd("auc", 6))


@query("roc_auc_by_fold", osql.roc_auc_by_fold_sql)
def q_roc_auc_fold(spark, sf):
    s = smp.assign_folds(flows.frozen_scores(spark, sf), "user_id", 5) \
        .withColumn("score", rnd("score", 3))
    return metrics.roc_auc_table(s, "score", "churn_100", by=["fold"]) \
        .withColumn("auc", rnd("auc", 6))


@query("classification_report", osql.classification_report_sql)
def q_report(spark, sf):
    rep = metrics.classification_report(flows.frozen_scores(spark, sf), "score", "churn_100", 0.5)
    return _rounded(rep, ["accuracy", "precision", "recall", "f1"])


@query("best_threshold", osql.best_threshold_sql)
def q_best_threshold(spark, sf):
    s = flows.frozen_scores(spark, sf)
    out = metrics.best_threshold(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"),
                                 "score", "churn_100")
    return _rounded(out, ["train_f1", "accuracy", "precision", "recall", "f1"])


@query("log_loss", osql.log_loss_sql)
def q_log_loss(spark, sf):
    out = metrics.kl_loss(flows.frozen_scores(spark, sf), "score", "churn_100")
    return _rounded(out, ["kl_sum", "kl_mean", "log_loss", "accuracy"])


# ---------------------------------------------------------------- reports without a model
@query("woe", osql.woe_sql)
def q_woe(spark, sf):
    data = flows.prepared_features(spark, sf)
    return _rounded(report.woe(data, osql.WOE_FEATURES, "churn_100"), ["woe"])


@query("box_stats_null_group", osql.box_stats_null_group_sql)
def q_box_null(spark, sf):
    """Groups with a null key, forced through many range buckets."""
    cf = fx.feature_table(spark, sf).withColumn("seg", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    out = report.box_stats(cf, ["seg"], "ta", rows_per_bucket=100)
    return _rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high", "mean"], 4)


@query("roc_auc_null_group", osql.roc_auc_null_group_sql)
def q_auc_null(spark, sf):
    """One AUC per fold, fold 0 under a null key, over a continuous score in many buckets."""
    data, feats = flows.mlp_input(spark, sf, flows.MLP_FROZEN_FEATURES)
    s = nn.mlp_score(data, flows.frozen_mlp_weights(len(feats)), feats, "user_id", keep=["churn_100"]) \
        .withColumn("score", rnd("score", 6))
    s = smp.assign_folds(s, "user_id", 5).withColumn("fold", F.when(F.col("fold") > 0, F.col("fold")))
    return metrics.roc_auc_table(s, "score", "churn_100", by=["fold"], rows_per_bucket=50).withColumn("auc", rnd("auc", 6))


@query("box_outliers", osql.box_outliers_sql)
def q_box_outliers(spark, sf):
    """Points beyond whiskers of 0.75 box lengths."""
    return report.box_outliers(fx.feature_table(spark, sf), ["c_mktsegment"], "ta", 0.75)


@query("box_stats", osql.box_stats_sql)
def q_box(spark, sf):
    cf = fx.feature_table(spark, sf)
    out = report.box_stats(cf, ["c_mktsegment"], "ta")
    return _rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high", "mean"], 4)


@query("period_gap", osql.period_gap_sql)
def q_period_gap(spark, sf):
    mc = fx.monthly_change(spark, sf)
    out = report.period_gap(mc, "grp", "up", "down", [f"m{m:02d}" for m in range(1, 13)])
    return _rounded(out, ["gap"])


# ---------------------------------------------------------------- SHAP on the frozen ensemble
SHAP_COLS = [f"shap_{f}" for f in flows.FROZEN_FEATURES]


@query("tree_shap_frozen", osql.tree_shap_sql)
def q_tree_shap(spark, sf):
    return _rounded(flows.frozen_shap_wide(spark, sf), ["base", "margin", *SHAP_COLS])


@query("split_importance_frozen", osql.split_importance_sql)
def q_split_importance(spark, sf):
    _, ens = flows.frozen_fitted(spark, sf)
    rows = boost.split_importance(ens)
    return spark.createDataFrame(rows, "feature string, splits bigint, cover double")


@query("shap_ranking", osql.shap_ranking_sql)
def q_shap_ranking(spark, sf):
    out = report.shap_ranking(flows.frozen_shap_long(spark, sf))
    return _rounded(out, ["mean_abs_shap"]).withColumn("ranking", F.col("ranking").cast("int"))


@query("shap_dependence", osql.shap_dependence_sql)
def q_shap_dependence(spark, sf):
    out = report.shap_dependence(flows.frozen_shap_long(spark, sf), "tc_diff", 5, -5)
    return _rounded(out, ["base", "shap"])


@query("shap_box", osql.shap_box_sql)
def q_shap_box(spark, sf):
    out = report.shap_box(flows.frozen_shap_long(spark, sf), "tc_diff")
    return _rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high", "mean"])


@query("shap_mean_curve", osql.shap_mean_curve_sql)
def q_shap_mean(spark, sf):
    return _rounded(report.shap_mean_curve(flows.frozen_shap_long(spark, sf), "tc", 20), ["mean_shap"])


@query("shap_regression", osql.shap_regression_sql)
def q_shap_regression(spark, sf):
    out = report.shap_regression(flows.frozen_shap_long(spark, sf), ["avg_discount", "mon_tc"])
    return _rounded(out, ["slope", "intercept", "r2"])


@query("shap_regression_band", osql.shap_band_sql)
def q_shap_band(spark, sf):
    """Regression line and bootstrap band."""
    out = report.shap_regression_band(flows.frozen_shap_long(spark, sf), ["avg_discount", "mon_tc"], "user_id", replicates=100, gridsize=25)
    return _rounded(out, ["x", "fit", "low", "high"])


@query("shap_beeswarm", osql.shap_beeswarm_sql)
def q_shap_beeswarm(spark, sf):
    """Points of the summary plot with their places (M18); the sample is the reference's argument."""
    return _rounded(report.shap_beeswarm(flows.frozen_shap_long(spark, sf), "user_id", 3, 150), ["shap"])


@query("shap_histogram", osql.shap_histogram_sql)
def q_shap_hist(spark, sf):
    out = report.shap_histogram(flows.frozen_shap_long(spark, sf), "tc", 20, 0.05)
    return _rounded(out, ["mean_shap", "bin_min", "bin_max"])


@query("shap_density", osql.shap_density_sql)
def q_shap_density(spark, sf):
    out = report.shap_density(flows.frozen_shap_long(spark, sf), "tc_diff", 20)
    return _rounded(out, ["x", "density"])


@query("explain_cases", osql.explain_cases_sql)
def q_explain(spark, sf):
    wide = flows.frozen_shap_wide(spark, sf)
    pred = (F.col("x_tc_diff") > 1) & (F.col("shap_tc_diff") < -0.05)
    out = report.explain_cases(wide, pred, "user_id", flows.FROZEN_FEATURES, k=0)
    return _rounded(out, ["base", "margin", "shap"])


@query("shap_summary", osql.shap_summary_sql)
def q_shap_summary(spark, sf):
    out = report.shap_summary(flows.frozen_shap_long(spark, sf), 3)
    return _rounded(out.select("user_id", "feature", "value", "shap", "ranking"), ["shap"]) \
        .withColumn("ranking", F.col("ranking").cast("int"))


@query("early_stop_curve_frozen", osql.early_stop_curve_sql)
def q_early_stop_frozen(spark, sf):
    data = flows.split_prepared(spark, sf).where(F.col("split") == "test")
    out = boost.staged_auc(flows.FROZEN, data, "churn_100")
    return out.withColumn("auc", rnd("auc", 6))


# ---------------------------------------------------------------- segmentation
def _segment_assigned(spark, sf):
    data = flows.segment_input(spark, sf)
    zcols = [c + "_z" for c in flows.SEGMENT_FEATURES]
    return segment.kmeans_assign(data, zcols, flows.FROZEN_CENTERS)


@query("kmeans_assign", osql.kmeans_assign_sql)
def q_kmeans_assign(spark, sf):
    return _rounded(_segment_assigned(spark, sf).select("user_id", "cls_label", "dist2"), ["dist2"])


@query("kmeans_cost", osql.kmeans_cost_sql)
def q_kmeans_cost(spark, sf):
    data = flows.segment_input(spark, sf)
    zcols = [c + "_z" for c in flows.SEGMENT_FEATURES]
    return _rounded(segment.kmeans_cost(data, zcols, flows.FROZEN_CENTERS), ["cost"])


@query("segment_profile_frozen", osql.segment_profile_sql)
def q_segment_profile_frozen(spark, sf):
    out = segment.segment_profile(_segment_assigned(spark, sf), "cls_label", flows.SEGMENT_FEATURES)
    return _rounded(out, [f"avg_{c}" for c in flows.SEGMENT_FEATURES])


@query("kmeans_restart_costs")
def q_kmeans_restarts(spark, sf):
    """Cost and iterations of five restarts, all in one pass per iteration (M4; rows-only)."""
    data = flows.segment_input(spark, sf).persist()
    zcols = [c + "_z" for c in flows.SEGMENT_FEATURES]
    seeds = [1, 2, 3, 4, 5]
    found = segment.kmeans_restarts(data, zcols, segment.hashed_starts(data, zcols, "user_id", 4, seeds))
    data.unpersist()
    least = min(cost for _, cost, _ in found)
    rows = [(seed, cost, n, cost == least) for seed, (_, cost, n) in zip(seeds, found)]
    return spark.createDataFrame(rows, "seed int, cost double, iterations int, is_best boolean")


@query("kmeans_best_of")
def q_kmeans_best_of(spark, sf):
    """Trained: k = 4, best of 5 seeds, up to 100 iterations (rows-only check)."""
    return flows.segment_profile_flow(spark, sf, k=4, restarts=5, max_iter=100)


# ---------------------------------------------------------------- trained boosted trees
@query("gbt_fit_score")
def q_gbt_fit_score(spark, sf):
    """Trained GBT (100 trees, depth 4) scored on the test split (rows-only check)."""
    data, model, _ = flows.trained_gbt(spark, sf)
    test = data.where(F.col("split") == "test")
    return boost.score(model, test, "user_id", keep=["churn_100"])


def _evaluate(scored, label):
    """One row: exact AUC plus the report at 0.5 (the AUC is one scalar)."""
    rep = metrics.classification_report(scored, "score", label, 0.5)
    return rep.select(F.lit(metrics.roc_auc(scored, "score", label)).alias("auc"), *rep.columns)


@query("gbt_evaluate")
def q_gbt_evaluate(spark, sf):
    """Train and test AUC / accuracy / precision / recall of the trained GBT (rows-only)."""
    data, model, _ = flows.trained_gbt(spark, sf)
    scored = materialize(boost.score(model, data, "user_id", keep=["churn_100", "split"]))
    out = None
    for part in ("train", "test"):
        s = scored.where(F.col("split") == part)
        r = _evaluate(s, "churn_100").withColumn("split", F.lit(part))
        out = r if out is None else out.unionByName(r)
    return out


@query("gbt_re1_downsampled")
def q_gbt_re1(spark, sf):
    """re1 model trained on negatives down-sampled to 2:3, evaluated on the test split."""
    data, model, _ = flows.trained_gbt(spark, sf, label="re1", downsample=True)
    scored = boost.score(model, data.where(F.col("split") == "test"), "user_id", keep=["re1"])
    return _evaluate(scored, "re1")


@query("cv_gbt")
def q_cv_gbt(spark, sf):
    """5-fold CV over step size x depth with CrossValidator(foldCol) (rows-only)."""
    data = laid_out(smp.assign_folds(flows.split_prepared(spark, sf).where(F.col("split") == "train"),
                                     "user_id", 5))
    feats = flows.model_features(data.drop("fold"))
    out = boost.cv_gbt(data, feats, "churn_100", "fold", step_sizes=(0.1, 0.05),
                       max_depths=(2, 4), parallelism=4, maxIter=10, seed=42)
    data.unpersist()
    return out


@query("cv_gbt_folds")
def q_cv_gbt_folds(spark, sf):
    """The reference's grid: 3 step sizes x 3 depths x 5 folds, up to 500 rounds, patience 20, leaf budgets, bags redrawn
    every 5 rounds, features drawn per tree; all 45 members grow in one pass per level (rows-only)."""
    return flows.grid_cv(spark, sf)


@query("leafwise_fit_score")
def q_leafwise(spark, sf):
    """Best-first trees of 31 leaves, up to 500 rounds, stopped on the validation slice: test scores (M8, M9; rows-only)."""
    data = flows.split_prepared(spark, sf)
    base = smp.with_validation_flag(data.where(F.col("split") == "train"), "user_id", 0.2).persist()
    feats = flows.model_features(data)
    member = grid_boost.Member(grid_boost.Setting(0.05), 1)
    grown, = grid_boost.grow(base.withColumn("part", F.col("is_valid").cast("int")), feats, "churn_100", [member], "user_id", "part")
    base.unpersist()
    return boost.score_ensemble(data.where(F.col("split") == "test"), grown.ensemble, "user_id", keep=["churn_100"]) \
        .withColumn("rounds", F.lit(grown.best_round))


@query("early_stop_curve")
def q_early_stop(spark, sf):
    """AUC per boosting round on the fitting and the validation rows, and the early-stopping pick."""
    base = laid_out(smp.with_validation_flag(
        flows.split_prepared(spark, sf).where(F.col("split") == "train"), "user_id", 0.2))
    feats = flows.model_features(base)
    model = boost.gbt_fit(base.where(~F.col("is_valid")), feats, "churn_100", **{**flows.GBT_PARAMS, "maxDepth": 3})
    ens = boost.ensemble_from_spark(model, feats)
    both = [materialize(boost.staged_auc(ens, base.where(F.col("is_valid") == v), "churn_100"))
            .withColumn("part", F.lit("valid" if v else "train")) for v in (True, False)]
    best = boost.best_iteration([(r["iteration"], r["auc"]) for r in both[0].collect()], 20)
    base.unpersist()
    return both[0].unionByName(both[1]).withColumn("is_best", F.col("iteration") == F.lit(best))


@query("early_stop_score")
def q_early_stop_score(spark, sf):
    """Test report of the model cut to its best validation round (rows-only)."""
    data = flows.split_prepared(spark, sf)
    base = laid_out(smp.with_validation_flag(data.where(F.col("split") == "train"), "user_id", 0.2))
    feats = flows.model_features(data)
    model = boost.gbt_fit(base.where(~F.col("is_valid")), feats, "churn_100", **{**flows.GBT_PARAMS, "maxDepth": 3})
    ens, auc = boost.early_stopped(model, feats, base.where("is_valid"), "churn_100")
    base.unpersist()
    scored = materialize(boost.score_ensemble(data.where(F.col("split") == "test"), ens, "user_id", keep=["churn_100"]))
    return _evaluate(scored, "churn_100").withColumns({"rounds": F.lit(len(ens.trees)), "valid_auc": F.lit(auc)})


@query("early_stop_pick_frozen", osql.early_stop_pick_sql)
def q_early_stop_pick(spark, sf):
    """The best round of the frozen curve (M9)."""
    data = flows.split_prepared(spark, sf).where(F.col("split") == "test")
    curve = materialize(boost.staged_auc(flows.FROZEN, data, "churn_100").withColumn("auc", rnd("auc", 6)))
    best = boost.best_iteration([(r["iteration"], r["auc"]) for r in curve.collect()], 20)
    return curve.where(F.col("iteration") == best).select("iteration", "auc")


@query("fold_means", osql.fold_means_sql)
def q_fold_means(spark, sf):
    """Mean AUC over folds for the prefixes of the frozen trees, and the first best one."""
    data = smp.assign_folds(flows.split_prepared(spark, sf), "user_id", 5)
    per = None
    for k in (1, 2, 3):
        s = data.select("fold", "churn_100", rnd(flows.FROZEN.margin_expr(k), 6).alias("m"))
        one = metrics.roc_auc_table(s, "m", "churn_100", by=["fold"]).select(F.lit(k).alias("trees"), rnd("auc", 9).alias("auc"))
        per = one if per is None else per.unionByName(one)
    means = materialize(metrics.mean_over_folds(per, ["trees"]).withColumn("mean_auc", rnd("mean_auc", 6)))
    best = metrics.best_setting(means, "mean_auc", "trees").first()["trees"]
    return means.select("trees", "mean_auc", "folds", (F.col("trees") == best).alias("is_best"))


@query("gbt_fit_best")
def q_gbt_fit_best(spark, sf):
    """Grid CV (shared with ``cv_gbt_folds``), refit of the best setting, test report (rows-only)."""
    return flows.gbt_fit_best(spark, sf)


@query("shap_subset", osql.shap_subset_sql)
def q_shap_subset(spark, sf):
    out = report.shap_subset(flows.frozen_shap_long(spark, sf), "tc_diff", 1.0)
    return _rounded(out.select("user_id", "value", "shap"), ["shap"])


@query("preview", osql.preview_sql)
def q_preview(spark, sf):
    """Ordered slice (S6, O2): a display feature, so its limit is the point."""
    from ..sources.io import preview
    return preview(fx.feature_table(spark, sf).select("user_id", "tc"), ["tc", "user_id"], offset=5, n=20)


@query("table_replace_round_trip", osql.replace_table_sql)
def q_replace(spark, sf):
    """A table overwritten in stages by rows read from itself."""
    import uuid

    from ..sources.io import read_table, replace_table
    from ..sources.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    replace_table(fx.feature_table(spark, sf).select("user_id", "tc", "c_mktsegment"), path)
    replace_table(read_table(spark, path).where(F.col("tc") > 10), path)
    return read_table(spark, path)


@query("frozen_pipeline", osql.frozen_pipeline_sql)
def q_frozen_pipeline(spark, sf):
    """Assembler, pipeline, vector elements and renames with fixed weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    data = flows.prepared_features(spark, sf)
    stages = [VectorAssembler(inputCols=["tc", "avg_discount"], outputCol="features"),
              ElementwiseProduct(scalingVec=Vectors.dense([0.5, 10.0]), inputCol="features", outputCol="scaled")]
    out = Pipeline(stages=stages).fit(data).transform(data).withColumn("v", vector_to_array("scaled"))
    out = out.select("user_id", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"))
    return _rounded(out.withColumnRenamed("first", "half_tc").withColumnRenamed("second", "discount_tenths"), ["half_tc", "discount_tenths"])


@query("csv_round_trip", osql.csv_sql)
def q_csv(spark, sf):
    """CSV written and read with an explicit schema (S4); the files are in the shared folder."""
    import uuid

    from ..sources.io import read_csv, write_csv
    from ..sources.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    cf = fx.feature_table(spark, sf).select("user_id", "c_mktsegment", "churn_100")
    write_csv(cf, path)
    return read_csv(spark, path, cf.schema)


@query("tree_shap_trained")
def q_tree_shap_trained(spark, sf):
    """TreeSHAP of the trained GBT on the test split, wide form (rows-only)."""
    data, model, feats = flows.trained_gbt(spark, sf)
    ens = boost.ensemble_from_spark(model, feats)
    test = data.where(F.col("split") == "test")
    return tshap.tree_shap(test, ens, "user_id", keep=["churn_100"])


@query("gbt_importance")
def q_gbt_importance(spark, sf):
    """Split count, cover and gain importance per feature of the trained GBT."""
    _, model, feats = flows.trained_gbt(spark, sf)
    ens = boost.ensemble_from_spark(model, feats)
    gain = dict(boost.gain_importance(model, feats))
    rows = [(f, n, c, gain.get(f, 0.0)) for f, n, c in boost.split_importance(ens)]
    return spark.createDataFrame(rows, "feature string, splits bigint, cover double, gain double")


# ---------------------------------------------------------------- MLP
from ..operators import mlp as nn  # noqa: E402
from ..operators import mlp_norm  # noqa: E402


@query("mlp_score_frozen", osql.mlp_score_sql)
def q_mlp_score_frozen(spark, sf):
    data, feats = flows.mlp_input(spark, sf, flows.MLP_FROZEN_FEATURES)
    ws = flows.frozen_mlp_weights(len(feats))
    out = nn.mlp_score(data, ws, feats, "user_id", keep=["churn_100"])
    return out.select("user_id", "churn_100", rnd("score", 6).alias("score"))


def _mlp_history(spark, sf, epochs, lr, hidden):
    """Per-epoch KL loss, accuracy and AUC on train and test.

    Each epoch scores both splits in one Arrow pass and aggregates by split.
    """
    data, feats = flows.mlp_input(spark, sf)
    data = laid_out(data)
    train = data.where(F.col("split") == "train")
    history = []

    def record(epoch, weights_list):
        s = nn.mlp_score(data, weights_list[0], feats, "user_id",
                         keep=["churn_100", "split"]).persist()
        losses = {r["split"]: r for r in metrics.kl_loss(s, "score", "churn_100", by=["split"]).collect()}
        # the score orders rows as its log odds do, which is all that an AUC needs
        rows = s.select("score", F.col("churn_100").cast("int"), (F.col("split") == "test").cast("int"))
        found = ranked.auc_of_entries(ranked.entries_of(rows, rows.columns, lambda c: [(i, c[0][c[2] == i], c[1][c[2] == i]) for i in (0, 1)]))
        aucs = {part: found[i][0] for i, part in enumerate(("train", "test")) if i in found}
        for part in ("train", "test"):
            loss = losses[part]
            history.append((epoch, part, float(loss["kl_mean"]), float(loss["accuracy"]),
                            None if aucs.get(part) is None else float(aucs[part])))
        s.unpersist()
        return False

    nn.mlp_fit(train, feats, "churn_100", hidden=hidden, epochs=epochs, lr=lr, on_epoch=record)
    data.unpersist()
    return spark.createDataFrame(history, "epoch int, split string, loss double, "
                                          "accuracy double, auc double")


@query("mlp_fit")
def q_mlp_fit(spark, sf):
    """Per-epoch loss / accuracy / AUC of the SGD MLP on train and test (rows-only)."""
    return _mlp_history(spark, sf, epochs=40, lr=0.05, hidden=64)


def _cv_mlp_summary(spark, sf, lrs=(0.1, 0.05), folds=5, epochs=40, hidden=64):
    data, feats = flows.mlp_input(spark, sf)
    train = laid_out(smp.assign_folds(data.where(F.col("split") == "train"), "user_id", folds))
    specs = [nn.Spec(lr, f) for lr in lrs for f in range(folds)]
    models = nn.mlp_fit(train, feats, "churn_100", hidden=hidden, epochs=epochs, specs=specs,
                        fold_col="fold")
    scored = None
    for m, (spec, ws) in enumerate(zip(specs, models)):
        s = nn.mlp_score(train.where(F.col("fold") == spec.holdout), ws, feats, "user_id",
                         keep=["churn_100"]).withColumn("model", F.lit(m))
        scored = s if scored is None else scored.unionByName(s)
    aucs = metrics.roc_auc_table(scored, "score", "churn_100", by=["model"]).collect()
    rows = [(specs[r["model"]].lr, specs[r["model"]].holdout, r["auc"]) for r in aucs]
    train.unpersist()
    per_fold = spark.createDataFrame(rows, "lr double, fold int, auc double")
    summary = metrics.mean_over_folds(per_fold, ["lr"])
    order = spark.createDataFrame([(lr, i) for i, lr in enumerate(lrs)], "lr double, grid_index int")
    return summary.join(order, "lr"), data, feats


@query("cv_mlp")
def q_cv_mlp(spark, sf):
    """5-fold CV over learning rates; every (rate, fold) model trains in one pass per epoch."""
    summary, _, _ = _cv_mlp_summary(spark, sf)
    return summary


@query("mlp_best")
def q_mlp_best(spark, sf):
    """Train with the best CV learning rate (first wins on ties) and report on test."""
    summary, data, feats = _cv_mlp_summary(spark, sf)
    best = metrics.best_setting(summary, "mean_auc", "grid_index").first()
    train = laid_out(data.where(F.col("split") == "train"))
    ws = nn.mlp_fit(train, feats, "churn_100", hidden=64, epochs=40, lr=float(best["lr"]))
    train.unpersist()
    scored = nn.mlp_score(data.where(F.col("split") == "test"), ws, feats, "user_id",
                          keep=["churn_100"])
    return _evaluate(scored, "churn_100").withColumn("lr", F.lit(float(best["lr"])))


@query("mlp_builtin")
def q_mlp_builtin(spark, sf):
    """Spark's MultilayerPerceptronClassifier baseline, test-split report (rows-only)."""
    data, feats = flows.mlp_input(spark, sf)
    train = data.where(F.col("split") == "train")
    model = nn.builtin_mlp(train, feats, "churn_100", [len(feats), 16, 16, 2], max_iter=50)
    scored = boost.score(model, data.where(F.col("split") == "test"), "user_id", keep=["churn_100"])
    return _evaluate(scored, "churn_100")


def _variant_net(feats):
    """The Keras script's network: batch normalisation before, and behind each of the layers 60 and 30; tanh, dropout, smoothing."""
    return mlp_norm.Net((len(feats), 60, 30, 1), "tanh", True, 0.2, 0.05)


@query("mlp_variant")
def q_mlp_variant(spark, sf):
    """Keras-style network (M28): batch normalisation, layers 60-30, tanh, Adam, dropout .2, label smoothing .05, up to 100
    epochs, early stop on validation AUC; per-epoch validation AUC, the kept epoch and its test AUC (rows-only)."""
    data, feats = flows.mlp_input(spark, sf)
    base = smp.with_validation_flag(data.where(F.col("split") == "train"), "user_id", 0.2).persist()
    net = _variant_net(feats)
    valid = laid_out(base.where("is_valid"))
    stop = mlp_norm.patience_of(lambda models: mlp_norm.auc_per_member(valid, feats, "churn_100", net, models), 1, 20)
    mlp_norm.fit(base.where(~F.col("is_valid")), feats, "churn_100", "user_id", net, [nn.Spec(0.01)], 100, on_epoch=stop)
    epoch, _, kept = stop.best[0]
    test = mlp_norm.auc_per_member(data.where(F.col("split") == "test"), feats, "churn_100", net, [kept]).get(0)
    valid.unpersist()
    base.unpersist()
    rows = [(i + 1, c[0], i + 1 == epoch, test if i + 1 == epoch else None) for i, c in enumerate(stop.curve)]
    return spark.createDataFrame(rows, "epoch int, valid_auc double, is_best boolean, test_auc double")


@query("cv_mlp_variant")
def q_cv_mlp_variant(spark, sf):
    """Learning-rate CV of the Keras-style network (M29): rates .1, .05, .01 x 5 folds, up to 100 epochs, patience 10 on the
    fold's AUC; all 15 members share each epoch's pass (rows-only)."""
    data, feats = flows.mlp_input(spark, sf)
    train = laid_out(smp.assign_folds(data.where(F.col("split") == "train"), "user_id", 5), 128 * mlp_norm.TASK_BATCHES)
    net, specs = _variant_net(feats), [nn.Spec(lr, f) for lr in (0.1, 0.05, 0.01) for f in range(5)]
    stop = mlp_norm.patience_of(lambda models: mlp_norm.auc_per_member(train, feats, "churn_100", net, models, specs, "fold"), len(specs), 10)
    mlp_norm.fit(train, feats, "churn_100", "user_id", net, specs, 100, fold_col="fold", on_epoch=stop)
    train.unpersist()
    rows = [(s.lr, s.holdout, epoch, auc if epoch else None) for s, (epoch, auc, _) in zip(specs, stop.best)]
    return spark.createDataFrame(rows, "lr double, fold int, epoch int, auc double")


@query("mlp_informed")
def q_mlp_informed(spark, sf):
    """First layer started from feature weights, here each feature's |correlation| with the label: test report (M27; rows-only)."""
    data, feats = flows.mlp_input(spark, sf)
    train = laid_out(data.where(F.col("split") == "train"))
    strength = train.agg(*[F.abs(F.corr(f, "churn_100")).alias(f"r{i}") for i, f in enumerate(feats)]).first()
    start = nn.init_weights(len(feats), 64, 2, feature_weight=[v if v is not None and v == v else 0.0 for v in strength])
    ws = nn.mlp_fit(train, feats, "churn_100", hidden=64, epochs=40, lr=0.01, init=start)
    train.unpersist()
    scored = nn.mlp_score(data.where(F.col("split") == "test"), ws, feats, "user_id", keep=["churn_100"])
    return _evaluate(scored, "churn_100")


@query("mlp_synchronous")
def q_mlp_synchronous(spark, sf):
    """Three hidden layers of 64, mini-batches from all over the table: the weights do not depend on the partitions (M27; rows-only)."""
    data, feats = flows.mlp_input(spark, sf)
    train = laid_out(data.where(F.col("split") == "train"))
    net = mlp_norm.Net((len(feats), 64, 64, 64, 2), "softplus")
    model, = mlp_norm.fit(train, feats, "churn_100", "user_id", net, [nn.Spec(0.05)], 10, 128, "sgd", synchronous=True)
    train.unpersist()
    scored = nn.mlp_score(data.where(F.col("split") == "test"), mlp_norm.folded(net, model), feats, "user_id", keep=["churn_100"],
                          first_linear=False)
    return _evaluate(scored, "churn_100")


@query("mlp_learning_rates")
def q_mlp_rates(spark, sf):
    """Final train and test loss and accuracy of four learning rates without CV, trained in one pass per epoch (rows-only)."""
    data, feats = flows.mlp_input(spark, sf)
    train = laid_out(data.where(F.col("split") == "train"))
    rates = (0.005, 0.01, 0.05, 0.1)
    models = nn.mlp_fit(train, feats, "churn_100", hidden=64, epochs=40, specs=[nn.Spec(r) for r in rates])
    out = None
    for rate, ws in zip(rates, models):
        parts = [metrics.kl_loss(nn.mlp_score(rows, ws, feats, "user_id", keep=["churn_100"]), "score", "churn_100")
                 .select(*[F.col(c).alias(prefix + c) for c in ("kl_mean", "log_loss", "accuracy")])
                 for prefix, rows in (("", train), ("test_", data.where(F.col("split") == "test")))]
        one = parts[0].crossJoin(parts[1]).select(F.lit(rate).alias("lr"), *parts[0].columns, *parts[1].columns)
        out = one if out is None else out.unionByName(one)
    out = materialize(out)
    train.unpersist()
    return out


@query("mlp_activations", osql.mlp_activations_sql)
def q_mlp_activations(spark, sf):
    """First-layer activations of the frozen network."""
    data, feats = flows.mlp_input(spark, sf, flows.MLP_FROZEN_FEATURES)
    out = nn.mlp_score(data, flows.frozen_mlp_weights(len(feats)), feats, "user_id", layer=1)
    return out.select("user_id", *[rnd(F.get("activation", F.lit(i)), 6).alias(f"h{i}") for i in range(3)])
