"""Model evaluation.

Every metric is an aggregate over the scored table; nothing is collected
except one result row.  Exact ROC AUC handles ties by the midrank rule and
never sorts the raw rows: rows are first reduced to one row per distinct
score (map-side partial aggregation), then the running count of negatives
comes from ``running_sums`` (range buckets, no single-task window).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cumulative import DEFAULT_ROWS_PER_BUCKET, running_sums

EPS = float(np.finfo(float).eps)


def _safe_div(a: Column, b: Column) -> Column:
    """a / b, 0.0 on a zero denominator (the convention of the reference's metrics)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def score_counts(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """One row per (group, distinct score) with its positive and negative counts."""
    y = F.col(label)
    return (df.where(y.isin(0, 1) & F.col(score).isNotNull())
            .groupBy(*(by or []), F.col(score).alias("score"))
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def roc_auc_table(df: DataFrame, score: str, label: str, by: list[str] | None = None,
                  rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Exact ROC AUC with ties counted one half (M10): ``[by...], auc, pos, neg``.

    AUC = sum_s pos(s) * (neg(<s) + neg(s)/2) / (P * N); null when a class is
    missing.  ``by`` computes one AUC per group (e.g. per fold) in the same
    pass.
    """
    by = list(by or [])
    counts = score_counts(df, score, label, by)
    cum = running_sums(counts, "score", ["neg"], by, rows_per_bucket)
    part = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    aggs = [F.sum(part).alias("_num"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")]
    g = cum.groupBy(*by).agg(*aggs) if by else cum.agg(*aggs)
    return g.select(
        *by,
        F.when((F.col("pos") > 0) & (F.col("neg") > 0),
               F.col("_num") / (F.col("pos") * F.col("neg"))).alias("auc"),
        F.coalesce(F.col("pos"), F.lit(0)).cast("bigint").alias("pos"),
        F.coalesce(F.col("neg"), F.lit(0)).cast("bigint").alias("neg"))


def roc_auc(df: DataFrame, score: str, label: str) -> float | None:
    return roc_auc_table(df, score, label).first()["auc"]


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn with the strict rule ``score > threshold``."""
    pred = F.col(score) > F.lit(threshold)
    y = F.col(label)
    return df.agg(
        F.count_if(pred & (y == 1)).alias("tp"), F.count_if(pred & (y == 0)).alias("fp"),
        F.count_if(~pred & (y == 0)).alias("tn"), F.count_if(~pred & (y == 1)).alias("fn"))


def report_columns(tp="tp", fp="fp", tn="tn", fn="fn") -> list[Column]:
    tp, fp, tn, fn = F.col(tp), F.col(fp), F.col(tn), F.col(fn)
    return [
        _safe_div(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _safe_div(tp, tp + fp).alias("precision"),
        _safe_div(tp, tp + fn).alias("recall"),
        _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def classification_report(df: DataFrame, score: str, label: str,
                          threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 at a threshold in one aggregate (A5)."""
    c = confusion(df, score, label, threshold)
    return c.select("tp", "fp", "tn", "fn", *report_columns())


def threshold_grid(lo: int = 20, hi: int = 50, step: int = 1, scale: int = 100) -> list[float]:
    """Decimal grid 0.20, 0.21, ..., 0.50 (31 values) built exactly, not by float steps."""
    return [i / scale for i in range(lo, hi + 1, step)]


def f1_curve(df: DataFrame, score: str, label: str, grid: list[float]) -> DataFrame:
    """(idx, threshold, tp, fp, fn, f1) for every grid threshold in one pass.

    Each row is bucketed to the number of grid values strictly below its
    score, counts are reduced per (bucket, label) - at most 2 * (len(grid)+1)
    rows - and each bucket row is expanded to the thresholds it exceeds.
    """
    s = F.col(score)
    k = sum((s > F.lit(t)).cast("int") for t in grid)
    per_bucket = (df.where(F.col(label).isin(0, 1)).groupBy(k.alias("k"))
                  .agg(F.count_if(F.col(label) == 1).alias("pos"),
                       F.count_if(F.col(label) == 0).alias("neg")))
    grid_arr = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(t).alias("threshold"))
                         for i, t in enumerate(grid)])
    expanded = per_bucket.select("k", "pos", "neg", F.inline(grid_arr))
    curve = expanded.groupBy("idx", "threshold").agg(
        F.sum(F.when(F.col("k") > F.col("idx"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("k") > F.col("idx"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("k") <= F.col("idx"), F.col("pos")).otherwise(0)).alias("fn"))
    return curve.select("idx", "threshold", "tp", "fp", "fn",
                        _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
                        .alias("f1"))


def best_threshold(train: DataFrame, test: DataFrame, score: str, label: str,
                   grid: list[float] | None = None) -> DataFrame:
    """Pick the threshold with the best train F1 (first wins), report on test.

    The F1 curve has len(grid) rows; the chosen threshold is one scalar.  Without
    labelled training rows the result is one row of nulls.
    """
    grid = grid or threshold_grid()
    best = (f1_curve(train, score, label, grid)
            .orderBy(F.desc("f1"), F.asc("idx")).limit(1).first())
    if best is None:  # no labelled training row: nothing to choose from
        null = F.lit(None).cast("double")
        return test.limit(0).groupBy().agg(F.count(F.lit(1)).alias("_n")).select(
            *[null.alias(c) for c in ("threshold", "train_f1", "accuracy", "precision", "recall", "f1")])
    t = float(best["threshold"])
    rep = classification_report(test, score, label, t)
    return rep.select(F.lit(t).alias("threshold"), F.lit(float(best["f1"])).alias("train_f1"),
                      "accuracy", "precision", "recall", "f1")


def kl_loss(df: DataFrame, prob: str, label: str, eps: float = EPS,
            by: list[str] | None = None) -> DataFrame:
    """KL divergence of one-hot labels from (1-p, p), clipped at ``eps``.

    Returns the summed loss, the loss per row, the standard log loss and the
    argmax accuracy (p = 0.5 predicts class 0, the first maximum).
    """
    p = F.col(prob)
    y = F.col(label).cast("double")
    e = F.lit(eps)

    def term(t: Column, q: Column) -> Column:
        tc = F.greatest(t, e)
        return tc * F.ln(tc / F.greatest(q, e))

    kl = term(1 - y, 1 - p) + term(y, p)
    ll = -(y * F.ln(F.greatest(p, e)) + (1 - y) * F.ln(F.greatest(1 - p, e)))
    aggs = [F.sum(kl).alias("kl_sum"), F.avg(kl).alias("kl_mean"), F.avg(ll).alias("log_loss"),
            F.avg(((p > 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"),
            F.count(F.lit(1)).alias("n")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def mean_over_folds(cv: DataFrame, params: list[str], metric: str = "auc") -> DataFrame:
    """Average a metric per parameter setting."""
    return cv.groupBy(*params).agg(F.avg(metric).alias(f"mean_{metric}"),
                                   F.count(F.lit(1)).alias("folds"))


def best_setting(summary: DataFrame, metric: str, order_col: str) -> DataFrame:
    """Arg max with first-wins ties by ``order_col`` (A16): a top-1 report."""
    return summary.orderBy(F.desc(metric), F.asc(order_col)).limit(1)
