"""Report tables behind the reference's charts.

Each report is a Spark aggregate.  None collects a group: exact quartiles
come from running counts over (group, value) rows that were reduced first,
histograms and densities work on distinct values with a fixed fan-out, and
every join is with a table keyed by group (one row per group).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cumulative import DEFAULT_ROWS_PER_BUCKET, materialize, running_sums
from ..functions.hashing import hash_60
from ..functions.joins import join_groups, per_group
from ..functions.selection import kth_smallest
from ..functions.vectors import sum_arrays

#: Grids that a task of ``shap_density`` holds before it hands them on.
HELD_GRIDS = 5_000


# ------------------------------------------------------------------ WOE
def woe(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Weight of evidence of 0/1 features: ``(feature, a, b, c, d, woe)``.

    a, b = label 1 / 0 where x = 1; c, d = label 1 / 0 where x = 0; rows with
    x outside {0, 1} are ignored.  woe = ln(a/(a+c) / (b/(b+d))) +
    ln(c/(a+c) / (d/(b+d))) (the sum of both level WOEs, as in the
    reference); null when a cell is empty.  One aggregate for all features.
    """
    y = F.col(label)
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f)
        aggs += [F.count_if((y == 1) & (x == 1)).alias(f"a{i}"),
                 F.count_if((y == 0) & (x == 1)).alias(f"b{i}"),
                 F.count_if((y == 1) & (x == 0)).alias(f"c{i}"),
                 F.count_if((y == 0) & (x == 0)).alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a{i}").alias("a"),
                              F.col(f"b{i}").alias("b"), F.col(f"c{i}").alias("c"),
                              F.col(f"d{i}").alias("d")) for i, f in enumerate(features)])
    long = one.select(F.inline(rows))
    a, b, c, d = (F.col(k).cast("double") for k in "abcd")
    val = F.ln((a / (a + c)) / (b / (b + d))) + F.ln((c / (a + c)) / (d / (b + d)))
    ok = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
    return long.withColumn("woe", F.when(ok, val))


# ------------------------------------------------------- exact quantiles
def _rank_value(target: Column) -> Column:
    """Value of the row whose [cnt_before, cnt_before + cnt) range holds ``target``."""
    hit = (F.col("cnt_before") <= target) & (target < F.col("cnt_before") + F.col("cnt"))
    return F.max(F.when(hit, F.col("_v")))


def _value_counts(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(group, value, count) rows, materialised; missing values are left out."""
    v = F.col(x)
    return materialize(df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*by, v.alias("_v"))
                       .agg(F.count(F.lit(1)).alias("cnt")))


def _quantiles_of(counts: DataFrame, by: list[str], probs: list[float], rows_per_bucket: int) -> DataFrame:
    cum = running_sums(counts, "_v", ["cnt"], by, rows_per_bucket)
    sizes = counts.groupBy(*by).agg(F.sum("cnt").alias("n"))
    j = join_groups(cum, per_group(sizes), by)
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(p)
        aggs += [_rank_value(F.floor(h)).alias(f"_lo{i}"), _rank_value(F.ceil(h)).alias(f"_hi{i}"),
                 F.max(h - F.floor(h)).alias(f"_fr{i}")]
    g = j.groupBy(*by, "n").agg(*aggs)
    return g.select(*by, "n", *[(F.col(f"_lo{i}") + F.col(f"_fr{i}") *
                                 (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}")
                                for i in range(len(probs))])


def group_quantiles(df: DataFrame, by: list[str], x: str, probs: list[float],
                    rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy / ``quantile_cont``) per group.

    Rows are reduced to (group, value, count) map-side, running counts come
    from range buckets, and each quantile is picked by rank - no group is ever
    gathered into one task.  A null group is a group.  Output: ``by..., n,
    q<i>`` for each prob.
    """
    by, drop = (list(by), []) if by else (["_g"], ["_g"])
    src = df if not drop else df.withColumn("_g", F.lit(0))
    return _quantiles_of(_value_counts(src, by, x), by, probs, rows_per_bucket).drop(*drop)


def _boxed(df: DataFrame, by: list[str], x: str, whis: float, rows_per_bucket: int) -> DataFrame:
    """(group, value, count) rows with their group's n, quartiles, and whether the value is within the whiskers."""
    counts = _value_counts(df, by, x)
    q = _quantiles_of(counts, by, [0.25, 0.5, 0.75], rows_per_bucket) \
        .select(*by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"),
                F.col("q2").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    bounds = q.select(*by, "n", "q1", "median", "q3",
                      (F.col("q1") - whis * iqr).alias("_lo"), (F.col("q3") + whis * iqr).alias("_hi"))
    inner = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    return join_groups(counts, per_group(bounds), by).withColumn("_inner", inner)


def box_outliers(df: DataFrame, by: list[str], x: str, whis: float = 1.5,
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """The points beyond the whiskers of ``box_stats`` (A9): ``by..., value, n`` for each distinct one."""
    return _boxed(df, list(by), x, whis, rows_per_bucket).where(~F.col("_inner")) \
        .select(*by, F.col("_v").alias("value"), F.col("cnt").alias("n"))


def box_stats(df: DataFrame, by: list[str], x: str, whis: float = 1.5,
              rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Box-plot numbers per group: n, q1, median, q3, whiskers, outliers, mean.

    Whiskers reach the most extreme values within ``whis`` x IQR of the box.
    The source is read once, into (group, value, count) rows; all numbers come
    from those.  A null group is a group.
    """
    by, drop = (list(by), []) if by else (["_g"], ["_g"])
    j = _boxed(df if not drop else df.withColumn("_g", F.lit(0)), by, x, whis, rows_per_bucket)
    v, inner = F.col("_v"), F.col("_inner")
    return j.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inner, v)).alias("whisker_low"),
        F.max(F.when(inner, v)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inner, F.col("cnt"))), F.lit(0)).cast("bigint").alias("outliers"),
        (F.sum(v * F.col("cnt")) / F.sum("cnt")).alias("mean")).drop(*drop)


# ------------------------------------------------------- histogram / density
def shap_histogram(long: DataFrame, feature: str, max_value: float, step: float) -> DataFrame:
    """Ridge data (M20 / A12): per feature value, counts of SHAP in fixed bins.

    ``(value, mean_shap, bin_min, bin_max, n)``; every value gets every bin
    between the global first and last bin, empty ones with n = 0 (J3), and
    ``mean_shap`` is the value's mean SHAP on every row (J2).
    """
    sel = materialize(long.where((F.col("feature") == feature) & (F.col("value") <= max_value)).select("value", "shap"))
    binned = sel.select("value", "shap", F.floor(F.col("shap") / step).cast("bigint").alias("bin"))
    counts = binned.groupBy("value", "bin").agg(F.count(F.lit(1)).alias("n"))
    per_value = binned.groupBy("value").agg(F.avg("shap").alias("mean_shap"))
    # the global bin range is two numbers from a plain aggregate
    bins = binned.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).first()
    if bins["lo"] is None:
        grid = per_value.select("value", "mean_shap", F.lit(0).cast("bigint").alias("bin"))
    else:
        grid = per_value.select("value", "mean_shap", F.explode(F.sequence(
            F.lit(bins["lo"]).cast("bigint"), F.lit(bins["hi"]).cast("bigint"))).alias("bin"))
    full = grid.join(counts, ["value", "bin"], "left")
    return full.select("value", "mean_shap", (F.col("bin") * step).alias("bin_min"),
                       ((F.col("bin") + 1) * step).alias("bin_max"),
                       F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def shap_density(long: DataFrame, feature: str, max_value: float, gridsize: int = 200,
                 bw_adjust: float = 0.5, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE of SHAP per feature value (M20): ``(value, i, x, density)``.

    Bandwidth = Scott's rule (n^-1/5 x sample std) x ``bw_adjust``; the grid
    spans min - cut*bw .. max + cut*bw in ``gridsize`` points.  A task adds up
    the grid of each value over its rows, so what is shuffled is one array for
    each task and value, whatever the number of rows.  A value whose SHAP is
    constant has no bandwidth: it gives one row, i = 0 at that SHAP, with a
    null density.
    """
    sel = materialize(long.where((F.col("feature") == feature) & (F.col("value") <= max_value)).select("value", "shap"))
    every = materialize(sel.groupBy("value").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("shap").alias("sd"),
        F.min("shap").alias("lo"), F.max("shap").alias("hi")))
    spread = F.coalesce(F.col("sd") > 0, F.lit(False)) & (F.col("hi") > F.col("lo"))
    flat = every.where(~spread).select("value", F.lit(0).alias("i"), F.col("lo").alias("x"), F.lit(None).cast("double").alias("density"))
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), -0.2) * bw_adjust
    stats = per_group(every.where(spread).withColumn("bw", bw)
                      .withColumn("g0", F.col("lo") - cut * F.col("bw"))
                      .withColumn("gstep", (F.col("hi") - F.col("lo") + 2 * cut * F.col("bw")) / (gridsize - 1))
                      .select("value", "n", "bw", "g0", "gstep"))

    def run(batches):
        held: dict[float, np.ndarray] = {}

        def made():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.float64()), pa.array(list(held.values()), pa.list_(pa.float64()))],
                                              names=["value", "sums"])
        for batch in batches:
            value, shap, width, start, step = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            kinds, first, where = np.unique(value, return_index=True, return_inverse=True)
            for j, v in enumerate(kinds):
                at, n = np.unique(shap[where == j], return_counts=True)
                grid = start[first[j]] + np.arange(gridsize) * step[first[j]]
                total = np.zeros(gridsize)
                for k in range(0, len(at), 1000):
                    z = (grid - at[k:k + 1000, None]) / width[first[j]]
                    total += (n[k:k + 1000, None] * np.exp(-0.5 * z * z)).sum(axis=0)
                held[v] = held[v] + total if v in held else total
            if len(held) > HELD_GRIDS:
                yield made()
                held = {}
        yield made()

    rows = sel.join(stats, "value").select(F.col("value").cast("double"), "shap", "bw", "g0", "gstep")
    sums = sum_arrays(rows.mapInArrow(run, "value double, sums array<double>"), ["value"], "sums")
    pts = sums.join(stats.withColumn("value", F.col("value").cast("double")), "value") \
        .select("value", "n", "bw", "g0", "gstep", F.posexplode("sums").alias("i", "s"))
    out = pts.select(F.col("value").cast(sel.schema["value"].dataType).alias("value"), "i", (F.col("g0") + F.col("i") * F.col("gstep")).alias("x"),
                     (F.col("s") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"))
    return out.unionByName(flat)


# ------------------------------------------------------------- SHAP reports
def shap_ranking(long: DataFrame) -> DataFrame:
    """Mean |SHAP| per feature with rank 1..D, ties by name."""
    agg = long.groupBy("feature").agg(F.avg(F.abs(F.col("shap"))).alias("mean_abs_shap"))
    # D rows (one per feature): a global window over them is small by construction
    w = Window.orderBy(F.desc("mean_abs_shap"), F.asc("feature"))
    return agg.withColumn("ranking", F.row_number().over(w))


def shap_summary(long: DataFrame, n: int = 20) -> DataFrame:
    """Beeswarm data (M18): the rows of the top-n features by mean |SHAP|."""
    long = materialize(long)  # the SHAP values are computed once, for the ranking and for the rows
    top = shap_ranking(long).where(F.col("ranking") <= n).select("feature", "ranking")
    return long.join(F.broadcast(top), "feature")  # n rows: bounded by the argument


def shap_dependence(long: DataFrame, feature: str, hi: float, lo: float | None = None) -> DataFrame:
    """Dependence points ``lo < value < hi`` (M19, P11); a bound of 0 is a bound."""
    cond = (F.col("feature") == feature) & (F.col("value") < hi)
    if lo is not None:
        cond = cond & (F.col("value") > lo)
    return long.where(cond)


def shap_mean_curve(long: DataFrame, feature: str, max_value: float = 20) -> DataFrame:
    """Mean SHAP per feature value for values <= max_value."""
    return (long.where((F.col("feature") == feature) & (F.col("value") <= max_value))
            .groupBy("value").agg(F.avg("shap").alias("mean_shap"),
                                  F.count(F.lit(1)).alias("n")))


def shap_regression(long: DataFrame, features: list[str], lo: float = 0.0,
                    hi: float = 1.0) -> DataFrame:
    """Least-squares line of SHAP on value within [lo, hi], per feature."""
    sel = long.where(F.col("feature").isin(features) & F.col("value").between(lo, hi))
    return sel.groupBy("feature").agg(
        F.regr_slope("shap", "value").alias("slope"),
        F.regr_intercept("shap", "value").alias("intercept"),
        F.regr_r2("shap", "value").alias("r2"),
        F.regr_count("shap", "value").alias("n"))


#: Poisson(1) cumulative probabilities (fixed values): how often a bootstrap draws a row, by the interval of a uniform number.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
           0.9999167588507119, 0.9999897508033253, 0.999998874797402)
#: A prime; replicate r draws (h * a_r) mod PRIME of a row's hash h, with a_r = 48271^(r + 1) mod PRIME.
PRIME = (1 << 31) - 1


def bootstrap_factors(replicates: int) -> list[int]:
    return [pow(48271, r + 1, PRIME) for r in range(replicates)]


def shap_regression_band(long: DataFrame, features: list[str], id_col: str, lo: float = 0.0, hi: float = 1.0,
                         replicates: int = 200, gridsize: int = 100, level: float = 0.95, salt: str = "band") -> DataFrame:
    """The regression line of SHAP on value with its bootstrap band (M22): ``(feature, i, x, fit, low, high)``.

    Each replicate weighs a row by a Poisson(1) draw from the hash of its key, so the draw
    needs no shuffle and no seed state.  One pass adds up the five regression sums of the line
    and of all replicates in each task; Spark adds the tasks' arrays, and each feature's band
    (percentiles of the replicates' lines, linear interpolation) is made where its sums are.
    The grid runs from the least to the greatest value.  A feature with one value only has no
    line: its rows have nulls.  Replicates without a line of their own are left out.
    """
    factors = np.array(bootstrap_factors(replicates), dtype=np.uint64)
    sel = long.where(F.col("feature").isin(features) & F.col("value").between(lo, hi) & F.col("shap").isNotNull())
    rows = sel.select("feature", F.col("value").cast("double").alias("x"), F.col("shap").cast("double").alias("y"),
                      (hash_60(id_col, salt) % PRIME).alias("h"))

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, (x, y, h) = batch.column(0).to_pylist(), (c.to_numpy() for c in batch.columns[1:])
            names = np.array(names, dtype=object)
            for name in set(names.tolist()):
                at = np.flatnonzero(names == name)
                for part in np.array_split(at, -(-len(at) // 2000)):
                    drawn = (h[part, None].astype(np.uint64) * factors % np.uint64(PRIME)) / PRIME
                    weight = np.column_stack((np.ones(len(part)), np.searchsorted(POISSON, drawn, side="right")))
                    one = np.stack([weight.T @ v for v in (np.ones(len(part)), x[part], y[part], x[part] ** 2, x[part] * y[part])])
                    held[name] = held[name] + one.ravel() if name in held else one.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.float64()))],
                                         names=["feature", "sums"])

    ends = per_group(rows.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    sums = sum_arrays(rows.mapInArrow(run, "feature string, sums array<double>"), ["feature"], "sums").join(ends, "feature")

    def band(batches):
        for batch in batches:
            for name, flat, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, sx, sy, sxx, sxy = np.array(flat).reshape(5, -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    down = n * sxx - sx ** 2
                    slope = (n * sxy - sx * sy) / down
                    start = (sy - slope * sx) / n
                usable = (n > 1) & (down > 1e-12 * np.maximum(n * sxx, 1e-300))
                grid = first + np.arange(gridsize) * ((last - first) / max(1, gridsize - 1))
                lines = start[1:][usable[1:]] + grid[:, None] * slope[1:][usable[1:]]
                some = usable[0] and lines.shape[1] > 0
                ends = np.quantile(lines, [(1 - level) / 2, (1 + level) / 2], axis=1) if some else np.full((2, gridsize), np.nan)
                fit = start[0] + slope[0] * grid if usable[0] else np.full(gridsize, np.nan)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * gridsize), pa.array(np.arange(gridsize, dtype=np.int32)), pa.array(grid),
                    *(pa.array(v, from_pandas=True) for v in (fit, *ends))], names=["feature", "i", "x", "fit", "low", "high"])

    return sums.select("feature", "sums", "lo", "hi").mapInArrow(band, "feature string, i int, x double, fit double, low double, high double")


def shap_beeswarm(long: DataFrame, id_col: str, n: int = 20, sample: int = 1000, bins: int = 100, salt: str = "swarm") -> DataFrame:
    """Points of a summary plot (M18): ``(feature, ranking, id, value, shap, bin, layer, offset)``.

    The top ``n`` features, each at the ``sample`` ids of the smallest key hashes (all, if
    there are fewer); the border hash comes from ``kth_smallest``.  A feature's points fall
    into ``bins`` + 1 rounded places between its least and greatest SHAP of the sample, and
    those of one place pile up by hash: layer 0, 1, 2, ... at offset 0, 1, -1, 2, -2, ...
    A feature with one SHAP value has one place, and null SHAP values have none.
    """
    long = materialize(long)
    top = shap_ranking(long).where(F.col("ranking") <= n).select("feature", "ranking")
    drawn = hash_60(id_col, salt)
    ids = long.select(id_col).distinct().select(drawn.alias("h"))
    total = ids.count()
    kept = long if total <= sample else long.where(drawn <= kth_smallest(ids, "h", [sample])[0])
    points = kept.where(F.col("shap").isNotNull()).join(F.broadcast(top), "feature").withColumn("h", drawn)
    # at most ``sample`` rows a feature stand together here
    per = Window.partitionBy("feature")
    spread = F.max("shap").over(per) - F.min("shap").over(per)
    place = F.when(spread > 0, F.floor(bins * (F.col("shap") - F.min("shap").over(per)) / spread + 0.5)).otherwise(0).cast("int")
    layer = F.row_number().over(Window.partitionBy("feature", "bin").orderBy("h", id_col)) - 1
    offset = F.ceil(F.col("layer") / 2) * F.when(F.col("layer") % 2 == 1, 1).otherwise(-1)
    return points.withColumn("bin", place).withColumn("layer", layer) \
        .select("feature", F.col("ranking").cast("int").alias("ranking"), id_col, "value", "shap", "bin", "layer", offset.cast("int").alias("offset"))


def shap_box(long: DataFrame, feature: str) -> DataFrame:
    """SHAP distribution per value of one feature."""
    return box_stats(long.where(F.col("feature") == feature), ["value"], "shap")


def explain_cases(wide: DataFrame, predicate: Column, id_col: str, features: list[str],
                  k: int = 0, prefix: str = "shap_", value_prefix: str = "x_") -> DataFrame:
    """Force-plot data of the k-th matching row by id.

    ``(id, base, margin, feature, value, shap)`` sorted by |shap| descending.
    """
    pick = wide.where(predicate).orderBy(id_col).offset(k).limit(1)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(value_prefix + f).alias("value"),
                              F.col(prefix + f).alias("shap")) for f in features])
    return pick.select(id_col, "base", "margin", F.inline(rows)) \
        .orderBy(F.desc(F.abs("shap")), "feature")


# --------------------------------------------------------------- period gap
def period_gap(wide: DataFrame, key: str, up: str, down: str, value_cols: list[str]) -> DataFrame:
    """Two wide rows -> ``(period, up, down, gap)`` with gap = up - down."""
    long = wide.unpivot([key], value_cols, "period", "pct")
    return long.groupBy("period").agg(
        F.max(F.when(F.col(key) == up, F.col("pct"))).alias("up"),
        F.max(F.when(F.col(key) == down, F.col("pct"))).alias("down")) \
        .withColumn("gap", F.col("up") - F.col("down"))


def shap_subset(long: DataFrame, feature: str, value: float) -> DataFrame:
    """SHAP values of one feature on the rows where it equals ``value``."""
    return long.where((F.col("feature") == feature) & (F.col("value") == value))
