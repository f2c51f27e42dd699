"""Preparation operators.

All are DataFrame-in / DataFrame-out and stay JVM-side.  The only driver
round trips are bounded: category lists for one-hot (checked against a
limit) and per-column statistics (one number per column).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.cumulative import materialize
from ..functions.vectors import sum_arrays


def encode_flags(df: DataFrame, mapping: dict[str, str], yes: str = "Y", no: str = "N",
                 drop_source: bool = False) -> DataFrame:
    """Y/N flags to 1/0; any other value (including null) becomes null."""
    out = df
    for src, dst in mapping.items():
        c = F.col(src)
        out = out.withColumn(dst, F.when(c == yes, F.lit(1)).when(c == no, F.lit(0)))
    if drop_source:
        out = out.drop(*[s for s, d in mapping.items() if s != d])
    return out


def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """Columns with a numeric type, in schema order (P10)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def fill_missing(df: DataFrame, value: float = -1, cols: list[str] | None = None) -> DataFrame:
    """Replace null and NaN in numeric columns by a constant (P5).

    String columns keep their nulls (one-hot turns those into all-zero rows).
    """
    cols = numeric_columns(df) if cols is None else cols
    return df.na.fill(value, subset=cols) if cols else df


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast with ``try_cast`` semantics: bad values become null, never raise."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def split_xy(df: DataFrame, id_col: str, label_col: str, feature_cols: list[str]) -> DataFrame:
    """Named id / features / label projection instead of positional slicing."""
    return df.select(id_col, *feature_cols, label_col)


def dummy_name(col: str, value: str) -> str:
    """``<col>_<value>``; dots and backticks, which Spark reads as part of a path, become ``_``."""
    return f"{col}_{value}".replace(".", "_").replace("`", "_")


def _categories(df: DataFrame, cols: list[str], most: int) -> dict[str, list]:
    """The values of each column but null, from one pass; more than ``most`` of a column raise.

    One row beyond ``most`` for each column is enough to see that some column has too many.
    """
    out: dict[str, list] = {c: [] for c in cols}
    kinds: dict = {}
    for i, c in enumerate(dict.fromkeys(cols)):
        kinds.setdefault(df.select(c).schema[0].dataType, []).append((i, c))
    for named in kinds.values():  # columns of one type share a pass
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in named])
        found = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct().limit(most * len(named) + 1).collect()
        for i, c in named:
            out[c] = [r["v"] for r in found if r["i"] == i]
            if len(out[c]) > most:
                raise ValueError(f"{c}: more than {most} categories")
    return out


def one_hot(df: DataFrame, cols: list[str] | None = None, max_categories: int = 1000,
            drop_source: bool = True, categories: dict[str, list[str]] | None = None,
            fill: str | None = None) -> DataFrame:
    """Named one-hot columns ``<col>_<value>`` as 0/1 integers.

    ``categories`` gives a column's values; others are listed by one distinct
    job for all columns, of which at most ``max_categories`` rows per column and
    one more reach the driver (a column with more values is an id, not a
    category, and raises).
    Null maps to all zeros, or with ``fill`` to the category of that name
    (fill before one-hot, P5).  Dummy columns follow the remaining columns,
    sorted by value; two values of a column must not share a name.
    """
    cols = string_columns(df) if cols is None else cols
    source = df.na.fill(fill, subset=cols) if fill is not None and cols else df
    categories = dict(categories or {})
    categories |= _categories(source, [c for c in cols if categories.get(c) is None], max_categories)
    dummies = []
    for c in cols:
        values = categories[c]
        names = [dummy_name(c, v) for v in values]
        if len(set(names)) < len(names):
            raise ValueError(f"{c}: two categories have one column name")
        for v in sorted(values):
            dummies.append(F.when(F.col(c) == v, 1).otherwise(0).alias(dummy_name(c, v)))
    df = source
    keep = [x for x in df.columns if not (drop_source and x in cols)]
    return df.select(*keep, *dummies)


def dedup(df: DataFrame, key: str | list[str], order_by: list[str]) -> DataFrame:
    """Keep one row per key: the greatest by ``order_by``, ties by the other columns.

    Implemented as ``groupBy(key).agg(max(struct(order_by..., rest...)))``:
    the struct max is combined map-side, so a key holding a large share of the
    rows is reduced inside every map task instead of landing whole in one
    task, and the winner is deterministic (unlike ``dropDuplicates``).
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    best = F.max(F.struct(*order_by, *rest)).alias("_best")
    return (df.groupBy(*keys).agg(best)
            .select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order_by + rest])
            .select(*df.columns))


def _present(df: DataFrame, c: str):
    """The column with NaN read as null."""
    col = df[f"`{c}`"]
    return F.when(~F.isnan(col), col) if df.schema[c].dataType.typeName() in ("double", "float") else col


def column_stats(df: DataFrame, cols: list[str], ddof: int = 0) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation per column in one aggregate (A4); nulls and NaN ignored."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(_present(df, c)).alias(f"m{i}"), std(_present(df, c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: list[str], ddof: int = 0, fit_on: DataFrame | None = None,
                stats: dict | None = None, suffix: str = "") -> DataFrame:
    """Z-score columns with statistics fitted on ``fit_on`` (default ``df``) (M2).

    ``ddof=0`` divides by the population std (the single-machine scripts),
    ``ddof=1`` by the sample std (Spark's ``StandardScaler``).  Nulls stay
    null, NaN becomes null, and a zero std maps to 0.  The fitted statistics become literals, so
    the transform is a plain projection inside whole-stage codegen.
    """
    stats = stats or column_stats(fit_on if fit_on is not None else df, cols, ddof)
    exprs = {}
    for c in cols:
        mean, sd = stats[c]
        if mean is None:
            exprs[c + suffix] = F.lit(None).cast("double")
        elif not sd:
            exprs[c + suffix] = F.when(_present(df, c).isNotNull(), F.lit(0.0))
        else:
            exprs[c + suffix] = (_present(df, c) - F.lit(mean)) / F.lit(sd)
    return df.withColumns(exprs)


#: Doubles that a task holds of the pair sums at a time (64 MB), and that one row carries.
PASS_DOUBLES, BLOCK_DOUBLES = 1 << 23, 1 << 17


def _pair_sums(data: DataFrame, cols: list[str], shift: list[float], lo: int, hi: int, block: int) -> DataFrame:
    """(block, sums): pairwise-complete sums of the columns ``lo`` to ``hi`` with all columns, ``block`` columns in a row.

    With X the mean-shifted values, M the presence mask, B the block's columns: the counts
    M_B'M, the sums X_B'M and M_B'X, the squares (X*X)_B'M and M_B'(X*X), the products X_B'X.
    """
    import numpy as np
    import pyarrow as pa

    bc = data.sparkSession.sparkContext.broadcast(np.asarray(shift, dtype=float))

    def run(batches):
        total = np.zeros((6, hi - lo, len(cols)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - bc.value
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            xb, mb = x[:, lo:hi], m[:, lo:hi]
            for i, (left, right) in enumerate(((mb, m), (xb, m), (mb, x), (xb * xb, m), (mb, x * x), (xb, x))):
                total[i] += left.T @ right
        rows = [total[:, a:a + block].ravel() for a in range(0, hi - lo, block)]
        yield pa.RecordBatch.from_arrays([pa.array([lo + a for a in range(0, hi - lo, block)], pa.int32()),
                                          pa.array(rows, pa.list_(pa.float64()))], names=["block", "sums"])

    rows = data.select(*[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    return sum_arrays(rows.mapInArrow(run, "block int, sums array<double>"), ["block"], "sums")


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlations as the D x D long table ``(feature_a, feature_b, corr)`` (A3).

    Pairwise-complete: each pair uses the rows where both are present, like pandas ``corr``.
    A pair with fewer than 2 rows, or with a constant column, is NULL, on the diagonal too.

    One pass over mean-shifted values adds up the sums of all pairs.  They travel and are
    added as whole blocks of columns (about a megabyte a row), and each block's correlations
    are made where it ends up, so neither a task, the driver nor the shuffle holds rows for
    single pairs.  With very many columns (over about 1,100) the blocks take several passes,
    so that a task holds at most 64 MB of sums.
    """
    import numpy as np
    import pyarrow as pa

    d = len(cols)
    schema = "feature_a string, feature_b string, corr double"
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    data = df.select(*cols).persist()
    try:
        stats = data.agg(*[F.avg(_present(data, c)).alias(f"m{i}") for i, c in enumerate(cols)],
                         *[F.min(_present(data, c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                         *[F.max(_present(data, c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
        varied = np.array([stats[f"lo{i}"] != stats[f"hi{i}"] for i in range(d)])
        shift = [stats[f"m{i}"] or 0.0 for i in range(d)]
        block = max(1, BLOCK_DOUBLES // (6 * d))
        step = max(block, PASS_DOUBLES // (6 * d) // block * block)

        def run(batches):
            for batch in batches:
                for lo, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    n, xa, xb, xxa, xxb, xy = sums.values.to_numpy().reshape(6, -1, d)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        va, vb = n * xxa - xa ** 2, n * xxb - xb ** 2
                        corr = np.clip((n * xy - xa * xb) / np.sqrt(va * vb), -1.0, 1.0)
                    own = np.arange(lo, lo + len(n))
                    known = (n >= 2) & (va > 0) & (vb > 0) & varied[own][:, None] & varied
                    corr[np.arange(len(n)), own] = 1.0
                    corr = np.where(known, corr, np.nan)
                    for i, a in enumerate(own):
                        yield pa.RecordBatch.from_arrays([pa.array([cols[a]] * d), pa.array(cols), pa.array(corr[i], from_pandas=True)],
                                                         names=["feature_a", "feature_b", "corr"])

        parts = [_pair_sums(data, cols, shift, lo, min(d, lo + step), block) for lo in range(0, d, step)]
        return materialize(reduce(DataFrame.union, parts).mapInArrow(run, schema))
    finally:
        data.unpersist()
