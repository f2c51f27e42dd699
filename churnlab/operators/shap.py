"""Path-dependent TreeSHAP on Spark (M16) and the long SHAP table.

Algorithm (Lundberg et al. 2018, in its leaf-path form).  For a leaf with
value v whose path uses the distinct features F (repeated splits on one
feature merged), let z_j be the product of cover ratios of the path edges
on feature j and o_j(x) = 1 when x satisfies all of them.  The cover-weighted
conditional expectation restricted to that leaf is a product game
g(S) = prod_j (o_j if j in S else z_j), whose Shapley value is

    phi_j = v * (o_j - z_j) * sum_s w(s, m) * c_s,   w(s, m) = s! (m-1-s)! / m!

with c_s the coefficient of t^s in prod_{k != j} (z_k + o_k t).  As
w(s, m) is the integral of t^s (1 - t)^(m-1-s) over [0, 1], the sum is the
integral of prod_{k != j} (z_k (1 - t) + o_k t), a polynomial of degree m - 1,
which Gauss-Legendre nodes integrate exactly.  Products that leave one factor
out come from running products of both sides.  Summing over leaves and trees
gives exact path-dependent TreeSHAP values; base value + sum(phi) equals the
margin for every row.

Execution: ``mapInPandas`` over Arrow batches, the ensemble shipped once per
executor as a broadcast variable (its size is bounded by the model).  Cost
per row is the sum over leaves of m^2 / 2.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .boost import Ensemble, expected_value


def _ratio(child: float, parent: float) -> float:
    return child / parent if parent > 0 else 0.5


def leaf_paths(ens: Ensemble) -> list[tuple[float, list[tuple[int, float, list[tuple[float, bool]]]]]]:
    """Per leaf: (value, [(feature, z, [(threshold, goes_left), ...]), ...])."""
    out = []
    for tree in ens.trees:
        def walk(n, feats):
            if tree.is_leaf(n):
                out.append((tree.value[n], [(f, z, conds) for f, (z, conds) in feats.items()]))
                return
            f, thr = tree.feature[n], tree.threshold[n]
            for child, left in ((tree.left[n], True), (tree.right[n], False)):
                z0, conds = feats.get(f, (1.0, []))
                nxt = dict(feats)
                nxt[f] = (z0 * _ratio(tree.cover[child], tree.cover[n]), conds + [(thr, left)])
                walk(child, nxt)
        walk(0, {})
    return out


def _without_one(factors: np.ndarray) -> np.ndarray:
    """Along the first axis, the product of all factors but each one."""
    out = np.ones_like(factors)
    np.multiply.accumulate(factors[:-1], axis=0, out=out[1:])
    after = np.ones_like(factors[0])
    for j in range(len(factors) - 2, -1, -1):
        after = after * factors[j + 1]
        out[j] *= after
    return out


def shap_matrix(x: np.ndarray, paths, n_features: int) -> np.ndarray:
    """SHAP values (rows x features) for a dense float matrix."""
    n = x.shape[0]
    phi = np.zeros((n, n_features))
    nodes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held: dict[tuple, np.ndarray] = {}

    def holds(f: int, thr: float, left: bool) -> np.ndarray:
        key = (f, thr, left)
        if key not in held:
            held[key] = (x[:, f] <= thr) if left else (x[:, f] > thr)
        return held[key]

    for value, feats in paths:
        m = len(feats)
        if m == 0 or value == 0.0:
            continue
        if m not in nodes:
            at, weight = np.polynomial.legendre.leggauss((m + 1) // 2)
            nodes[m] = ((at + 1) / 2, weight / 2)
        t, weight = nodes[m]
        ones = np.empty((m, n))
        zs = np.array([z for _, z, _ in feats])
        for i, (f, _, conds) in enumerate(feats):
            ones[i] = np.logical_and.reduce([holds(f, thr, left) for thr, left in conds])
        factors = zs[:, None, None] * (1 - t)[None, :, None] + ones[:, None, :] * t[None, :, None]
        total = np.einsum("q,mqn->mn", weight, _without_one(factors))
        part = value * (ones - zs[:, None]) * total
        for i, (f, _, _) in enumerate(feats):
            phi[:, f] += part[i]
    return phi


def tree_shap(df: DataFrame, ens: Ensemble, id_col: str, keep: list[str] = (),
              prefix: str = "shap_", value_prefix: str = "x_") -> DataFrame:
    """Wide SHAP table ``id, keep..., base, margin, x_<f>..., shap_<f>...`` (log-odds).

    Features are read from the columns named in ``ens.features`` (fill missing
    values first: the trees were grown on filled data).  Feature values ride
    along as ``x_<f>`` so reports and case filters need no join back.
    """
    spark = df.sparkSession
    paths = leaf_paths(ens)
    base = expected_value(ens)
    feats = list(ens.features)
    keep = [c for c in keep if c != id_col and c not in feats]
    bc = spark.sparkContext.broadcast((paths, base, feats))
    schema = StructType([df.schema[id_col]] + [df.schema[c] for c in keep]
                        + [StructField("base", DoubleType()), StructField("margin", DoubleType())]
                        + [StructField(value_prefix + f, DoubleType()) for f in feats]
                        + [StructField(prefix + f, DoubleType()) for f in feats])

    def run(batches):
        p, b, fs = bc.value
        for pdf in batches:
            x = pdf[fs].to_numpy(dtype=float)
            phi = shap_matrix(x, p, len(fs))
            cols = {id_col: pdf[id_col].to_numpy()}
            for c in keep:
                cols[c] = pdf[c].to_numpy()
            cols["base"] = np.full(len(pdf), b)
            cols["margin"] = b + phi.sum(axis=1)
            for i, f in enumerate(fs):
                cols[value_prefix + f] = x[:, i]
            for i, f in enumerate(fs):
                cols[prefix + f] = phi[:, i]
            yield pd.DataFrame(cols)

    return df.select(id_col, *keep, *feats).mapInPandas(run, schema)


def shap_long(shap_wide: DataFrame, id_col: str, features: list[str], prefix: str = "shap_",
              value_prefix: str = "x_", keep: list[str] = ()) -> DataFrame:
    """Long table ``(id, keep..., base, feature, value, shap)`` by ``inline`` - no join."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"),
                              F.col(value_prefix + f).alias("value"),
                              F.col(prefix + f).alias("shap")) for f in features])
    return shap_wide.select(id_col, *keep, "base", F.inline(rows))
