"""TreeSHAP invariants: brute force, additivity, dummy features."""

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import functions as F

from churnlab.operators import boost, shap
from churnlab.operators.boost import Ensemble, Tree


def random_tree(rng, n_features, depth):
    feat, thr, left, right, val, cov = [], [], [], [], [], []

    def grow(d, count):
        i = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1)
        val.append(float(rng.normal())), cov.append(float(count))
        if d < depth:
            feat[i] = int(rng.integers(n_features))
            thr[i] = float(rng.normal())
            lc = int(rng.integers(1, count)) if count > 1 else 0
            left[i] = grow(d + 1, max(lc, 1))
            right[i] = grow(d + 1, max(count - lc, 1))
            cov[i] = cov[left[i]] + cov[right[i]]
        return i

    grow(0, 100)
    return Tree(feat, thr, left, right, val, cov)


def cond_expectation(tree, x, known):
    def node(n):
        if tree.is_leaf(n):
            return tree.value[n]
        l, r = tree.left[n], tree.right[n]
        if tree.feature[n] in known:
            return node(l) if x[tree.feature[n]] <= tree.threshold[n] else node(r)
        return (tree.cover[l] * node(l) + tree.cover[r] * node(r)) / (tree.cover[l] + tree.cover[r])
    return node(0)


def brute_force(ens, x, n_features):
    phi = np.zeros(n_features)
    for tree in ens.trees:
        for j in range(n_features):
            others = [k for k in range(n_features) if k != j]
            for s in range(n_features):
                w = factorial(s) * factorial(n_features - 1 - s) / factorial(n_features)
                for sub in combinations(others, s):
                    phi[j] += w * (cond_expectation(tree, x, set(sub) | {j})
                                   - cond_expectation(tree, x, set(sub)))
    return phi


def test_matches_brute_force_and_additivity():
    rng = np.random.default_rng(3)
    d = 4
    ens = Ensemble([random_tree(rng, d, 3) for _ in range(3)], [f"f{i}" for i in range(d)], 0.25)
    x = rng.normal(size=(25, d))
    phi = shap.shap_matrix(x, shap.leaf_paths(ens), d)
    for i in range(len(x)):
        np.testing.assert_allclose(phi[i], brute_force(ens, x[i], d), atol=1e-10)
    margin = np.array([ens.base + sum(cond_expectation(t, r, set(range(d))) for t in ens.trees)
                       for r in x])
    np.testing.assert_allclose(boost.expected_value(ens) + phi.sum(axis=1), margin, atol=1e-9)


def test_deep_tree_matches_brute_force():
    rng = np.random.default_rng(8)
    ens = Ensemble([random_tree(rng, 6, 10)], [f"f{i}" for i in range(6)], 0.0)
    x = rng.normal(size=(2, 6))
    phi = shap.shap_matrix(x, shap.leaf_paths(ens), 6)
    for i in range(len(x)):
        np.testing.assert_allclose(phi[i], brute_force(ens, x[i], 6), atol=1e-10)


def test_unused_feature_is_exactly_zero():
    rng = np.random.default_rng(5)
    ens = Ensemble([random_tree(rng, 2, 3)], ["a", "b", "c"], 0.0)
    phi = shap.shap_matrix(rng.normal(size=(10, 3)), shap.leaf_paths(ens), 3)
    assert np.all(phi[:, 2] == 0.0)


def test_trained_gbt_additivity(spark):
    from churnlab.plans import flows
    from .conftest import SF_SMALL
    data, model, feats = flows.trained_gbt(spark, SF_SMALL, maxIter=3, maxDepth=3)
    ens = boost.ensemble_from_spark(model, feats)
    test = data.where(F.col("split") == "test")
    spark_p = {r["user_id"]: r["score"] for r in boost.score(model, test, "user_id").collect()}
    for r in shap.tree_shap(test, ens, "user_id").collect():
        shap_sum = r["base"] + sum(r[f"shap_{f}"] for f in feats)
        assert abs(shap_sum - r["margin"]) < 1e-9
        assert abs(1 / (1 + np.exp(-r["margin"])) - spark_p[r["user_id"]]) < 1e-9


def test_tree_values_match_recursive_walk():
    rng = np.random.default_rng(9)
    d = 3
    ens = Ensemble([random_tree(rng, d, 4) for _ in range(4)], [f"f{i}" for i in range(d)], 0.1)
    x = rng.normal(size=(50, d))
    vals = boost.tree_values(ens, x)
    for i in range(len(x)):
        for t, tree in enumerate(ens.trees):
            assert vals[i, t] == cond_expectation(tree, x[i], set(range(d)))


def test_gbt_fit_best_flow(spark):
    from churnlab.plans import flows
    from .conftest import SF_SMALL
    r = flows.gbt_fit_best(spark, SF_SMALL, step_sizes=(0.1,), max_depths=(2, 3), folds=3,
                           maxIter=2, seed=42).first()
    assert r["max_depth"] in (2, 3) and 0.0 <= r["auc"] <= 1.0
    assert r["tp"] + r["fp"] + r["tn"] + r["fn"] > 0


def test_gbt_fit_reads_stored_rows_and_leaves_none(spark, monkeypatch):
    import glob

    from churnlab.sources.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    df = spark.range(0, 200, 1, 2).selectExpr("id", "id % 7 * 1.0D AS a", "id % 11 * 1.0D AS b", "IF(id % 7 > 3, 1, 0) AS y")
    seen, fit = [], boost.Pipeline.fit
    monkeypatch.setattr(boost.Pipeline, "fit", lambda self, rows: seen.append(rows.inputFiles()) or fit(self, rows))
    model = boost.gbt_fit(df, ["a", "b"], "y", maxIter=2, maxDepth=2, seed=1)
    assert seen[0] and all("/rows-" in f for f in seen[0])  # no step before the fit is in its tasks
    assert not glob.glob(f"{folder}/rows-*")
    wrong = boost.score(model, df, "id", ["y"]).where("prediction != y").count()
    assert wrong == 0
