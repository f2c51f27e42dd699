"""MLP: numerical gradients, sequential equality, independence of Arrow batches."""

import numpy as np
import pytest

from churnlab.operators import mlp


def frame(spark, x, y, parts=1):
    cols = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(len(y))],
                               "id long, y int, " + ", ".join(f"{c} double" for c in cols))
    return df.coalesce(parts).persist(), cols


@pytest.mark.parametrize("hidden,act,linear", [(4, "softplus", True), ([5, 3], "tanh", False)])
def test_step_follows_the_numerical_gradient(hidden, act, linear):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(12, 3)), rng.integers(0, 2, 12)
    ws = mlp.init_weights(3, hidden, 2, seed=2)

    def loss(vec):
        h = mlp.forward(x, mlp.unflatten(vec, mlp.shapes_of(ws)), act, None, linear)[1][-1]
        return -np.log(h[np.arange(len(y)), y]).mean()

    at = mlp.flatten(ws)
    numeric = np.array([(loss(at + e) - loss(at - e)) / 2e-6 for e in np.eye(len(at)) * 1e-6])
    step = mlp.flatten(mlp.sgd_step(ws, x, y, 1.0, act, "identity", first_linear=linear))
    np.testing.assert_allclose(at - step, numeric, atol=1e-6)


def test_one_partition_equals_sequential_steps(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0).astype(int)
    init = mlp.init_weights(5, 6, 2, seed=3)
    df, cols = frame(spark, x, y)
    got = mlp.mlp_fit(df, cols, "y", hidden=6, epochs=2, lr=0.05, init=init)
    want = init
    for _ in range(2):
        order = np.arange(300)
        np.random.RandomState(1).shuffle(order)
        for s in range(0, 300, 128):
            want = mlp.sgd_step(want, x[order[s:s + 128]], y[order[s:s + 128]], 0.05, "softplus", "identity")
    for (gw, gb), (ww, wb) in zip(got, want):
        np.testing.assert_allclose(gw, ww, atol=1e-10)
        np.testing.assert_allclose(gb, wb, atol=1e-10)


def test_weights_do_not_depend_on_arrow_batches(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] > 0).astype(int)
    df, cols = frame(spark, x, y)
    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    try:
        for size in ("10000", "70"):
            spark.conf.set(key, size)
            found.append(mlp.flatten(mlp.mlp_fit(df, cols, "y", hidden=4, epochs=2, lr=0.05)))
    finally:
        spark.conf.set(key, before)
    np.testing.assert_allclose(found[0], found[1], atol=1e-12)


def test_softplus_threshold():
    v = mlp.softplus(np.array([-5.0, 0.0, 19.9, 20.0, 50.0]))
    assert v[3] == 20.0 and v[4] == 50.0
    assert abs(v[1] - np.log(2)) < 1e-15


def test_adam_dropout_learns(spark):
    from churnlab.operators import metrics
    rng = np.random.default_rng(1)
    n, d = 400, 4
    x = rng.normal(size=(n, d))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    cols = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)],
                               "id long, y int, " + ", ".join(f"{c} double" for c in cols)).persist()
    ws = mlp.mlp_fit(df, cols, "y", hidden=8, epochs=8, lr=0.01, optimizer="adam", dropout=0.1,
                     activation="tanh", smoothing=0.05)
    s = mlp.mlp_score(df, ws, cols, "id", keep=["y"], activation="tanh")
    assert metrics.roc_auc(s, "score", "y") > 0.9


def test_rows_are_packed_once_for_all_epochs(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf.assign(x=pdf["id"] / 7.0, y=pdf["id"] % 2)[["x", "y"]]

    df = spark.range(0, 300, 1, 2).mapInPandas(rows, "x double, y long")
    mlp.mlp_fit(df, ["x"], "y", hidden=3, epochs=3)
    assert made.value == 300


def test_packed_rows_hold_each_chunk_in_order(spark):
    df = spark.range(0, 10, 1, 1).selectExpr("id * 0.5D AS a", "id * 2.0D AS b", "id % 2 AS y", "IF(id = 3, NULL, id % 5) AS fold")
    row, = mlp._packed(df, ["a", "b"], "y", "fold").collect()
    assert np.frombuffer(row["x"]).reshape(-1, 2).tolist() == [[i * 0.5, i * 2.0] for i in range(10)]
    assert np.frombuffer(row["y"], np.int64).tolist() == [i % 2 for i in range(10)]
    folds = np.frombuffer(row["folds"])
    assert np.isnan(folds[3]) and [f for f in folds if f == f] == [i % 5 for i in range(10) if i != 3]
