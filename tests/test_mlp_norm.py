"""MLP with batch normalisation, averaged and synchronous: numerical gradients, independence of partitions, sequential equality, running statistics."""

import numpy as np
import pytest

from churnlab.operators import mlp, mlp_norm
from churnlab.operators.metrics import roc_auc
from churnlab.operators.mlp import Spec
from churnlab.operators.mlp_norm import Net


def flat(model):
    return np.concatenate([a.ravel() for a in (*model.params, *model.running)])


def data(n=300, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 2, 1][:d] + [0, 3, 0, -1, 0][:d]
    return x, (x[:, 0] + 0.2 * x[:, 1] + 0.5 * rng.normal(size=n) > 0.6).astype(int)


def table(spark, x, y, folds=3):
    cols = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, int(y[i]), i % folds, *map(float, x[i])) for i in range(len(y))],
                                 "id long, y int, fold int, " + ", ".join(f"{c} double" for c in cols)), cols


@pytest.mark.parametrize("net", [Net((4, 6, 3, 1), "tanh", True, 0.3, 0.05), Net((4, 5, 2), "softplus"), Net((4, 5, 4, 1), "softplus", True)])
def test_gradient_follows_the_loss(net):
    rng = np.random.default_rng(3)
    x, y, keys = rng.normal(size=(17, 4)), rng.integers(0, 2, 17), np.arange(17, dtype=np.uint64)
    model = mlp_norm.init_model(net)
    params = [p + 0.3 * rng.normal(size=p.shape) for p in model.params]
    shapes = [p.shape for p in params]

    def split(v):
        return [a.reshape(s) for a, s in zip(np.split(v, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes, strict=True)]

    def loss(v):
        p, h = split(v), x

        def norm(h, g, b):
            return (h - h.mean(0)) / np.sqrt(h.var(0) + net.epsilon) * g + b
        h = norm(h, p.pop(0), p.pop(0)) if net.batch_norm else h
        for i in range(len(net.sizes) - 1):
            h = h @ p.pop(0) + p.pop(0)
            if i < len(net.sizes) - 2:
                h = norm(h, p.pop(0), p.pop(0)) if net.batch_norm else h
                h = np.tanh(h) if net.activation == "tanh" else mlp.softplus(h)
                h = h * mlp_norm._kept(keys, h.shape[1], net.dropout, 5 * 31 + i) if net.dropout else h
        chance = mlp.softmax(h)[:, 1] if h.shape[1] == 2 else 1 / (1 + np.exp(-h[:, 0]))
        t = y * (1 - net.smoothing) + net.smoothing / 2
        return -(t * np.log(chance) + (1 - t) * np.log(1 - chance)).mean()

    at = np.concatenate([p.ravel() for p in params])
    numeric = np.array([(loss(at + e) - loss(at - e)) / 2e-6 for e in np.eye(len(at)) * 1e-6])
    grads, moments = mlp_norm.alone(mlp_norm.gradient(net, model._replace(params=params), x, y, keys, 5))
    np.testing.assert_allclose(np.concatenate([g.ravel() for g in grads]), numeric, atol=2e-6)
    assert len(moments) == (2 * (len(net.sizes) - 1) if net.batch_norm else 0)


NETS = [Net((5, 8, 4, 1), "tanh", True, 0.2, 0.05), Net((5, 6, 6, 2), "softplus")]


@pytest.mark.parametrize("net,optimizer", [(NETS[0], "adam"), (NETS[1], "sgd")])
def test_partitions_do_not_matter_and_equal_sequential_steps(spark, net, optimizer, monkeypatch):
    monkeypatch.setattr(mlp_norm, "TASK_BATCHES", 0.1)
    x, y = data()
    df, cols = table(spark, x, y)
    specs, epochs = [Spec(0.01), Spec(0.05, 1)], 1 if net.batch_norm else 2
    one, four = ([flat(m) for m in mlp_norm.fit(df.repartition(k), cols, "y", "id", net, specs, epochs, 150, optimizer, fold_col="fold", synchronous=True)]
                 for k in (1, 8))
    for a, b in zip(one, four, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)
    keys = np.array([r[0] for r in df.selectExpr("xxhash64(id)").collect()]).astype(np.uint64)
    start = mlp_norm.init_model(net, 1)
    zeros = [np.zeros_like(p) for p in start.params]
    rows = mlp_norm.Rows(x, y, keys, np.arange(len(y)) % 3)
    for spec, found in zip(specs, one, strict=True):
        state = (start, mlp_norm.Optimiser(zeros, zeros, 0.0) if optimizer == "adam" else None)
        for epoch in range(epochs):
            state = mlp_norm.train_epoch(net, state, spec, rows, 2, 1, epoch)
        np.testing.assert_allclose(found, flat(state[0]), atol=1e-9)


@pytest.mark.parametrize("net", NETS)
def test_averaged_tasks(spark, net, monkeypatch):
    monkeypatch.setattr(mlp_norm, "TASK_BATCHES", 1)
    x, y = data()
    df, cols = table(spark, x, y)
    frame = df.repartition(3, "fold").persist()
    model, = mlp_norm.fit(frame, cols, "y", "id", net, [Spec(0.05)], 1, 50, "sgd")
    held = frame.selectExpr("spark_partition_id() p", "id", "xxhash64(id) k").collect()
    start = (mlp_norm.init_model(net, 1), None)
    total, n = 0, 0
    for p in {r.p for r in held}:
        at = np.array([r.id for r in held if r.p == p])
        rows = mlp_norm.Rows(x[at], y[at], np.array([r.k for r in held if r.p == p]).astype(np.uint64), at)
        state = mlp_norm.train_epoch(net, start, Spec(0.05), rows, max(1, round(len(at) / 50)), 1, 0)
        total, n = total + flat(state[0]) * len(at), n + len(at)
    np.testing.assert_allclose(flat(model), total / n, atol=1e-9)


def test_batches_split_the_rows(spark):
    # a step on the whole batch equals the mean of its rows' gradients
    net, (x, y) = NETS[1], data(60)
    keys = np.arange(60, dtype=np.uint64)
    model = mlp_norm.init_model(net)
    state, _ = mlp_norm.train_epoch(net, (model, None), Spec(0.5), mlp_norm.Rows(x, y, keys, keys), 1, 1, 0)
    grads, _ = mlp_norm.alone(mlp_norm.gradient(net, model, x, y, keys))
    for a, b, g in zip(state.params, model.params, grads, strict=True):
        np.testing.assert_allclose(a, b - 0.5 * g, atol=1e-12)


def test_running_statistics_and_learning(spark):
    x, y = data(500)
    df, cols = table(spark, x, y)
    net = Net((5, 12, 6, 1), "tanh", True, 0.1, 0.05, momentum=0.9)
    seen = []
    model, = mlp_norm.fit(df, cols, "y", "id", net, [Spec(0.02)], 12, 64, on_epoch=lambda e, models: seen.append(e) or e == 10)
    assert seen == list(range(1, 11))
    np.testing.assert_allclose(model.running[0], x.mean(axis=0), atol=0.5)
    weights = mlp_norm.folded(net, model)
    scored = mlp.mlp_score(df, weights, cols, "id", keep=["y"], activation="tanh", first_linear=False)
    exact = roc_auc(scored, "score", "y")
    assert exact > 0.9
    found = mlp_norm.auc_per_member(df, cols, "y", net, [model, model], [Spec(1), Spec(1, 2)], "fold")
    assert found[0] == pytest.approx(exact, abs=1e-12)
    assert found[1] == pytest.approx(roc_auc(scored.join(df.select("id", "fold"), "id").where("fold = 2"), "score", "y"), abs=1e-12)
    h, p, r = x, list(model.params), list(model.running)

    def norm(h):
        g, b, mean, variance = p.pop(0), p.pop(0), r.pop(0), r.pop(0)
        return (h - mean) / np.sqrt(variance + net.epsilon) * g + b
    h = norm(h)
    for _ in range(2):
        h = np.tanh(norm(h @ p.pop(0) + p.pop(0)))
    want = 1 / (1 + np.exp(-(h @ p.pop(0) + p.pop(0))[:, 0]))
    got = np.array([row.score for row in scored.orderBy("id").collect()])
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_members_stop_alone_and_empty_tables(spark):
    x, y = data(40)
    df, cols = table(spark, x, y)
    models = mlp_norm.fit(df, cols, "y", "id", NETS[1], [Spec(0.1), Spec(0.1)], 3, optimizer="sgd",
                          on_epoch=lambda e, models: [0] if e == 1 else None)
    assert not np.allclose(flat(models[0]), flat(models[1]))
    scores = iter([{0: 0.5, 1: 0.5}, {0: 0.4, 1: 0.6}, {0: 0.9, 1: 0.7}, {0: 0.9, 1: 0.6}, {1: 0.6}])
    stop = mlp_norm.patience_of(lambda models: next(scores), 2, 2)
    assert [stop(e, models) for e in range(1, 6)] == [[], [], [], [], [0, 1]] and [b[:2] for b in stop.best] == [(3, 0.9), (3, 0.7)]
    model, = mlp_norm.fit(df.limit(0), cols, "y", "id", NETS[0], [Spec(0.1)], 2)
    np.testing.assert_allclose(flat(model), flat(mlp_norm.init_model(NETS[0], 1)))


def test_rows_are_packed_whole_and_in_order(spark):
    df = spark.range(0, 9, 1, 1).selectExpr("id * 3 - 5 AS _key", "CAST(id % 2 AS INT) AS _y", "CAST(id % 4 AS INT) AS _fold", "id * 0.5D AS _x0", "id * 2.0D AS _x1")
    rows = mlp_norm._unpacked(iter([mlp_norm._packed(df, ["_x0", "_x1"]).toPandas()]), 2)
    assert rows.x.tolist() == [[i * 0.5, i * 2.0] for i in range(9)]
    assert rows.y.tolist() == [i % 2 for i in range(9)] and rows.folds.tolist() == [i % 4 for i in range(9)]
    assert rows.keys.astype(np.int64).tolist() == [i * 3 - 5 for i in range(9)]
    assert len(mlp_norm._unpacked(iter([]), 2).y) == 0


@pytest.mark.parametrize("net,optimizer", [(NETS[0], "adam"), (NETS[1], "sgd")])
def test_synchronous_batches_run_in_chains_or_spread(spark, net, optimizer, monkeypatch):
    x, y = data(240)
    df, cols = table(spark, x, y)
    chained, spread, specs, jobs = mlp_norm._chained_epoch, mlp_norm._synchronous_epoch, [Spec(0.01), Spec(0.05, 1)], []

    def fitted(df, batch, cells, way, other):
        monkeypatch.setattr(mlp_norm, "RUN_CELLS", cells)
        monkeypatch.setattr(mlp_norm, way.__name__, lambda *a: jobs.append(a[1]) or way(*a))
        monkeypatch.setattr(mlp_norm, other.__name__, lambda *_: pytest.fail(f"batches of {batch} rows, {cells} cells"))
        return [flat(m) for m in mlp_norm.fit(df, cols, "y", "id", net, specs, 2, batch, optimizer, fold_col="fold", synchronous=True)]

    one = fitted(df.repartition(3), 20, 1 << 22, chained, spread)
    many = fitted(df.repartition(5), 20, 300, chained, spread)
    assert jobs == [1, 1, 4, 4]
    for a, b in zip(one, many, strict=True):
        np.testing.assert_array_equal(a, b)  # not even the order of a batch's rows depends on the partitions
    large = [fitted(df, 120, cells, *ways) for cells, ways in ((1 << 22, (chained, spread)), (300, (spread, chained)))]
    for a, b in zip(*large, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)
    same = df.withColumn("id", df.id * 0)  # one key, so one batch has all rows
    with monkeypatch.context():
        fitted(same, 20, 300, spread, chained) if net is NETS[1] else None


def test_synchronous_odd_tables_leave_no_files(spark):
    import glob

    from churnlab.sources.session import ensure_checkpoint_dir
    x, y = data(40)
    df, cols = table(spark, x, y)
    model, = mlp_norm.fit(df.limit(0), cols, "y", "id", NETS[0], [Spec(0.1)], 2, synchronous=True)
    np.testing.assert_allclose(flat(model), flat(mlp_norm.init_model(NETS[0], 1)))
    seen = []
    models = mlp_norm.fit(df, cols, "y", "id", NETS[1], [Spec(0.1), Spec(0.1)], 3, 16, "sgd", synchronous=True,
                          on_epoch=lambda e, models: seen.append(e) or ([0] if e == 1 else None))
    assert seen == [1, 2, 3] and not np.allclose(flat(models[0]), flat(models[1]))
    with pytest.raises(Exception, match="nulls"):
        mlp_norm.fit(df.selectExpr("id", "nullif(y, 0) AS y", *cols), cols, "y", "id", NETS[1], [Spec(0.1)], 1, synchronous=True)
    assert not glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/rows-*")
