"""Grid boosting against a plain booster on the same bins, and its invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.operators import grid_boost as gb
from churnlab.operators.boost import tree_values
from churnlab.operators.metrics import roc_auc

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = []
    for i in range(600):
        x = [r.randint(0, 9), round(r.gauss(0, 1), 2), r.choice([0, 1]), r.random()]
        y = int(r.random() < 1 / (1 + math.exp(-(x[0] - 5) * (1 if x[2] else -0.4) - x[1])))
        out.append((i, y, i % 3, *map(float, x)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double, d double").repartition(5).persist()


def plain(rows, keys, edges, s, holdout):
    """A sequential best-first booster: (trees as nested tuples, margins)."""
    use = np.array([r[2] != holdout for r in rows])
    y = np.array([r[1] for r in rows])
    bins = np.array([[np.searchsorted(e, v, side="left") for e, v in zip(edges, r[3:], strict=True)] for r in rows])
    width = max(map(len, edges)) + 1
    pos = int(y[use].sum())
    margin = np.full(len(rows), math.log(pos / (use.sum() - pos)))
    trees = []
    for t in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v * gb.UNIT).astype(np.int64) for v in (p - y, p * (1 - p)))
        bag = use & gb.in_bag(keys, s, t)
        drawn = gb.drawn_features(len(edges), s, t)

        def search(at):
            found = None
            total = [int(v[at].sum()) for v in (g, h)]
            for f in drawn:
                for b in range(width - 1):
                    left = at[bins[at, f] <= b]
                    hl, gl = int(h[left].sum()), int(g[left].sum())
                    if min(len(left), len(at) - len(left)) < s.min_rows or min(hl, total[1] - hl) < s.min_hessian * gb.UNIT:
                        continue
                    part = [(x / gb.UNIT) ** 2 / (z / gb.UNIT + s.l2) for x, z in ((gl, hl), (total[0] - gl, total[1] - hl), total)]
                    gain = part[0] + part[1] - part[2]
                    if gain > gb.MIN_GAIN and (found is None or gain > found[0]):
                        found = (gain, int(f), b)
            return found

        leaves = [(np.flatnonzero(bag), 0, [])]
        splits = []
        while len(leaves) < s.num_leaves:
            options = [(search(at), i) for i, (at, depth, _) in enumerate(leaves) if s.max_depth is None or depth < s.max_depth]
            options = [(o, i) for o, i in options if o]
            if not options:
                break
            (gain, f, b), i = max(options, key=lambda o: (o[0][0], -o[1]))
            at, depth, path = leaves.pop(i)
            splits.append((tuple(path), f, b, len(at)))
            low = bins[at, f] <= b
            leaves += [(at[low], depth + 1, [*path, (f, b, True)]), (at[~low], depth + 1, [*path, (f, b, False)])]
        if not splits:
            break
        for at, _, path in leaves:
            inside = np.ones(len(rows), dtype=bool)
            for f, b, low in path:
                inside &= (bins[:, f] <= b) == low
            margin[inside] -= s.step_size * (g[at].sum() / gb.UNIT) / (h[at].sum() / gb.UNIT + s.l2)
        trees.append(splits)
    return trees, margin


SETTINGS = [
    gb.Setting(0.3, None, 6, rounds=7, min_rows=10), gb.Setting(0.1, 2, 4, rounds=7, min_rows=5, feature_fraction=0.5, bagging_fraction=0.6, bagging_freq=2),
    gb.Setting(0.2, 1, 2, rounds=7, bagging_fraction=1.0, feature_fraction=1.0, l2=1.0), gb.Setting(0.2, 3, 8, rounds=7, min_rows=1, seed=7),
]


def test_trees_equal_those_of_a_plain_booster(spark, rows, table):
    edges = gb.bin_edges(table, FEATURES, 20)
    keys = {r.id: r.k for r in table.select("id", F.xxhash64("id").alias("k")).collect()}
    keys = np.array([keys[r[0]] for r in rows])
    members = [gb.Member(s, f) for s in SETTINGS for f in (None, 1)]
    members = [m._replace(setting=gb.Setting(**{**vars(m.setting), "patience": 99})) for m in members]
    found = gb.grow(table, FEATURES, "y", members, "id", "fold", edges=edges)
    x = np.array([r[3:] for r in rows])
    for m, g in zip(members, found, strict=True):
        trees, margin = plain(rows, keys, edges, m.setting, m.holdout)
        grown = g.ensemble.trees if m.holdout is None else None
        if grown is not None:
            assert len(grown) == len(trees)
            assert np.abs(g.ensemble.base + tree_values(g.ensemble, x).sum(axis=1) - margin).max() < 1e-9
            for tree, splits in zip(grown, trees, strict=True):
                inner = sorted((tree.feature[i], tree.cover[i]) for i in range(len(tree.feature)) if tree.feature[i] >= 0)
                assert inner == sorted((f, float(n)) for _, f, _, n in splits)
                assert sum(f < 0 for f in tree.feature) <= m.setting.num_leaves
        else:
            assert len(g.curve) == len(trees) and not g.stopped
            held = [r[2] == m.holdout for r in rows]
            order = sorted(zip(margin[held], [r[1] for r, k in zip(rows, held, strict=True) if k], strict=True))
            above = sum((a > b) + 0.5 * (a == b) for a, u in order if u for b, v in order if not v)
            positives = sum(u for _, u in order)
            assert g.curve[-1] == pytest.approx(above / (positives * (len(order) - positives)), abs=1e-9)
            assert g.curve[g.best_round - 1] == max(g.curve) and len(g.ensemble.trees) == g.best_round


def test_result_does_not_depend_on_the_partitions(table, monkeypatch):
    monkeypatch.setattr(gb, "TASK_ROWS", 100)
    members = [gb.Member(SETTINGS[0], 0), gb.Member(SETTINGS[1], 2)]
    one, many = (gb.grow(df, FEATURES, "y", members, "id", "fold") for df in (table.coalesce(1), table.repartition(7)))
    assert [(g.curve, g.ensemble) for g in one] == [(g.curve, g.ensemble) for g in many]


def test_patience_ends_a_member_and_auc_is_exact(spark, table):
    found = gb.cv_grid(table, FEATURES, "y", "id", "fold", 3, [gb.Setting(0.5, None, 12, rounds=60, patience=4, min_rows=5), gb.Setting(0.3, 1, 2, rounds=3)])
    rows = found.orderBy("grid_index", "fold").collect()
    assert [(r.grid_index, r.fold) for r in rows] == [(i, f) for i in range(2) for f in range(3)]
    assert all(r.stopped and r.trained == r.rounds + 4 for r in rows[:3]) and all(r.trained == 3 and not r.stopped for r in rows[3:])
    g = gb.grow(table, FEATURES, "y", [gb.Member(gb.Setting(0.2, 3, 6, rounds=10), 1)], "id", "fold")[0]
    scored = table.where("fold = 1").select("y", g.ensemble.prob_expr().alias("score"))
    assert roc_auc(scored, "score", "y") == pytest.approx(g.curve[g.best_round - 1], abs=1e-12)


def test_odd_tables(spark, table):
    member = [gb.Member(gb.Setting(rounds=3, min_rows=1))]
    for rows in ([], [(1, 0, 0, 1.0, 1.0, 1.0, 1.0)], [(i, 1, 0, float(i), 1.0, 1.0, 1.0) for i in range(9)], [(i, i % 2, 0, 1.0, 1.0, 1.0, 1.0) for i in range(9)]):
        df = spark.createDataFrame(rows, table.schema)
        assert gb.grow(df, FEATURES, "y", member, "id")[0].ensemble.trees == [] or rows and rows[0][1]
    with pytest.raises(Exception, match="fill missing"):
        gb.grow(table.withColumn("a", F.when(F.col("id") == 3, None).otherwise(F.col("a"))), FEATURES, "y", member, "id")


def test_leaf_budgets():
    assert [gb.leaves_for(d) for d in (2, 5, None)] == [2, 12, 31] and len(gb.grid()) == 9
    s = gb.Setting(feature_fraction=0.9)
    draws = {tuple(gb.drawn_features(10, s, t)) for t in range(50)}
    assert all(len(x) == 9 for x in draws) and len(draws) == 10
    keys = np.arange(1000)
    assert (gb.in_bag(keys, s, 0) == gb.in_bag(keys, s, 4)).all() and (gb.in_bag(keys, s, 0) != gb.in_bag(keys, s, 5)).any()
    assert 0.75 < gb.in_bag(keys, s, 0).mean() < 0.85


def test_a_pass_asks_for_no_more_nodes_than_the_leaf_budget_allows(spark, monkeypatch):
    asked, passes = [], gb._pass

    def seen(state, tasks, *rest):
        asked.extend(len(t.nodes) for t in tasks)
        return passes(state, tasks, *rest)

    x = [F.rand(i).alias(f) for i, f in enumerate(FEATURES)]
    df = spark.range(0, 4000, 1, 2).select("id", *x).withColumn("y", F.expr("cast(sin(40 * a) + sin(30 * b) + sin(20 * c) * d > 0.3 as int)"))
    monkeypatch.setattr(gb, "_pass", seen)
    member = [gb.Member(gb.Setting(0.5, num_leaves=8, rounds=2, min_rows=2, bagging_fraction=1.0))]
    bounded = gb.grow(df, FEATURES, "y", member, "id")[0].ensemble
    assert max(asked) <= gb.AHEAD * 8
    monkeypatch.setattr(gb, "AHEAD", 1000)
    asked.clear()
    assert gb.grow(df, FEATURES, "y", member, "id")[0].ensemble == bounded and max(asked) > 16


def test_histograms_have_only_the_bins_of_each_feature():
    rng = np.random.default_rng(3)
    bins = np.column_stack([rng.integers(0, 2, 60), rng.integers(0, 9, 60)]).astype(np.uint8)
    rows = gb._Rows(np.arange(60), rng.integers(0, 2, 60).astype(np.uint8), np.zeros(60, np.int32), bins, np.zeros((1, 60)))
    grown = gb._Growth(gb.Setting(bagging_fraction=1.0, min_rows=1))
    grown.add(0, gb.Split(0, 0, 60, 1, 4, 1.0, 0, 0, int((bins[:, 1] <= 4).sum())))
    task = gb._Task(0, grown.setting, None, 0, [], grown.partial(), [1, 2], False)
    g, h, n = gb._histograms(rows, rows.margins[0], task, [2, 9])
    assert n.shape == (2, 11)
    for i, side in enumerate((bins[:, 1] <= 4, bins[:, 1] > 4)):
        for start, f, width in ((0, 0, 2), (2, 1, 9)):
            for b in range(width):
                here = side & (bins[:, f] == b)
                assert n[i, start + b] == here.sum() and h[i, start + b] == here.sum() * gb.UNIT / 4
                assert g[i, start + b] == (0.5 - rows.y[here]).sum() * gb.UNIT


def test_whole_members_equal_those_of_the_passes(table, monkeypatch):
    settings = [SETTINGS[1], gb.Setting(0.9, None, 12, rounds=8, patience=2, min_rows=5), gb.Setting(0.1, 2, 2, rounds=3, min_rows=400)]
    members = [gb.Member(s, f) for s in settings for f in (None, 1, 9)]  # nothing is held out in fold 9
    passes = gb.grow(table, FEATURES, "y", members, "id", "fold")
    monkeypatch.setattr(gb, "_pass", lambda *_: pytest.fail("a job for a level"))
    whole = gb.grow(table.repartition(3), FEATURES, "y", members, "id", "fold", whole=True)
    assert any(g.stopped for g in whole) and any(g.ensemble.trees for g in whole) and any(not g.curve for g in whole)
    assert passes == whole
    assert gb.cv_grid(table, FEATURES, "y", "id", "fold", 3, settings[:2]).count() == 6
    empty = gb.grow(table.where("id < 0"), FEATURES, "y", members[:2], "id", "fold", whole=True)
    assert [g.ensemble.trees for g in empty] == [[], []]


def test_members_are_whole_only_where_all_rows_fit(table, monkeypatch):
    seen, passes = [], gb._pass
    monkeypatch.setattr(gb, "_pass", lambda *a: seen.append(1) or passes(*a))
    member = [gb.Member(gb.Setting(rounds=2))]
    small = gb.grow(table, FEATURES, "y", member, "id", whole=True)
    assert not seen
    for name in ("WHOLE_ROWS", "WHOLE_CELLS"):
        with monkeypatch.context() as m:
            m.setattr(gb, name, 599)
            assert gb.grow(table, FEATURES, "y", member, "id", whole=True) == small and seen
        seen.clear()


def test_whole_members_count_alike_in_every_way(monkeypatch):
    rng = np.random.default_rng(5)
    widths = [2, 3, 40, 200, 4]
    bins = np.column_stack([rng.integers(0, w, 5000) for w in widths]).astype(np.uint8)
    y = (rng.random(5000) < 0.2 + 0.5 * (bins[:, 3] > 90) * (bins[:, 0] + bins[:, 1]) / 3).astype(np.uint8)
    rows = gb._Rows(rng.integers(0, 1 << 60, 5000), y, np.arange(5000, dtype=np.int32) % 4, bins, np.empty((0, 0)))
    member = gb.Member(gb.Setting(0.3, None, 20, rounds=7, min_rows=5, bagging_freq=3, feature_fraction=0.7), 2)
    found = []
    for sizes in ((gb.PACK_ROWS, gb.FEW_CELLS, gb.JOINT_CELLS), (300, 1 << 18, 30), (300, 0, 1), (gb.PACK_ROWS, 0, 5000), (0, 0, 30)):
        for name, size in zip(("PACK_ROWS", "FEW_CELLS", "JOINT_CELLS"), sizes, strict=True):
            monkeypatch.setattr(gb, name, size)
        grown = gb._Whole(rows, -0.5, member, widths).grow()
        found.append((grown.trees, grown.curve))
    assert len(found[0][0]) == 7 and all(f == found[0] for f in found)
    plain = gb._auc(np.array([0.1, 0.3, 0.3, 0.2, -0.5]), np.array([0, 1, 0, 1, 0]))
    assert plain == 4.5 / 6 and gb._auc(np.empty(0), np.empty(0, int)) is None and gb._auc(np.ones(3), np.ones(3, int)) is None


def test_the_best_setting_is_refitted_without_a_job_for_a_level(table, monkeypatch):
    from churnlab.plans import flows
    data = table.selectExpr("id AS user_id", "y AS churn_100", "1 - y AS re1", "IF(id % 4 = 0, 'test', 'train') AS split", *FEATURES)
    monkeypatch.setattr(flows, "split_prepared", lambda *_: data)
    monkeypatch.setattr(gb, "_pass", lambda *_: pytest.fail("a job for a level"))
    r = flows.gbt_fit_best(table.sparkSession, "own rows", step_sizes=(0.3,), max_depths=(2, 5), folds=3, rounds=4).first()
    assert r.step_size == 0.3 and r.max_depth == 5 and 1 <= r.rounds <= 4
    assert r.cv_auc > 0.7 and r.auc > 0.6 and r.tp + r.fp + r.tn + r.fn == 150
