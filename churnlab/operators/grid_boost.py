"""Boosted trees for a whole grid in one pass per level.

All members of a grid (settings x folds) grow at the same time over one binned copy of
the rows.  Each pass is one Spark job: tasks walk the rows' bins down the trees grown so
far, add up gradient histograms by (member, node, feature, bin), Spark adds the tasks' sums and
finds each node's best split, and only the splits come back.  Members are not in step:
each has its own tree and round, and drops out when its patience ends.

* **Bins**: at most 255 for each feature, from quantiles; a split is ``bin <= b``, that is
  ``x <= edge``.
* **Growth** is best first under ``num_leaves``: the leaf with the greatest gain is split
  next.  The order needs the gains of all leaves, so a pass asks ahead for nodes that the
  splits known so far may lead to, not for one leaf at a time: at most ``AHEAD`` nodes for
  each leaf of the budget, those below the greatest gains first.  So the histograms of a task
  are bounded by the budget, not by how many nodes enough rows could keep open.
* **Bags** (rows, by hash of their key) are redrawn every ``bagging_freq`` rounds, and
  features for each tree; both are functions of the seed, so a retried task draws the same.
* **Gradients** travel as integers of ``2^-32``.  Their sums are exact, so neither the
  partitioning nor the order of the tasks changes a tree.
* **Early stopping** watches the exact AUC of the held-out fold.  It is counted with the
  pass that starts the next tree: equal margins are combined in each task, and the
  classes are compared in ranges of the score, whose few sums come back.
* **State**: margins are written with the bins to ``spark.checkpoint.dir`` every few
  trees; in between, a task adds the trees since then.
* **Few rows** (``grow(whole=True)`` and bins within ``WHOLE_ROWS`` and ``WHOLE_CELLS``): a pass
  would be mostly overhead, so a task holds the bins of all rows and grows one member from its
  first round to its last.  It knows the sums of a split node, so only those of its smaller
  child are counted, and no node is asked for ahead.  The trees are those of the passes.

What reaches the driver are splits, sums of ranges and bin edges: bounded by the grid and
its trees.  Fill missing values before (P5): a null or NaN feature raises.
"""

from __future__ import annotations

import heapq
import math
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranked import Entries, joined_ranges, range_sums
from ..sources.session import ensure_checkpoint_dir
from .boost import Ensemble, Tree

MAX_BINS = 255
#: Fixed point of the gradients.
UNIT = float(1 << 32)
#: Trees of one member after which the margins are written anew.
REFRESH = 4
MIN_GAIN = 1e-10
#: Nodes of a tree that a pass asks for at most, for each leaf of its budget.
AHEAD = 2
#: Rows for which there is a task: fewer make a pass mostly overhead.
TASK_ROWS = 20_000
#: Rows, and rows x features, up to which one task holds all bins.  Sums over so many rows are exact in floats.
WHOLE_ROWS, WHOLE_CELLS = 1 << 20, 1 << 26
#: Bits of a packed sum below the count: the hessians of as many rows as a packed cell may have.
PACK_BITS, PACK_ROWS = 41, (1 << 11) - 1
#: Rows x features of a node up to which its features are counted at once.
FEW_CELLS = 1 << 18
#: Combinations of bins up to which features are counted as one.
JOINT_CELLS = 2048
_U = np.uint64


@dataclass(frozen=True)
class Setting:
    """One point of the grid; the defaults are the reference's.  ``max_depth`` None has no limit."""

    step_size: float = 0.1
    max_depth: int | None = None
    num_leaves: int = 31
    rounds: int = 500
    patience: int = 20
    feature_fraction: float = 0.9
    bagging_fraction: float = 0.8
    bagging_freq: int = 5
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    seed: int = 42


def leaves_for(max_depth: int | None) -> int:
    """The leaf budget that goes with a depth (fixed rule of the flows: 2^depth - 20, two at least; 31 without a depth)."""
    return 31 if max_depth is None else max(2, 2 ** max_depth - 20)


def grid(step_sizes=(0.1, 0.05, 0.01), max_depths=(2, 5, None), maxIter: int | None = None, **options) -> list[Setting]:
    """The settings of a grid; ``maxIter`` is Spark's name for ``rounds``."""
    if maxIter is not None:
        options["rounds"] = maxIter
    return [Setting(s, d, leaves_for(d), **options) for s in step_sizes for d in max_depths]


# ------------------------------------------------------------------ bins, hashes
def bin_edges(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Ascending edges of each feature: its quantiles (within an eighth of a bin), at most ``max_bins - 1``, from one pass."""
    at = [i / max_bins for i in range(1, max_bins)]
    rows = df.select(*[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    return [sorted(set(q)) for q in rows.approxQuantile(rows.columns, at, 1 / (8 * max_bins))]


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def in_bag(keys: np.ndarray, s: Setting, round_: int) -> np.ndarray:
    """Which rows (by 64-bit key) the trees of this round see."""
    if s.bagging_fraction >= 1 or not s.bagging_freq:
        return np.ones(len(keys), dtype=bool)
    draw = _mixed(keys.astype(_U), s.seed * 1_000_003 + round_ // s.bagging_freq + 1) >> _U(11)
    return draw < _U(int(s.bagging_fraction * 2.0 ** 53))


def drawn_features(n: int, s: Setting, round_: int) -> np.ndarray:
    """The features of one tree, ascending."""
    kept = min(n, max(1, round(n * s.feature_fraction)))
    order = np.argsort(_mixed(np.arange(1, n + 1, dtype=_U), s.seed * 7_368_787 + round_ + 1), kind="stable")
    return np.sort(order[:kept])


# ------------------------------------------------------------------ one tree
class Split(NamedTuple):
    """A node's sums (g, h in units, n) and its best split; ``feature`` is -1 without one."""

    g: int
    h: int
    n: int
    feature: int
    bin: int
    gain: float
    gl: int
    hl: int
    nl: int


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, features: np.ndarray, s: Setting) -> Split:
    """The first greatest gain over the (feature, bin) sums of a node."""
    total = [int(x[0].sum()) for x in (g, h, n)]
    gl, hl, nl = (np.cumsum(x[features], axis=1)[:, :-1] for x in (g, h, n))
    gr, hr, nr = (t - x for t, x in zip(total, (gl, hl, nl), strict=True))
    score = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + s.l2)
    allowed = (nl >= s.min_rows) & (nr >= s.min_rows) & (hl >= s.min_hessian * UNIT) & (hr >= s.min_hessian * UNIT)
    if not allowed.any():
        return Split(*total, -1, 0, 0.0, 0, 0, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, score(gl, hl) + score(gr, hr) - score(total[0], total[1]), -np.inf)
    at = int(gain.argmax())
    i, b = divmod(at, gain.shape[1])
    if gain[i, b] <= MIN_GAIN:
        return Split(*total, -1, 0, 0.0, 0, 0, 0)
    return Split(*total, int(features[i]), b, float(gain[i, b]), int(gl[i, b]), int(hl[i, b]), int(nl[i, b]))


@dataclass
class _Node:
    depth: int
    n: int | None
    known: Split | None = None
    left: int = -1
    right: int = -1


@dataclass
class _Growth:
    """A tree in the making: every node that known splits lead to, whether or not the best-first order takes it."""

    setting: Setting
    nodes: list[_Node] = field(default_factory=lambda: [_Node(0, None)])

    def closed(self, i: int) -> bool:
        node, s = self.nodes[i], self.setting
        return s.max_depth is not None and node.depth >= s.max_depth or node.n is not None and node.n < 2 * s.min_rows

    def add(self, i: int, split: Split) -> None:
        node = self.nodes[i]
        node.known, node.n = split, split.n
        if split.feature >= 0 and not self.closed(i):
            node.left, node.right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [_Node(node.depth + 1, split.nl), _Node(node.depth + 1, split.n - split.nl)]

    def replay(self) -> tuple[list[int], list[int]]:
        """Split nodes in best-first order, and the nodes whose gain has to be known to go on (none: the tree is done)."""
        leaves, taken = [0], []
        while len(leaves) < self.setting.num_leaves:
            wanted = [i for i in leaves if self._is_open(i)]
            if wanted:
                return taken, self._ahead(wanted)
            best = max(leaves, key=lambda i: (self._gain(i), -i))
            if self._gain(best) <= 0:
                break
            taken.append(best)
            leaves.remove(best)
            leaves += [self.nodes[best].left, self.nodes[best].right]
        return taken, []

    def _gain(self, i: int) -> float:
        return self.nodes[i].known.gain if self.nodes[i].left >= 0 else 0.0

    def _is_open(self, i: int) -> bool:
        return self.nodes[i].known is None and not self.closed(i)

    def _ahead(self, wanted: list[int]) -> list[int]:
        """The wanted nodes, and further open ones that the order may come to, as far as the budget goes."""
        above = {child: node.known.gain for node in self.nodes if node.left >= 0 for child in (node.left, node.right)}
        others = sorted((i for i in range(len(self.nodes)) if self._is_open(i) and i not in wanted), key=lambda i: (-above[i], i))
        return sorted(wanted + others[:max(0, AHEAD * self.setting.num_leaves - len(wanted))])

    def finished(self, taken: list[int]) -> Binned:
        """The tree of the taken splits, its nodes in the order in which they came up, leaves shrunk by the step size."""
        chosen, out = set(taken), Binned([], [], [], [], [], [])
        queue = [(0, (self.nodes[0].known.g, self.nodes[0].known.h, self.nodes[0].known.n))]
        for i, (g, h, n) in queue:
            split, inner = self.nodes[i].known, i in chosen
            down = h / UNIT + self.setting.l2
            out.feature.append(split.feature if inner else -1)
            out.bin.append(split.bin if inner else 0)
            out.value.append(0.0 if inner or down <= 0 else -self.setting.step_size * (g / UNIT) / down)
            out.cover.append(n)
            for side, child in ((out.left, self.nodes[i].left), (out.right, self.nodes[i].right)):
                side.append(len(queue) if inner else -1)
                if inner:
                    queue.append((child, (split.gl, split.hl, split.nl) if side is out.left else
                                  (split.g - split.gl, split.h - split.hl, split.n - split.nl)))
        return out

    def order(self, taken: list[int]) -> list[int]:
        """The node behind each one of the ``finished`` tree."""
        chosen, queue = set(taken), [0]
        for i in queue:
            if i in chosen:
                queue += [self.nodes[i].left, self.nodes[i].right]
        return queue

    def partial(self) -> Binned:
        """All known splits, for walking rows to the nodes in question."""
        return Binned([x.known.feature if x.left >= 0 else -1 for x in self.nodes], [x.known.bin if x.left >= 0 else 0 for x in self.nodes],
                      [x.left for x in self.nodes], [x.right for x in self.nodes], [0.0] * len(self.nodes), [])


class Binned(NamedTuple):
    """A tree over bins: left is ``bin <= b``; ``feature`` -1 marks a leaf."""

    feature: list[int]
    bin: list[int]
    left: list[int]
    right: list[int]
    value: list[float]
    cover: list[int]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut = np.array(self.feature), np.array(self.bin)
        left, right = np.array(self.left), np.array(self.right)
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            down = np.where(bins[rows, np.where(inner, f, 0)] <= cut[node], left[node], right[node])
            node = np.where(inner, down, node)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]

    def over(self, edges: list[list[float]]) -> Tree:
        """The tree over the features' own values."""
        cuts = [edges[f][b] if f >= 0 else 0.0 for f, b in zip(self.feature, self.bin, strict=True)]
        return Tree(self.feature, cuts, self.left, self.right, self.value, [float(c) for c in self.cover])


# ------------------------------------------------------------------ Spark
class Member(NamedTuple):
    """One model of the grid: its setting, and the fold that it does not see (None: it sees all and never stops early)."""

    setting: Setting
    holdout: int | None = None


@dataclass
class Grown:
    """A member's result: its trees up to the best round, the held-out AUC of each round, and whether patience ended it."""

    member: Member
    ensemble: Ensemble
    curve: list[float]
    best_round: int
    stopped: bool


class _Task(NamedTuple):
    """What a pass does for one member."""

    member: int
    setting: Setting
    holdout: int | None
    round: int
    pending: list[Binned]
    partial: Binned | None
    nodes: list[int]
    score: bool


def _chunk(keys, y, folds, bins, margins) -> pa.RecordBatch:
    columns = [a.tobytes() for a in (keys, y, folds.astype(np.int32), bins, margins)]
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)],
                                      names=["n", "keys", "y", "folds", "bins", "margins"])


class _State:
    """The rows in chunks (keys, labels, folds, bins, margins), written anew when margins are brought up to date."""

    def __init__(self, df: DataFrame, features: list[str], label: str, fold: str | None, key: str, edges: list[list[float]], bases: np.ndarray,
                 tasks: int):
        cuts = [np.array(e) for e in edges]
        schema = "n int, keys binary, y binary, folds binary, bins binary, margins binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if any(c.null_count for c in batch.columns[3:]):
                    raise ValueError("features hold nulls; fill missing values before")
                if not batch.num_rows:
                    continue
                bins = np.empty((batch.num_rows, len(cuts)), np.uint8)
                for i, cut in enumerate(cuts):
                    x = batch.column(3 + i).to_numpy()
                    if np.isnan(x).any():
                        raise ValueError("features hold NaN; fill missing values before")
                    bins[:, i] = np.searchsorted(cut, x, side="left")
                keys, y, folds = (batch.column(i).to_numpy() for i in range(3))
                margins = np.repeat(bases[:, None], len(y), axis=1)
                yield _chunk(keys, y.astype(np.uint8), folds, bins, margins)

        rows = df.select(F.xxhash64(key).alias("key"), F.col(label).cast("int").alias("y"),
                         (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
                         *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
        self.spark, self.schema, self.path = df.sparkSession, schema, None
        self.chunks = self._written(rows.coalesce(max(1, tasks)).mapInArrow(run, schema))

    def _written(self, df: DataFrame) -> DataFrame:
        old, self.path = self.path, os.path.join(ensure_checkpoint_dir(self.spark), f"boost-{uuid.uuid4().hex}")
        df.write.parquet(self.path)
        out = self.spark.read.schema(self.schema).parquet(self.path)
        self.alone = out.rdd.getNumPartitions() <= 1
        self._delete(old)
        return out

    def _delete(self, path: str | None) -> None:
        if path:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def refresh(self, pending: dict[int, list[Binned]]) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _read(batches):
                for m, trees in pending.items():
                    for tree in trees:
                        chunk.margins[m] += tree.values(chunk.bins)
                yield _chunk(*chunk)
        self.chunks = self._written(self.chunks.mapInArrow(run, self.schema))

    def close(self) -> None:
        self._delete(self.path)


class _Rows(NamedTuple):
    keys: np.ndarray
    y: np.ndarray
    folds: np.ndarray
    bins: np.ndarray
    margins: np.ndarray


def _decoded(n: int, *columns) -> list[np.ndarray]:
    """Keys, labels, folds, bins and (if given) margins of a chunk."""
    out = [np.frombuffer(c, kind) for c, kind in zip(columns, (np.int64, np.uint8, np.int32, np.uint8, np.float64), strict=False)]
    out[3] = out[3].reshape(n, -1)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column(0)[i].as_py()
            *rest, margins = _decoded(n, *(batch.column(j)[i].as_buffer() for j in range(1, 6)))
            yield _Rows(*rest, margins.reshape(-1, n).copy())


def _histograms(rows: _Rows, margin: np.ndarray, task: _Task, widths: list[int]) -> np.ndarray:
    """(3, nodes, bins of all features side by side): sums of gradients and hessians in units, and rows, of the wanted nodes.

    A feature at a time: its cells are few enough to stay in the processor's cache.
    """
    use = in_bag(rows.keys, task.setting, task.round)
    if task.holdout is not None:
        use &= rows.folds != task.holdout
    slot = np.full(len(task.partial.feature), -1)
    slot[task.nodes] = np.arange(len(task.nodes))
    at = np.flatnonzero(use)
    bins = rows.bins[at]
    place = slot[task.partial.leaf_of(bins)]
    inside = place >= 0
    at, bins, place = at[inside], bins[inside], place[inside]
    p = 1 / (1 + np.exp(-margin[at]))
    weights = [np.rint(v * UNIT) for v in (p - rows.y[at], p * (1 - p))]
    k = len(task.nodes)
    out, start = np.empty((3, k, sum(widths)), np.int64), 0
    for column, width in zip(np.ascontiguousarray(bins.T), widths, strict=True):
        cell = place * width + column
        for i, w in enumerate((*weights, None)):
            out[i, :, start:start + width] = np.bincount(cell, weights=w, minlength=k * width).reshape(k, width)
        start += width
    return out


def _pass(state: _State, tasks: list[_Task], widths: list[int]) -> tuple[dict, dict]:
    """One job: {(member, node): Split} and {member: AUC or None}."""
    wide = "member int, node int, part int, a binary, b binary, c binary"
    d, inside = len(widths), np.arange(max(widths, default=1)) < np.array(widths)[:, None]

    def partial(batches: Iterator[pa.RecordBatch], tasks: list[_Task]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        scores = Entries()
        for rows in _read(batches):
            for task in tasks:
                margin = rows.margins[task.member]
                for tree in task.pending:
                    margin = margin + tree.values(rows.bins)
                if task.nodes:
                    part = _histograms(rows, margin, task, widths)
                    sums[task.member] = sums[task.member] + part if task.member in sums else part
                if task.score:
                    held = rows.folds == task.holdout
                    scores.add(task.member, margin[held], rows.y[held])
        out = [(task.member, node, 0, *(x.tobytes() for x in sums[task.member][:, i]))
               for task in tasks if task.member in sums for i, node in enumerate(task.nodes)]
        out += [(member, -1, *rest) for member, *rest in scores.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(
            [pa.int32()] * 3 + [pa.binary()] * 3)], names=["member", "node", "part", "a", "b", "c"])

    settings = {t.member: (t.setting, drawn_features(d, t.setting, t.round)) for t in tasks}

    def joined(rows: pa.Table) -> pa.Table:
        member, node, part = (rows.column(i)[0].as_py() for i in range(3))
        columns = [[x.as_buffer() for x in rows.column(c)] for c in "abc"]  # a row for each task
        if node >= 0:
            g, h, n = (np.zeros(inside.shape, np.int64) for _ in range(3))
            for whole, c in zip((g, h, n), columns, strict=True):
                whole[inside] = sum(np.frombuffer(x, np.int64) for x in c)
            s, features = settings[member]
            found = best_split(g, h, n, features, s)
            values, gain = [v for i, v in enumerate(found) if i != 5], found.gain
        else:
            values, gain = range_sums(columns), 0.0
        return pa.table({"member": pa.array([member], pa.int32()), "node": pa.array([node], pa.int32()),
                         "part": pa.array([part], pa.int32()), "gain": [gain], "values": pa.array([[str(v) for v in values]])})

    out = "member int, node int, part int, gain double, values array<string>"
    if state.alone:  # the sums of one task are those of all rows, so the members can be dealt to several tasks instead
        def whole(mine: list[_Task]) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in partial(batches, mine):
                    rows = pa.Table.from_batches([batch])
                    for i in range(rows.num_rows):
                        yield from joined(rows.slice(i, 1)).to_batches()
            return state.chunks.mapInArrow(run, out)
        deals = min(state.spark.sparkContext.defaultParallelism, -(-len(tasks) // 4))
        found = reduce(DataFrame.union, [whole(tasks[i::deals]) for i in range(deals)]).collect()
    else:
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from partial(batches, tasks)
        found = state.chunks.mapInArrow(some, wide).groupBy("member", "node", "part").applyInArrow(joined, out).collect()
    splits, ranges = {}, {}
    for r in found:
        values = [int(v) for v in r["values"]]
        if r["node"] >= 0:
            splits[r["member"], r["node"]] = Split(*values[:5], r["gain"], *values[5:])
        else:
            ranges.setdefault(r["member"], []).append((r["part"], values))
    return splits, {m: joined_ranges(parts)[0] for m, parts in ranges.items()}


# ------------------------------------------------------------------ whole members
class _Cells(NamedTuple):
    """The bins of all features side by side, and which of them a tree may cut behind (drawn features, not their last bins)."""

    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray


def best_splits(sums: np.ndarray, totals: list[tuple[int, int, int]], cells: _Cells, s: Setting) -> list[Split]:
    """``best_split`` of several nodes; ``sums`` (3, nodes, cells) are gradients, hessians and rows, ``totals`` those of each node."""
    total = np.array(totals, np.int64).T
    left = sums.copy()
    left[:, :, cells.starts[1:]] -= total[:, :, None]  # so the running sum begins anew with each feature
    np.cumsum(left, axis=2, out=left)
    enough = (left[2] >= s.min_rows) & (left[2] <= (total[2] - s.min_rows)[:, None]) & cells.cuts
    g, h = left[:2] * (1 / UNIT)
    down = total[1][:, None] / UNIT - h
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _score(g, h, s)
        gain += _score(total[0][:, None] / UNIT - g, down, s)
        gain -= np.array([_score(tg / UNIT, th / UNIT, s) if th or s.l2 else np.nan for tg, th, _ in totals])[:, None]
    out = []
    for i, (tg, th, tn) in enumerate(totals):
        found = Split(tg, th, tn, -1, 0, 0.0, 0, 0, 0)
        gains = np.where(enough[i], gain[i], -np.inf)
        at = int(gains.argmax())
        if not (h[i, at] >= s.min_hessian and down[i, at] >= s.min_hessian):  # then others may have to be left out too
            gains = np.where((h[i] >= s.min_hessian) & (down[i] >= s.min_hessian), gains, -np.inf)
            at = int(gains.argmax())
        if gains[at] > MIN_GAIN:
            f = int(np.searchsorted(cells.ends, at, side="right"))
            found = Split(tg, th, tn, f, at - int(cells.starts[f]), float(gains[at]), *(int(x) for x in left[:, i, at]))
        out.append(found)
    return out


def _score(g, h, s: Setting):
    return g ** 2 / (h + s.l2)


def _auc(margins: np.ndarray, y: np.ndarray) -> float | None:
    """The exact AUC of some rows (None for one class)."""
    order = np.argsort(margins)
    margins, pos = margins[order], y[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(y)), dtype=bool), margins[1:] != margins[:-1])))
    if not len(first):
        return None
    pos = np.add.reduceat(pos, first)
    neg = np.diff(np.append(first, len(y))) - pos
    return joined_ranges([(0, [int(pos.sum()), int(neg.sum()), int((pos * (2 * (np.cumsum(neg) - neg) + neg)).sum())])])[0]


def _together(widths: list[int]) -> list[list[int]]:
    """Features that are counted as one for the root: of few bins each, and of at most JOINT_CELLS combinations."""
    out, size = [], JOINT_CELLS + 1
    for f in sorted(range(len(widths)), key=lambda f: widths[f]):
        if size * widths[f] > JOINT_CELLS:
            out.append([])
            size = 1
        out[-1].append(f)
        size *= widths[f]
    return out


class _Whole:
    """One member over rows that are all here."""

    def __init__(self, rows: _Rows, base: float, member: Member, widths: list[int]):
        self.rows, self.setting, self.widths = rows, member.setting, widths
        self.ends = np.cumsum(widths)
        self.starts = self.ends - widths
        self.columns = np.ascontiguousarray(rows.bins.T)
        self.groups = _together(widths)
        self.margin = np.full(len(rows.y), base)
        self.seen = np.ones(len(rows.y), dtype=bool) if member.holdout is None else rows.folds != member.holdout
        self.held = None if member.holdout is None else np.flatnonzero(~self.seen)
        self.trees: list[Binned] = []
        self.curve: list[float | None] = []
        self.best, self.stopped = (0, -math.inf), False

    def grow(self) -> _Whole:
        s = self.setting
        for t in range(s.rounds):
            if t == 0 or s.bagging_freq and t % s.bagging_freq == 0:
                self._draw(t)
            if not self._tree(t):
                break
            if self.held is not None and self._scored():
                break
        return self

    def _scored(self) -> bool:
        """Whether patience ends the member with this round."""
        auc = _auc(self.margin[self.held], self.rows.y[self.held])
        self.curve.append(auc)
        if auc is not None and auc > self.best[1]:
            self.best = (len(self.trees), auc)
        elif len(self.trees) - self.best[0] >= self.setting.patience:
            self.stopped = True
        return self.stopped

    def _draw(self, round_: int) -> None:
        """The bag and the rows outside, the bag's bins, and its rows in each cell."""
        bag = self.seen & in_bag(self.rows.keys, self.setting, round_)
        self.bag, self.out = np.flatnonzero(bag), np.flatnonzero(~bag)
        self.inside = np.take(self.columns, self.bag, axis=1)
        self.joint = []
        for group in self.groups:
            code = self.inside[group[0]]
            for f in group[1:]:
                code = code * np.uint16(self.widths[f]) + self.inside[f]
            self.joint.append(code)
        self.counts = self._counted(lambda code, size: np.bincount(code, minlength=size), np.int64)
        self.packs = np.maximum.reduceat(self.counts, self.starts) <= PACK_ROWS

    def _counted(self, count, kind) -> np.ndarray:
        """The sums of each cell over the bag, from those of each combination of a group's bins."""
        out = np.empty(self.ends[-1], kind)
        for group, code in zip(self.groups, self.joint, strict=True):
            wide = [self.widths[f] for f in group]
            found = count(code, math.prod(wide)).reshape(wide)
            for i, f in enumerate(group):
                out[self.starts[f]:self.ends[f]] = found.sum(axis=tuple(j for j in range(len(group)) if j != i))
        return out

    def _root(self, weights: np.ndarray) -> np.ndarray:
        def count(code: np.ndarray, size: int) -> np.ndarray:
            sums = np.zeros(size, complex)
            np.add.at(sums, code.astype(np.intp), weights)
            return sums
        both = self._counted(count, complex)
        return np.stack([both.real.astype(np.int64), both.imag.astype(np.int64), self.counts])

    def _sums(self, at: np.ndarray, weights: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """(3, cells): gradients, hessians and rows of the bag's rows ``at``.  Where no cell can have too many rows, their
        count is added up in the bits above the hessians."""
        out = np.zeros(self.ends[-1], complex)
        plain = weights[at]
        packed = plain + 1j * float(1 << PACK_BITS)
        counts = {}
        few = len(at) <= PACK_ROWS and len(at) * len(self.widths) <= FEW_CELLS
        if few:
            place = self.rows.bins[self.bag[at]] + self.starts
            np.add.at(out, place.ravel(), np.repeat(packed, len(self.widths)))
        else:
            for f in drawn:
                place = self.inside[f][at].astype(np.intp)
                fits = len(at) <= PACK_ROWS or self.packs[f]
                np.add.at(out[self.starts[f]:self.ends[f]], place, packed if fits else plain)
                if not fits:
                    counts[f] = np.bincount(place, minlength=self.widths[f])
        both = out.imag.astype(np.int64)
        sums = np.stack([out.real.astype(np.int64), both & (1 << PACK_BITS) - 1, both >> PACK_BITS])
        for f, n in counts.items():
            here = slice(self.starts[f], self.ends[f])
            sums[1, here], sums[2, here] = both[here], n
        if not few:  # every feature has the same total, the others have it in one cell
            whole = plain.sum()
            sums[:, np.delete(self.starts, drawn)] = np.array([int(whole.real), int(whole.imag), len(at)])[:, None]
        return sums

    def _tree(self, round_: int) -> bool:
        """Grow the next tree and add it to the margins; False without a split."""
        s, growth = self.setting, _Growth(self.setting)
        drawn = drawn_features(len(self.widths), s, round_)
        cuts = np.repeat(np.isin(np.arange(len(self.widths)), drawn), self.widths)
        cuts[self.ends - 1] = False
        cells = _Cells(self.starts, self.ends, cuts)
        p = 1 / (1 + np.exp(-self.margin[self.bag]))
        weights = np.rint((p - self.rows.y[self.bag]) * UNIT) + 1j * np.rint(p * (1 - p) * UNIT)
        total = weights.sum()
        sums = {0: self._root(weights)}
        growth.add(0, best_splits(sums[0][:, None], [(int(total.real), int(total.imag), len(weights))], cells, s)[0])
        inside, out = {0: np.arange(len(self.bag))}, {0: self.out}
        taken, options = [], [(-growth.nodes[0].known.gain, 0)] if growth.nodes[0].left >= 0 else []
        while options and len(taken) < s.num_leaves - 1:
            _, i = heapq.heappop(options)
            taken.append(i)
            node = growth.nodes[i]
            split = node.known
            for rows, column in ((inside, self.inside[split.feature]), (out, self.columns[split.feature])):
                at = rows.pop(i)
                low = column[at] <= split.bin
                rows[node.left], rows[node.right] = at[low], at[~low]
            above = sums.pop(i)
            wanted = [c for c in (node.left, node.right) if not growth.closed(c)]
            if not wanted or len(taken) == s.num_leaves - 1:
                continue
            small, large = sorted((node.left, node.right), key=lambda c: len(inside[c]))
            sums[small] = self._sums(inside[small], weights, drawn)
            sums[large] = above - sums[small]
            totals = {node.left: (split.gl, split.hl, split.nl), node.right: (split.g - split.gl, split.h - split.hl, split.n - split.nl)}
            for c, found in zip(wanted, best_splits(np.stack([sums[c] for c in wanted], axis=1), [totals[c] for c in wanted], cells, s), strict=True):
                growth.add(c, found)
                if growth.nodes[c].left >= 0:
                    heapq.heappush(options, (-found.gain, c))
        if not taken:
            return False
        tree = growth.finished(taken)
        for i, feature, value in zip(growth.order(taken), tree.feature, tree.value, strict=True):
            if feature < 0:
                self.margin[self.bag[inside[i]]] += value
                self.margin[out[i]] += value
        self.trees.append(tree)
        return True


def _gathered(chunks: Iterable) -> _Rows:
    """All rows of some chunks, without margins."""
    held = [_decoded(c["n"], *(c[k] for k in ("keys", "y", "folds", "bins"))) for c in chunks]
    return _Rows(*(np.concatenate([c[i] for c in held]) for i in range(4)), np.empty((0, 0)))


def _grown_whole(state: _State, members: list[Member], bases: np.ndarray, widths: list[int]) -> list[tuple]:
    """(trees, curve, best round and its AUC, stopped) of each member: a task for each, those with most leaves first."""
    order = sorted(range(len(members)), key=lambda i: -members[i].setting.num_leaves)

    def run(place: int, chunks: Iterator) -> Iterator[tuple]:
        i, rows = order[place], list(chunks)
        if rows:
            grown = _Whole(_gathered(rows), bases[i], members[i], widths).grow()
            yield i, (grown.trees, grown.curve, grown.best, grown.stopped)

    chunks = state.chunks.coalesce(1).rdd
    found = dict(state.spark.sparkContext.union([chunks] * len(members)).mapPartitionsWithIndex(run).collect())
    return [found.get(i, ([], [], (0, -math.inf), False)) for i in range(len(members))]


def _bases(df: DataFrame, label: str, fold: str | None, members: list[Member]) -> tuple[np.ndarray, int]:
    """The log odds of each member's training rows, and the number of all rows."""
    kind = F.col(fold).cast("int") if fold else F.lit(-1)
    counts = {r["fold"]: (r["pos"], r["n"]) for r in df.groupBy(kind.alias("fold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for m in members:
        seen = [c for f, c in counts.items() if m.holdout is None or f != m.holdout]
        pos, n = sum(c[0] for c in seen), sum(c[1] for c in seen)
        out.append(math.log(pos / (n - pos)) if 0 < pos < n else math.log((pos + 0.5) / (n - pos + 0.5)))
    return np.array(out), sum(c[1] for c in counts.values())


def grow(df: DataFrame, features: list[str], label: str, members: list[Member], key: str, fold: str | None = None,
         max_bins: int = MAX_BINS, edges: list[list[float]] | None = None, whole: bool = False) -> list[Grown]:
    """Grow all ``members`` over ``df`` (``key`` draws the bags, ``fold`` names the folds, ``label`` is 0 or 1).

    With ``whole``, a member is grown in one task where the rows are few enough for that.
    """
    edges = edges or bin_edges(df, features, max_bins)
    widths = [len(e) + 1 for e in edges]
    bases, n = _bases(df, label, fold, members)
    whole = whole and n <= WHOLE_ROWS and n * len(features) <= WHOLE_CELLS
    state = _State(df, features, label, fold, key, edges, bases[:0] if whole else bases, -(-n // TASK_ROWS))
    found = (_grown_whole if whole else _grown_together)(state, members, bases, widths)
    state.close()
    out = []
    for i, (m, (trees, curve, best, stopped)) in enumerate(zip(members, found, strict=True)):
        kept = best[0] if m.holdout is not None else len(trees)
        out.append(Grown(m, Ensemble([t.over(edges) for t in trees[:kept]], list(features), float(bases[i])), curve, kept, stopped))
    return out


def _grown_together(state: _State, members: list[Member], bases: np.ndarray, widths: list[int]) -> list[tuple]:
    """(trees, curve, best round and its AUC, stopped) of each member, all of them in one pass per level."""
    trees: list[list[Binned]] = [[] for _ in members]
    pending: dict[int, list[Binned]] = {i: [] for i in range(len(members))}
    growth = {i: _Growth(m.setting) for i, m in enumerate(members)}
    curves: list[list] = [[] for _ in members]
    best = [(0, -math.inf)] * len(members)
    stopped = [False] * len(members)
    unscored: set[int] = set()
    while growth or unscored:
        tasks = [_Task(i, members[i].setting, members[i].holdout, len(trees[i]), pending[i], growth[i].partial() if i in growth else None,
                       growth[i].replay()[1] if i in growth else [], i in unscored) for i in sorted({*growth, *unscored})]
        splits, aucs = _pass(state, tasks, widths)
        for i in unscored:
            auc = aucs.get(i)
            curves[i].append(auc)
            if auc is not None and auc > best[i][1]:
                best[i] = (len(trees[i]), auc)
            elif len(trees[i]) - best[i][0] >= members[i].setting.patience:
                stopped[i] = True
                growth.pop(i, None)  # the next tree was begun in the same pass
        unscored = set()
        for (i, node), split in splits.items():
            if i in growth:
                growth[i].add(node, split)
        for i in list(growth):
            taken, missing = growth[i].replay()
            if missing and growth[i].nodes[0].known is not None:
                continue
            done = growth.pop(i)
            if not taken:  # no row, or nothing left to split
                continue
            tree = done.finished(taken)
            trees[i].append(tree)
            pending[i].append(tree)
            if members[i].holdout is not None:
                unscored.add(i)
            if len(trees[i]) < members[i].setting.rounds:
                growth[i] = _Growth(members[i].setting)
        if max(map(len, pending.values()), default=0) >= REFRESH and (growth or unscored):
            state.refresh(pending)
            pending = {i: [] for i in pending}
    return list(zip(trees, curves, best, stopped, strict=True))


def cv_grid(df: DataFrame, features: list[str], label: str, key: str, fold: str, num_folds: int = 5,
            settings: list[Setting] | None = None) -> DataFrame:
    """Grid CV with early stopping inside each fold: ``(grid_index, step_size, max_depth, fold, rounds, trained, stopped, auc)``.

    ``rounds`` is the best round of ``trained`` ones, ``auc`` its held-out AUC, ``stopped`` whether patience ended the member.
    """
    settings = settings or grid()
    members = [Member(s, f) for s in settings for f in range(num_folds)]
    rows = []
    for i, g in enumerate(grow(df, features, label, members, key, fold, whole=True)):
        s = g.member.setting
        auc = g.curve[g.best_round - 1] if g.best_round else None
        rows.append((i // num_folds, s.step_size, s.max_depth, g.member.holdout, g.best_round, len(g.curve), g.stopped, auc))
    return df.sparkSession.createDataFrame(rows, "grid_index int, step_size double, max_depth int, fold int, rounds int, "
                                                 "trained int, stopped boolean, auc double")
