"""MLP training with batch normalisation, averaged or synchronous.

What concerns a whole mini-batch - the moments of batch normalisation, their gradients, the
gradient of the weights - is a sum over its rows.  ``gradient`` is a generator that yields
its own sums and gets the whole batch's, so the same code serves two ways of training:

* **averaged** (the default): a mini-batch lies in one task, which answers itself.  Each task
  runs an epoch over its rows; weights, running means and variances and optimiser moments
  are averaged by rows (parallel SGD with parameter averaging).  One job for an epoch.
* **synchronous**: the steps of an epoch are taken one after another, each over a whole
  mini-batch of rows from all over the table.  Which rows form a batch and which units drop out
  depend on the rows' keys and the seed alone, so the weights do not depend on the number of
  partitions (but for the rounding of sums).  Rows are dealt by batch once, into runs of batches
  (``RUN_CELLS``); a job takes the steps of one run.  A batch that is larger than a run is spread
  over all tasks instead: each sum is one job, in which tasks replay the batch with the sums
  known so far and yield the next, Spark adds them up, and the driver takes the step.  That is one
  job for a batch, and six more with two normalised hidden layers.  An all-gather inside a
  barrier stage would save the jobs, but its calls poll once a second, which is slower.

Several (rate, hold-out fold) members take their steps together and share the jobs; members
may stop one by one.  ``folded`` puts running statistics into plain weights for
``mlp.mlp_score``.  Every job ends with an epoch, a run or a step, so a lost executor repeats that.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.layout import stored
from ..functions.ranked import auc_of_entries, entries_of
from ..functions.vectors import sum_arrays
from .mlp import ADAM_B1, ADAM_B2, ADAM_EPS, Spec, _chunks, forward, softmax, softplus

_U = np.uint64
#: Mini-batches that a task has at least, where the rows suffice.
TASK_BATCHES = 16
#: Rows x features of a run of synchronous mini-batches, which a task holds.
RUN_CELLS = 1 << 22


@dataclass(frozen=True)
class Net:
    """Layer sizes (input, hidden, output) and options; one output unit is a sigmoid, two are a softmax."""

    sizes: tuple[int, ...]
    activation: str = "tanh"
    batch_norm: bool = False
    dropout: float = 0.0
    smoothing: float = 0.0
    momentum: float = 0.99
    epsilon: float = 1e-3


class Model(NamedTuple):
    """Parameters in layer order (with batch normalisation: scale and shift before and behind each hidden product), and
    the running (mean, variance) of each normalisation."""

    params: list[np.ndarray]
    running: list[np.ndarray]


def init_model(net: Net, seed: int = 0) -> Model:
    rng = np.random.RandomState(seed)
    params, running = [], []

    def norm(n: int) -> None:
        if net.batch_norm:
            params.extend((np.ones(n), np.zeros(n)))
            running.extend((np.zeros(n), np.ones(n)))

    norm(net.sizes[0])
    for i, (m, n) in enumerate(zip(net.sizes, net.sizes[1:], strict=False)):
        limit = math.sqrt(6 / (m + n))
        params += [rng.uniform(-limit, limit, (m, n)), np.zeros(n)]
        if i < len(net.sizes) - 2:
            norm(n)
    return Model(params, running)


def _kept(keys: np.ndarray, units: int, rate: float, salt: int) -> np.ndarray:
    """Inverted dropout: 0 or 1 / (1 - rate) for each row and unit, by hash."""
    with np.errstate(over="ignore"):
        x = (keys[:, None] ^ _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + np.arange(1, units + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> _U(shift))) * _U(factor)
    return ((x >> _U(11)) >= _U(int(rate * 2.0 ** 53))) / (1.0 - rate)


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=0)


Exchange = Generator[np.ndarray, np.ndarray, object]


def _normed(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, centre: np.ndarray, epsilon: float) -> Exchange:
    """The normalised rows; what the way back needs; mean and variance of the whole batch (from sums about ``centre``)."""
    width = x.shape[1]
    total = yield np.concatenate(([float(len(x))], _row_sums(x - centre), _row_sums((x - centre) ** 2)))
    n = max(total[0], 1.0)
    off = total[1:1 + width] / n
    variance = np.maximum(total[1 + width:] / n - off ** 2, 0.0)
    inverse = 1 / np.sqrt(variance + epsilon)
    unit = (x - centre - off) * inverse
    return unit * scale + shift, (unit, inverse, n), (centre + off, variance)


def _normed_back(d: np.ndarray, unit: np.ndarray, inverse: np.ndarray, n: float, scale: np.ndarray) -> Exchange:
    """The gradient before a normalisation, and the sums for its scale and shift."""
    both = yield np.concatenate((_row_sums(d * unit), _row_sums(d)))
    to_scale, to_shift = both[:d.shape[1]], both[d.shape[1]:]
    return scale * inverse * (d - to_shift / n - unit * to_scale / n), to_scale, to_shift


def gradient(net: Net, model: Model, x: np.ndarray, y: np.ndarray, keys: np.ndarray, salt: int = 0) -> Exchange:
    """The mean gradient of the loss over a batch, and its moments.

    A generator: it yields the sums over these rows and gets those of the whole batch.  Returns (gradients or None for an
    empty batch, moments).
    """
    params, centres = model.params, iter(model.running[::2])
    act = np.tanh if net.activation == "tanh" else softplus
    grads: list = [None] * len(params)
    moments, steps, h, at = [], [], x, 0

    if net.batch_norm:
        h, cache, found = yield from _normed(h, params[0], params[1], next(centres), net.epsilon)
        moments += found
        steps.append(("norm", 0, cache))
        at = 2
    layers = len(net.sizes) - 1
    for i in range(layers):
        steps.append(("dense", at, h))
        h, at = h @ params[at] + params[at + 1], at + 2
        if i == layers - 1:
            break
        if net.batch_norm:
            h, cache, found = yield from _normed(h, params[at], params[at + 1], next(centres), net.epsilon)
            moments += found
            steps.append(("norm", at, cache))
            at += 2
        steps.append(("act", 0, h))
        h = act(h)
        if net.dropout:
            mask = _kept(keys, h.shape[1], net.dropout, salt * 31 + i)
            steps.append(("drop", 0, mask))
            h = h * mask
    target = np.eye(2)[y] if h.shape[1] == 2 else y[:, None].astype(float)
    target = target * (1 - net.smoothing) + net.smoothing / 2
    d = (softmax(h) if h.shape[1] == 2 else 1 / (1 + np.exp(-h))) - target
    for kind, at, kept in reversed(steps):
        if kind == "dense":
            grads[at], grads[at + 1] = kept.T @ d, _row_sums(d)
            d = d @ params[at].T
        elif kind == "act":
            d = d * ((1 - np.tanh(kept) ** 2) if net.activation == "tanh" else 1 / (1 + np.exp(-np.clip(kept, -500, 500))))
        elif kind == "drop":
            d = d * kept
        else:
            # these sums are of the whole batch already
            d, to_scale, to_shift = yield from _normed_back(d, *kept, params[at])
            grads[at], grads[at + 1] = ("whole", to_scale), ("whole", to_shift)
    own = [g.ravel() for g in grads if not isinstance(g, tuple)]
    total = yield np.concatenate(([float(len(x))], *own))
    n, place = total[0], 1
    out = []
    for g in grads:
        if isinstance(g, tuple):
            out.append(g[1] / max(n, 1.0))
        else:
            out.append(total[place:place + g.size].reshape(g.shape) / max(n, 1.0))
            place += g.size
    return (out if n else None), moments


class Optimiser(NamedTuple):
    """Adam's moments and number of steps; plain steps without."""

    m: list[np.ndarray]
    v: list[np.ndarray]
    t: float


def _stepped(params, grads, lr: float, adam: Optimiser | None):
    if adam is None:
        return [p - lr * g for p, g in zip(params, grads, strict=True)], None
    t = adam.t + 1
    m = [ADAM_B1 * a + (1 - ADAM_B1) * g for a, g in zip(adam.m, grads, strict=True)]
    v = [ADAM_B2 * a + (1 - ADAM_B2) * g * g for a, g in zip(adam.v, grads, strict=True)]
    rate = lr * math.sqrt(1 - ADAM_B2 ** t) / (1 - ADAM_B1 ** t)
    return [p - rate * a / (np.sqrt(b) + ADAM_EPS) for p, a, b in zip(params, m, v, strict=True)], Optimiser(m, v, t)


def alone(step: Exchange) -> tuple:
    """Run a step whose batch is all here."""
    try:
        own = next(step)
        while True:
            own = step.send(own)
    except StopIteration as end:
        return end.value


def replayed(step: Exchange, known: list[np.ndarray]) -> np.ndarray | tuple:
    """What a step yields after it got the ``known`` sums, or its result."""
    try:
        own = next(step)
        for total in known:
            own = step.send(total)
        return own
    except StopIteration as end:
        return end.value


class Rows(NamedTuple):
    x: np.ndarray
    y: np.ndarray
    keys: np.ndarray
    folds: np.ndarray

    def at(self, place: np.ndarray) -> Rows:
        return Rows(*(c[place] for c in self))


def batch_of(rows: Rows, batches: int, seed: int) -> np.ndarray:
    """The mini-batch of each row, by its key."""
    with np.errstate(over="ignore"):
        draw = (rows.keys ^ (rows.keys >> _U(31))) * _U(0x9E3779B97F4A7C15 ^ seed)
        return ((draw ^ (draw >> _U(29))) % _U(batches)).astype(np.int64)


State = tuple[Model, Optimiser | None]


def _after(net: Net, state: State, result: tuple, lr: float) -> State:
    """The state after a step."""
    (model, adam), (grads, moments) = state, result
    if grads is None:
        return state
    params, adam = _stepped(model.params, grads, lr, adam)
    return Model(params, [net.momentum * r + (1 - net.momentum) * m for r, m in zip(model.running, moments, strict=True)]), adam


def train_epoch(net: Net, state: State, spec: Spec, rows: Rows, batches: int, seed: int, epoch: int) -> State:
    """One epoch over ``rows``, whose batches are all here."""
    seen = rows if spec.holdout is None else rows.at(rows.folds != spec.holdout)
    which = batch_of(seen, batches, seed)
    for b in range(batches):
        part = seen.at(which == b)
        state = _after(net, state, alone(gradient(net, state[0], *part[:3], salt_of(epoch, b, batches, seed))), spec.lr)
    return state


def salt_of(epoch: int, b: int, batches: int, seed: int) -> int:
    return (epoch * batches + b) * 7919 + seed


def _flat(state: State) -> np.ndarray:
    model, adam = state
    return np.concatenate([a.ravel() for a in (*model.params, *model.running, *([*adam.m, *adam.v, np.array([adam.t])] if adam else []))])


def _shaped(flat: np.ndarray, like: State) -> State:
    place = 0

    def take(arrays):
        nonlocal place
        out = []
        for a in arrays:
            out.append(flat[place:place + a.size].reshape(a.shape).copy())
            place += a.size
        return out
    model, adam = like
    new = Model(take(model.params), take(model.running))
    return new, Optimiser(take(adam.m), take(adam.v), float(flat[place])) if adam else None


def _rows_of(frames: Iterator[pd.DataFrame], names: list[str]) -> Rows:
    """All rows of a partition."""
    parts = [f for f in frames if len(f)]
    whole = pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ["_key", "_y", "_fold", *names]})
    return Rows(whole[names].to_numpy(float), whole["_y"].to_numpy(int), whole["_key"].to_numpy(np.int64).astype(_U), whole["_fold"].to_numpy(int))


PACKED = "x binary, y binary, keys binary, folds binary"


def _packed(data: DataFrame, names: list[str]) -> DataFrame:
    """A row for each chunk of a partition, its columns as whole arrays: converted once and not in every epoch."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _chunks(frames):
            yield pd.DataFrame([[np.ascontiguousarray(a).tobytes() for a in _rows_of(iter([frame]), names)]], columns=list(Rows._fields))

    return data.mapInPandas(run, PACKED)


def _unpacked(frames: Iterator[pd.DataFrame], width: int) -> Rows:
    """All rows of a partition of ``_packed`` ones."""
    chunks = [c for frame in frames for c in frame.itertuples(index=False)]
    x, y, keys, folds = (np.frombuffer(b"".join(c[i] for c in chunks), kind) for i, kind in enumerate((float, np.int64, _U, np.int64)))
    return Rows(x.reshape(-1, width), y, keys, folds)


SUMS = "member int, sums array<double>"


def _averaged_epoch(data: DataFrame, net, states: list[State], specs: list[Spec], batch: int, seed: int, epoch: int) -> list[State]:
    shared = data.sparkSession.sparkContext.broadcast([_flat(s) for s in states])
    like = states[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _unpacked(frames, net.sizes[0])
        for i, (spec, flat) in enumerate(zip(specs, shared.value, strict=True)):
            n = len(rows.y) if spec.holdout is None else int((rows.folds != spec.holdout).sum())
            if n:
                state = train_epoch(net, _shaped(flat, like), spec, rows, max(1, round(n / batch)), seed, epoch)
                yield pd.DataFrame({"member": [i], "sums": [np.append(_flat(state) * n, n)]})

    out = list(states)
    for r in sum_arrays(data.mapInPandas(run, SUMS), ["member"], "sums").collect():
        sums = np.array(r["sums"])
        out[r["member"]] = _shaped(sums[:-1] / sums[-1], like)
    shared.unpersist()
    return out


def _dealt(data: DataFrame, batches: int, seed: int) -> DataFrame:
    """The rows with their mini-batch."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = part.column(0).to_numpy().astype(_U)
            which = batch_of(Rows(keys, keys, keys, keys), batches, seed)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(which, pa.int64())], names=[*part.schema.names, "_batch"])

    return data.mapInArrow(run, StructType([*data.schema.fields, StructField("_batch", LongType())]))


def _runs(data: DataFrame, names: list[str], n: int, batches: int, seed: int) -> DataFrame:
    """A row for each run of mini-batches, its columns as whole arrays in the order of the batches."""
    size = -(-batches // max(1, -(-n * len(names) // RUN_CELLS)))

    def run(rows: pa.Table) -> pa.Table:
        if any(rows.column(c).null_count for c in ("_y", "_fold")):
            raise ValueError("label or fold holds nulls")
        which, keys, y, folds = (rows.column(c).to_numpy() for c in ("_batch", "_key", "_y", "_fold"))
        order = np.lexsort((keys, which))
        arrays = [which, np.column_stack([rows.column(c).to_numpy() for c in names]), y.astype(np.int64), keys, folds.astype(np.int64)]
        return pa.table({"run": pa.array([which[0] // size], pa.int32()), **{c: pa.array([np.ascontiguousarray(a[order]).tobytes()], pa.binary())
                                                                             for c, a in zip(("batches", *Rows._fields), arrays, strict=True)}})

    dealt = _dealt(data, batches, seed)
    return dealt.groupBy(F.floor(F.col("_batch") / size).alias("run")).applyInArrow(run, f"run int, batches binary, {PACKED}")


def _chained_epoch(runs: DataFrame, count: int, net, states: list[State], specs: list[Spec], batches: int, seed: int, epoch: int) -> list[State]:
    """An epoch over ``_runs``, a job for each of them in turn."""
    like = states[0]
    for k in range(count):
        shared = runs.sparkSession.sparkContext.broadcast([_flat(s) for s in states])

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for which, *columns in (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                which = np.frombuffer(which, np.int64)
                rows = _unpacked(iter([pd.DataFrame([columns])]), net.sizes[0])
                found, ends = np.unique(which, return_index=True)
                ends = np.append(ends[1:], len(which))
                out = []
                for spec, flat in zip(specs, shared.value, strict=True):
                    state, start = _shaped(flat, like), 0
                    for b, end in zip(found.tolist(), ends, strict=True):
                        part, start = Rows(*(c[start:end] for c in rows)), end
                        if spec.holdout is not None:
                            part = part.at(part.folds != spec.holdout)
                        state = _after(net, state, alone(gradient(net, state[0], *part[:3], salt_of(epoch, b, batches, seed))), spec.lr)
                    out.append(_flat(state).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out, pa.binary())], names=["member", "state"])

        here = runs.where(F.col("run") == k).select("batches", *Rows._fields)
        ended = {r["member"]: r["state"] for r in here.mapInArrow(run, "member int, state binary").collect()}
        states = [_shaped(np.frombuffer(ended[i]), like) if ended else s for i, s in enumerate(states)]
        shared.unpersist()
    return states


def _synchronous_epoch(data: DataFrame, names, net, states: list[State], specs: list[Spec], batches: int, seed: int, epoch: int) -> list[State]:
    for b in range(batches):
        known: list[list[np.ndarray]] = [[] for _ in states]
        nothing = Rows(np.zeros((0, net.sizes[0])), np.zeros(0, int), np.zeros(0, _U), np.zeros(0, int))
        salt = salt_of(epoch, b, batches, seed)
        while True:
            # without rows a step yields nothing of its own, and its result is that of the sums alone
            ends = [replayed(gradient(net, s[0], *nothing[:3], salt), k) for s, k in zip(states, known, strict=True)]
            if isinstance(ends[0], tuple):
                states = [_after(net, s, end, spec.lr) for s, end, spec in zip(states, ends, specs, strict=True)]
                break
            shared = data.sparkSession.sparkContext.broadcast(([s[0] for s in states], known))

            def run(frames: Iterator[pd.DataFrame], shared=shared, salt=salt) -> Iterator[pd.DataFrame]:
                rows = _rows_of(frames, names)
                for i, (spec, model, sums) in enumerate(zip(specs, *shared.value, strict=True)):
                    part = rows if spec.holdout is None else rows.at(rows.folds != spec.holdout)
                    yield pd.DataFrame({"member": [i], "sums": [replayed(gradient(net, model, *part[:3], salt), sums)]})

            here = data.where(F.col("_batch") == b).drop("_batch")
            for r in sum_arrays(here.mapInPandas(run, SUMS), ["member"], "sums").collect():
                known[r["member"]].append(np.array(r["sums"]))
            shared.unpersist()
    return states


def fit(df: DataFrame, feature_cols: list[str], label: str, key: str, net: Net, specs: list[Spec], epochs: int, batch: int = 128,
        optimizer: str = "adam", seed: int = 1, init: Model | None = None, fold_col: str | None = None, synchronous: bool = False,
        on_epoch=None) -> list[Model]:
    """Train a model for each of ``specs``; ``on_epoch(epoch, models)`` may return the members that stop, or True for all.

    Fill missing values before; ``batch`` is the mean size of a batch (rows join batches by hash of ``key``).
    """
    start = init or init_model(net, seed)
    zeros = [np.zeros_like(p) for p in start.params]
    states: list[State] = [(start, Optimiser(zeros, zeros, 0.0) if optimizer == "adam" else None) for _ in specs]
    data = held = df.select(F.xxhash64(key).alias("_key"), F.col(label).cast("int").alias("_y"),
                     (F.col(fold_col).cast("int") if fold_col else F.lit(-1)).alias("_fold"),
                     *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feature_cols)]).persist()
    names = [f"_x{i}" for i in range(len(feature_cols))]
    n = data.count()
    batches = max(1, round(n / batch)) if synchronous else 0
    # so few rows that a task has hardly a step to take before the averaging (or only the overhead of a job) share a task
    data = data.coalesce(max(1, int(n / (TASK_BATCHES * batch))))
    chained = False
    if synchronous:
        largest = _dealt(held.select("_key"), batches, seed).groupBy("_batch").count().agg(F.max("count")).first()[0] or 0
        chained = largest * len(names) <= RUN_CELLS
    with ExitStack() as kept:
        if chained:
            data = kept.enter_context(stored(_runs(data, names, n, batches, seed), "run"))
            count = (data.agg(F.max("run")).first()[0] if n else -1) + 1
        elif synchronous:
            # those of a batch side by side: its jobs hand no other rows to Python
            data = _dealt(data, batches, seed).sortWithinPartitions("_batch").persist()
        else:
            data = _packed(data, names).persist()
        live = list(range(len(specs)))
        for epoch in range(epochs):
            mine, chosen = [states[i] for i in live], [specs[i] for i in live]
            if chained:
                mine = _chained_epoch(data, count, net, mine, chosen, batches, seed, epoch)
            elif synchronous:
                mine = _synchronous_epoch(data, names, net, mine, chosen, batches, seed, epoch)
            else:
                mine = _averaged_epoch(data, net, mine, chosen, batch, seed, epoch)
            for i, state in zip(live, mine, strict=True):
                states[i] = state
            ended = on_epoch(epoch + 1, [m for m, _ in states]) if on_epoch else None
            live = [] if ended is True else [i for i in live if i not in (ended or ())]
            if not live:
                break
    data.unpersist()
    held.unpersist()
    return [m for m, _ in states]


def auc_per_member(df: DataFrame, feature_cols: list[str], label: str, net: Net, models: list[Model], specs: list[Spec] | None = None,
                   fold_col: str | None = None) -> dict[int, float | None]:
    """The exact AUC of each model by its running statistics, on its hold-out fold or (without ``specs``) on all rows, in one pass."""
    layers = df.sparkSession.sparkContext.broadcast([folded(net, m) for m in models])

    def margins(columns):
        x, y, folds = np.column_stack(columns[:-2]).astype(float), columns[-2].astype(int), columns[-1]
        for i, weights in enumerate(layers.value):
            held = np.ones(len(y), dtype=bool) if specs is None or specs[i].holdout is None else folds == specs[i].holdout
            a_l, _ = forward(x[held], weights, net.activation, first_linear=False)
            yield i, a_l[-1][:, 1] - a_l[-1][:, 0], y[held]

    rows = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feature_cols)], F.col(label).cast("int").alias("_y"),
                     (F.col(fold_col).cast("int") if fold_col else F.lit(-1)).alias("_fold"))
    return {m: auc for m, (auc, _, _) in auc_of_entries(entries_of(rows, rows.columns, margins)).items()}


def patience_of(score, members: int, patience: int):
    """``on_epoch`` callback: a member ends after ``patience`` epochs without a better ``score(models)[member]``.

    Its ``best`` has (epoch, score, model) of each member, its ``curve`` the scores of each epoch.
    """
    best: list[tuple] = [(0, -math.inf, None)] * members
    ended: set[int] = set()

    def callback(epoch: int, models: list[Model]) -> list[int]:
        found = score(models)
        callback.curve.append([None if i in ended else found.get(i) for i in range(members)])
        for i in range(members):
            if i not in ended and found.get(i) is not None and found[i] > best[i][1]:
                best[i] = (epoch, found[i], models[i])
            elif i not in ended and epoch - best[i][0] >= patience:
                ended.add(i)
        return sorted(ended)

    callback.best, callback.curve = best, []
    return callback


def folded(net: Net, model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """Plain (weights, bias) layers with the running normalisations inside and two outputs, for ``mlp.mlp_score``
    (``first_linear=False``)."""
    params, running = list(model.params), list(model.running)
    scale, shift = np.ones(net.sizes[0]), np.zeros(net.sizes[0])

    def norm() -> tuple[np.ndarray, np.ndarray]:
        g, b, mean, variance = params.pop(0), params.pop(0), running.pop(0), running.pop(0)
        factor = g / np.sqrt(variance + net.epsilon)
        return factor, b - mean * factor

    if net.batch_norm:
        scale, shift = norm()
    out = []
    for i in range(len(net.sizes) - 1):
        w, b = params.pop(0), params.pop(0)
        if i == 0:
            w, b = scale[:, None] * w, b + shift @ w
        if net.batch_norm and i < len(net.sizes) - 2:
            factor, offset = norm()
            w, b = w * factor, b * factor + offset
        out.append((w, b))
    w, b = out[-1]
    if w.shape[1] == 1:
        out[-1] = (np.hstack([np.zeros_like(w), w]), np.concatenate([np.zeros(1), b]))
    return out
