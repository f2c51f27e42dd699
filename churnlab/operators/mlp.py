"""Multilayer perceptron on Spark.

Network (as in the reference): input -> linear hidden layer -> softplus ->
softplus -> softmax over 2 classes, trained by mini-batch SGD on the KL /
cross-entropy loss.

Distribution: parallel SGD with parameter averaging (Zinkevich et al. 2010).
Each epoch is one Spark job: ``mapInPandas`` runs batch-128 SGD over the
Arrow batches of every partition starting from the broadcast weights, emits
``n x weights`` per partition and model, and Spark sums whole arrays
(``functions.vectors``) into one per model - the driver only ever holds model
parameters.  Several models (learning rates x CV folds) train in the same
pass: a row updates every model whose hold-out fold is not its own.  With one
partition the updates are exactly sequential SGD.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import sum_arrays

SOFTPLUS_THRESHOLD = 20.0
CLIP = 500.0


# ------------------------------------------------------------------ numpy core
def softplus(x: np.ndarray, threshold: float = SOFTPLUS_THRESHOLD) -> np.ndarray:
    safe = np.minimum(x, threshold)
    return np.where(x < threshold, np.log1p(np.exp(safe)), x)


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def layer_widths(hidden: int | list[int]) -> list[int]:
    """An integer means the three equal hidden layers of the numpy script."""
    return [hidden] * 3 if isinstance(hidden, int) else list(hidden)


def init_weights(d: int, h: int | list[int], out: int = 2, seed: int = 0,
                 feature_weight: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Xavier-style normal init; optional feature-informed first layer."""
    rng = np.random.RandomState(seed)
    sizes = [d, *layer_widths(h), out]
    weights = [(rng.randn(m, n) * np.sqrt(2.0 / (m + n)), np.zeros(n)) for m, n in zip(sizes, sizes[1:])]
    if feature_weight is not None:
        w0 = np.asarray(feature_weight, float)[:, None] + weights[0][0]
        weights[0] = (np.abs(w0 / np.max(w0)), weights[0][1])
    return weights


def forward(x: np.ndarray, weights, activation: str = "softplus", masks=None, first_linear: bool = True):
    """Pre-activations and activations of every layer (the first one linear unless told otherwise).

    The two-way softmax output is a sigmoid of the difference of its inputs.

    ``masks[i]`` (inverted dropout, already scaled) multiplies the output of
    hidden layer i before it feeds the next layer.
    """
    act = softplus if activation == "softplus" else np.tanh
    a_l, h_l = [], [x]
    h = x
    for i, (w, b) in enumerate(weights):
        a = b + h @ w
        if i == 0 and first_linear:
            h = a
        elif i == len(weights) - 1:
            h = softmax(a)
        else:
            h = act(a)
        if masks is not None and i < len(weights) - 1 and masks[i] is not None:
            h = h * masks[i]
        a_l.append(a)
        h_l.append(h)
    return a_l, h_l


def _act_grad(a: np.ndarray, activation: str) -> np.ndarray:
    if activation == "tanh":
        return 1.0 - np.tanh(a) ** 2
    return 1.0 / (1.0 + np.exp(-np.clip(a, -CLIP, CLIP)))


ADAM_B1, ADAM_B2, ADAM_EPS = 0.9, 0.999, 1e-7


def sgd_step(weights, x: np.ndarray, y: np.ndarray, lr: float, activation: str = "softplus",
             linear_grad: str = "identity", smoothing: float = 0.0, dropout: float = 0.0,
             rng: np.random.RandomState | None = None, adam=None, first_linear: bool = True):
    """One mini-batch update; all deltas first, then every layer (as the reference).

    ``adam`` = (m, v, t) switches the update to Adam and returns
    ``(weights, (m, v, t))``; otherwise plain SGD returns the weights.
    ``dropout`` drops hidden units with that probability (inverted scaling).
    """
    n_layers = len(weights)
    masks = None
    if dropout > 0:
        rng = rng or np.random.RandomState(0)
        masks = [(rng.random_sample((len(y), w.shape[1])) >= dropout) / (1.0 - dropout)
                 for w, _ in weights[:-1]]
    a_l, h_l = forward(x, weights, activation, masks, first_linear)
    target = np.eye(2)[y]
    if smoothing:
        target = target * (1 - smoothing) + smoothing / 2
    delta = [None] * n_layers
    delta[-1] = h_l[-1] - target
    for i in range(n_layers - 2, -1, -1):
        back = delta[i + 1] @ weights[i + 1][0].T
        if masks is not None:
            back = back * masks[i]
        if i == 0 and first_linear and linear_grad == "identity":
            delta[i] = back
        else:
            delta[i] = _act_grad(a_l[i], activation) * back
    bs = len(y)
    grads = [((h_l[i].T @ delta[i]) / bs, delta[i].mean(axis=0)) for i in range(n_layers)]
    if adam is None:
        return [(w - lr * gw, b - lr * gb) for (w, b), (gw, gb) in zip(weights, grads)]
    m, v, t = adam
    t = t + 1
    new_w, new_m, new_v = [], [], []
    for (w, b), (gw, gb), (mw, mb), (vw, vb) in zip(weights, grads, m, v):
        mw, mb = ADAM_B1 * mw + (1 - ADAM_B1) * gw, ADAM_B1 * mb + (1 - ADAM_B1) * gb
        vw, vb = ADAM_B2 * vw + (1 - ADAM_B2) * gw ** 2, ADAM_B2 * vb + (1 - ADAM_B2) * gb ** 2
        c1, c2 = 1 - ADAM_B1 ** t, 1 - ADAM_B2 ** t
        new_w.append((w - lr * (mw / c1) / (np.sqrt(vw / c2) + ADAM_EPS),
                      b - lr * (mb / c1) / (np.sqrt(vb / c2) + ADAM_EPS)))
        new_m.append((mw, mb))
        new_v.append((vw, vb))
    return new_w, (new_m, new_v, t)


def flatten(weights) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b.ravel()]) for w, b in weights])


def unflatten(vec: np.ndarray, shapes) -> list:
    out, pos = [], 0
    for (r, c) in shapes:
        w = vec[pos:pos + r * c].reshape(r, c)
        pos += r * c
        b = vec[pos:pos + c]
        pos += c
        out.append((w, b))
    return out


def shapes_of(weights) -> list[tuple[int, int]]:
    return [w.shape for w, _ in weights]


# ------------------------------------------------------------------ Spark
@dataclass
class Spec:
    """One model trained in the shared pass: its learning rate and hold-out fold."""

    lr: float
    holdout: int | None = None


def mlp_score(df: DataFrame, weights, feature_cols: list[str], id_col: str,
              keep: list[str] = (), activation: str = "softplus",
              layer: int | None = None, first_linear: bool = True) -> DataFrame:
    """``(id, keep..., p0, p1, score)`` by a forward pass in Arrow batches.

    ``layer=1`` also returns the first hidden layer's activations (M31).
    """
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast([(w.copy(), b.copy()) for w, b in weights])
    fields = [df.schema[id_col]] + [df.schema[c] for c in keep] + [
        StructField("p0", DoubleType()), StructField("p1", DoubleType()),
        StructField("score", DoubleType())]
    if layer is not None:
        fields.append(StructField("activation", ArrayType(DoubleType())))

    def run(batches):
        ws = bc.value
        for pdf in batches:
            x = pdf[feature_cols].to_numpy(dtype=float)
            _, h_l = forward(x, ws, activation, first_linear=first_linear)
            out = {id_col: pdf[id_col].to_numpy()}
            for c in keep:
                out[c] = pdf[c].to_numpy()
            out["p0"], out["p1"] = h_l[-1][:, 0], h_l[-1][:, 1]
            out["score"] = h_l[-1][:, 1]
            if layer is not None:
                out["activation"] = list(h_l[layer])
            yield pd.DataFrame(out)

    return df.select(id_col, *keep, *feature_cols).mapInPandas(run, StructType(fields))


def _zeros_like(weights):
    return [(np.zeros_like(w), np.zeros_like(b)) for w, b in weights]


def _pack(weights, adam) -> np.ndarray:
    if adam is None:
        return flatten(weights)
    m, v, t = adam
    return np.concatenate([flatten(weights), flatten(m), flatten(v), [float(t)]])


def _unpack(vec: np.ndarray, shapes, optimizer: str):
    size = sum(r * c + c for r, c in shapes)
    weights = unflatten(vec[:size], shapes)
    if optimizer != "adam":
        return weights, None
    m = unflatten(vec[size:2 * size], shapes)
    v = unflatten(vec[2 * size:3 * size], shapes)
    return weights, (m, v, float(vec[3 * size]))


#: Rows shuffled together; a multiple of the usual mini-batch sizes.
SHUFFLE_ROWS = 8192


def _chunks(batches, size: int = SHUFFLE_ROWS):
    """The rows of a partition in frames of ``size`` rows (the last may be shorter), whatever the Arrow batches."""
    held, rows = [], 0
    for pdf in batches:
        while len(pdf):
            held.append(pdf.iloc[:size - rows])
            rows += len(held[-1])
            pdf = pdf.iloc[len(held[-1]):]
            if rows == size:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


PACKED = "x binary, y binary, folds binary"


def _packed(df: DataFrame, feature_cols, label, fold_col) -> DataFrame:
    """A row for each chunk of a partition: its features, labels and folds as whole arrays, converted once and not in every epoch."""
    def run(batches):
        for pdf in _chunks(batches):
            folds = pdf[fold_col].to_numpy(dtype=float) if fold_col else np.zeros(len(pdf))
            arrays = pdf[feature_cols].to_numpy(dtype=float), pdf[label].to_numpy().astype(np.int64), folds
            yield pd.DataFrame([[np.ascontiguousarray(a).tobytes() for a in arrays]], columns=["x", "y", "folds"])

    return df.select(*dict.fromkeys([*feature_cols, label, *([fold_col] if fold_col else [])])).mapInPandas(run, PACKED)


def _epoch(rows: DataFrame, states: list[np.ndarray], shapes, specs: list[Spec],
           batch: int, seed: int, epoch: int, activation, linear_grad,
           smoothing, dropout, optimizer, first_linear=True) -> list[np.ndarray]:
    """One distributed epoch for every model over ``_packed`` rows; returns the averaged state per model."""
    bc = rows.sparkSession.sparkContext.broadcast(states)
    schema = StructType([StructField("model", IntegerType()), StructField("w", ArrayType(DoubleType()))])

    def train(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx is not None else 0
        drop_rng = np.random.RandomState((seed * 1_000_003 + epoch * 7919 + part) % (2 ** 32))
        current = [_unpack(v, shapes, optimizer) for v in bc.value]
        seen = [0] * len(specs)
        for chunk in (c for pdf in batches for c in pdf.itertuples(index=False)):
            y_all, folds = np.frombuffer(chunk.y, np.int64), np.frombuffer(chunk.folds)
            x_all = np.frombuffer(chunk.x).reshape(len(y_all), -1)
            for m, spec in enumerate(specs):
                mask = np.ones(len(y_all), bool) if spec.holdout is None else folds != spec.holdout
                x, y = x_all[mask], y_all[mask]
                if len(y) == 0:
                    continue
                idx = np.arange(len(y))
                np.random.RandomState(seed).shuffle(idx)
                ws, adam = current[m]
                for s in range(0, len(y), batch):
                    sel = idx[s:s + batch]
                    out = sgd_step(ws, x[sel], y[sel], spec.lr, activation, linear_grad,
                                   smoothing, dropout, drop_rng, adam, first_linear)
                    ws, adam = out if adam is not None else (out, None)
                current[m] = (ws, adam)
                seen[m] += len(y)
        out = [(m, np.append(_pack(*current[m]) * seen[m], seen[m])) for m in range(len(specs)) if seen[m]]
        yield pd.DataFrame(out, columns=["model", "w"])

    per_part = rows.mapInPandas(train, schema)
    out = [v.copy() for v in states]
    for r in sum_arrays(per_part, ["model"], "w").collect():  # models x parameters: bounded by the model size
        sums = np.array(r["w"])
        out[r["model"]] = sums[:-1] / sums[-1]
    return out


def mlp_fit(df: DataFrame, feature_cols: list[str], label: str, hidden: int | list[int] = 64,
            epochs: int = 40, lr: float = 0.01, batch: int = 128, seed: int = 1,
            init_seed: int = 0, activation: str = "softplus", linear_grad: str = "identity",
            smoothing: float = 0.0, dropout: float = 0.0, optimizer: str = "sgd",
            specs: list[Spec] | None = None, fold_col: str | None = None,
            init=None, on_epoch=None, first_linear: bool = True):
    """Train one model (or several ``specs`` in the same pass); returns the weights.

    ``optimizer`` is 'sgd' (the numpy script) or 'adam' (the Keras script; its
    moments are averaged with the weights).  ``on_epoch(epoch, weights_list)``
    runs after every epoch (history, early stopping: return True to stop).
    The rows are packed once and kept for the epochs.
    """
    specs = specs or [Spec(lr)]
    base = init or init_weights(len(feature_cols), hidden, 2, init_seed)
    shapes = shapes_of(base)
    adam0 = (_zeros_like(base), _zeros_like(base), 0) if optimizer == "adam" else None
    states = [_pack([(w.copy(), b.copy()) for w, b in base], adam0) for _ in specs]
    rows = _packed(df, feature_cols, label, fold_col).persist()
    for e in range(epochs):
        states = _epoch(rows, states, shapes, specs, batch, seed,
                        e, activation, linear_grad, smoothing, dropout, optimizer, first_linear)
        weights = [_unpack(v, shapes, optimizer)[0] for v in states]
        if on_epoch is not None and on_epoch(e + 1, weights):
            break
    rows.unpersist()
    weights = [_unpack(v, shapes, optimizer)[0] for v in states]
    return weights if len(specs) > 1 else weights[0]


def early_stopping(score_fn, patience: int):
    """``on_epoch`` callback: stop after ``patience`` epochs without a better score.

    ``score_fn(weights) -> float`` (e.g. validation AUC, maximised).  The
    returned callback exposes ``best`` = (epoch, score, weights).
    """
    state = {"best": (0, -np.inf, None)}

    def callback(epoch, weights_list):
        score = score_fn(weights_list[0])
        if score is not None and score > state["best"][1]:
            state["best"] = (epoch, score, weights_list[0])
        return epoch - state["best"][0] >= patience

    callback.state = state
    return callback


def builtin_mlp(df: DataFrame, feature_cols: list[str], label: str, layers: list[int],
                max_iter: int = 100, seed: int = 1):
    """Spark's ``MultilayerPerceptronClassifier`` baseline (sigmoid + softmax, L-BFGS)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features")
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers,
                                         maxIter=max_iter, seed=seed)
    return Pipeline(stages=[asm, mlp]).fit(df)
