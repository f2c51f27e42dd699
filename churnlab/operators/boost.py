"""Boosted trees.

Training, cross-validation and scoring use Spark ML's ``GBTClassifier``.
For explanation and early stopping a fitted model is turned into a small
``Ensemble`` (arrays per tree, size bounded by the model, never by the data)
that can be rendered as a JVM-side CASE expression or shipped to Arrow
batches for TreeSHAP.

Scale convention: leaf values are in log-odds, so P(y=1) = sigmoid(margin).
A Spark GBT margin F relates by P = 1 / (1 + exp(-2F)); extraction therefore
multiplies every leaf by 2 x the tree weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.layout import stored
from ..functions.ranked import auc_of_entries, entries_of


@dataclass
class Tree:
    """One binary tree; ``feature[n] < 0`` marks a leaf.  Left is ``x <= threshold``."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    cover: list[float] = field(default_factory=list)

    def is_leaf(self, n: int) -> bool:
        return self.feature[n] < 0

    def nodes(self):
        return range(len(self.feature))


@dataclass
class Ensemble:
    trees: list[Tree]
    features: list[str]
    base: float = 0.0

    # ------------------------------------------------------------- expressions
    def tree_expr(self, t: int) -> Column:
        tree = self.trees[t]

        def node(n: int) -> Column:
            if tree.is_leaf(n):
                return F.lit(float(tree.value[n]))
            x = F.col(self.features[tree.feature[n]])
            return F.when(x <= F.lit(float(tree.threshold[n])), node(tree.left[n])) \
                .otherwise(node(tree.right[n]))

        return node(0)

    def margin_expr(self, n_trees: int | None = None) -> Column:
        k = len(self.trees) if n_trees is None else n_trees
        total = F.lit(float(self.base))
        for t in range(k):
            total = total + self.tree_expr(t)
        return total

    def prob_expr(self, n_trees: int | None = None) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin_expr(n_trees)))

    def truncate(self, n_trees: int) -> Ensemble:
        return Ensemble(self.trees[:n_trees], self.features, self.base)


def path_conditions(ens: Ensemble, t: int) -> dict[int, Column]:
    """Column predicate 'row reaches node n' for every node of tree t."""
    tree = ens.trees[t]
    out: dict[int, Column] = {0: F.lit(True)}
    stack = [0]
    while stack:
        n = stack.pop()
        if tree.is_leaf(n):
            continue
        x = F.col(ens.features[tree.feature[n]])
        thr = F.lit(float(tree.threshold[n]))
        out[tree.left[n]] = out[n] & (x <= thr)
        out[tree.right[n]] = out[n] & (x > thr)
        stack += [tree.left[n], tree.right[n]]
    return out


def fit_covers(ens: Ensemble, df: DataFrame) -> Ensemble:
    """Set node covers to the number of ``df`` rows reaching each node (one aggregate)."""
    aggs = []
    for t in range(len(ens.trees)):
        for n, cond in path_conditions(ens, t).items():
            aggs.append(F.count_if(cond).alias(f"c_{t}_{n}"))
    row = df.agg(*aggs).first()
    trees = []
    for t, tree in enumerate(ens.trees):
        cover = [float(row[f"c_{t}_{n}"]) for n in tree.nodes()]
        trees.append(Tree(tree.feature, tree.threshold, tree.left, tree.right, tree.value, cover))
    return Ensemble(trees, ens.features, ens.base)


def expected_value(ens: Ensemble) -> float:
    """Cover-weighted mean margin: the SHAP base value."""
    total = ens.base
    for tree in ens.trees:
        def ev(n: int) -> float:
            if tree.is_leaf(n):
                return tree.value[n]
            l, r = tree.left[n], tree.right[n]
            c = tree.cover[l] + tree.cover[r]
            if c <= 0:
                return 0.5 * (ev(l) + ev(r))
            return (tree.cover[l] * ev(l) + tree.cover[r] * ev(r)) / c
        total += ev(0)
    return total


# ------------------------------------------------------------------ Spark GBT
def gbt_fit(df: DataFrame, feature_cols: list[str], label: str, features_col: str = "features",
            **params):
    """Fit ``VectorAssembler`` + ``GBTClassifier``; returns the ``PipelineModel`` (M7/M8).

    Fill missing values before: the assembler rejects nulls and GBT rejects NaN.
    The rows are stored first: a fit runs several jobs for each tree.
    """
    asm = VectorAssembler(inputCols=feature_cols, outputCol=features_col)
    gbt = GBTClassifier(featuresCol=features_col, labelCol=label, **params)
    weight = [params["weightCol"]] if params.get("weightCol") else []
    with stored(df.select(*dict.fromkeys([*feature_cols, label, *weight]))) as rows:
        return Pipeline(stages=[asm, gbt]).fit(rows)


def score(model, df: DataFrame, id_col: str, keep: list[str] = ()) -> DataFrame:
    """``(id, score, prediction)`` with P(y=1) from the probability vector.

    ``vector_to_array(...)[1]`` stays in the JVM (no Python UDF).
    """
    out = model.transform(df)
    return out.select(id_col, *keep, vector_to_array("probability")[1].alias("score"),
                      F.col("prediction").cast("int").alias("prediction"))


def _gbt_stage(model):
    return model.stages[-1] if hasattr(model, "stages") else model


def ensemble_from_spark(model, feature_cols: list[str]) -> Ensemble:
    """Trees, weights and node counts of a fitted GBT, read from its saved form.

    The model is written to the session's shared checkpoint folder and its
    node table (``treeID, nodeData{id, prediction, rawCount, leftChild,
    rightChild, split}``) is read back with Spark: one collect of model size,
    instead of several JVM calls per node.
    """
    import uuid

    from ..sources.session import ensure_checkpoint_dir
    gbt = _gbt_stage(model)
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gbt-{uuid.uuid4().hex}"
    gbt.write().save(path)
    weights = list(gbt.treeWeights)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount",
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories").collect()
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    saved = spark._jvm.org.apache.hadoop.fs.Path(path)
    saved.getFileSystem(spark._jsc.hadoopConfiguration()).delete(saved, True)
    trees = []
    for t in sorted(by_tree):
        nodes = sorted(by_tree[t], key=lambda r: r["id"])
        w = weights[t]
        feat, thr, left, right, val, cov = [], [], [], [], [], []
        for r in nodes:
            inner = r["leftChild"] >= 0
            if inner and r["numCategories"] != -1:
                raise ValueError("categorical splits are not supported")
            feat.append(int(r["featureIndex"]) if inner else -1)
            thr.append(float(r["leftCategoriesOrThreshold"][0]) if inner else 0.0)
            left.append(int(r["leftChild"]))
            right.append(int(r["rightChild"]))
            val.append(2.0 * w * float(r["prediction"]))
            cov.append(float(r["rawCount"]))
        trees.append(Tree(feat, thr, left, right, val, cov))
    return Ensemble(trees, list(feature_cols), 0.0)


def split_importance(ens: Ensemble) -> list[tuple[str, int, float]]:
    """Per feature: number of splits and summed cover of its split nodes."""
    counts: dict[str, list] = {}
    for tree in ens.trees:
        for n in tree.nodes():
            if not tree.is_leaf(n):
                f = ens.features[tree.feature[n]]
                c = counts.setdefault(f, [0, 0.0])
                c[0] += 1
                c[1] += tree.cover[n] if tree.cover else 0.0
    return [(f, v[0], v[1]) for f, v in counts.items()]


def gain_importance(model, feature_cols: list[str]) -> list[tuple[str, float]]:
    imp = _gbt_stage(model).featureImportances.toArray()
    return list(zip(feature_cols, [float(x) for x in imp]))


def tree_values(ens: Ensemble, x: np.ndarray) -> np.ndarray:
    """Leaf value of every tree for every row (rows x trees), vectorised per tree level."""
    out = np.empty((x.shape[0], len(ens.trees)))
    rows = np.arange(x.shape[0])
    for t, tree in enumerate(ens.trees):
        feat = np.asarray(tree.feature)
        thr = np.asarray(tree.threshold, dtype=float)
        left, right = np.asarray(tree.left), np.asarray(tree.right)
        node = np.zeros(x.shape[0], dtype=int)
        while True:
            inner = feat[node] >= 0
            if not inner.any():
                break
            f = np.where(inner, feat[node], 0)
            go_left = x[rows, f] <= thr[node]
            node = np.where(inner, np.where(go_left, left[node], right[node]), node)
        out[:, t] = np.asarray(tree.value, dtype=float)[node]
    return out


def score_ensemble(df: DataFrame, ens: Ensemble, id_col: str, keep: list[str] = ()) -> DataFrame:
    """``(id, keep..., score)`` by walking the trees in Arrow batches; for the best prefix pass ``ens.truncate(k)``."""
    bc = df.sparkSession.sparkContext.broadcast(ens)
    feats, rest = list(ens.features), [id_col, *keep]
    extra = [f for f in feats if f not in rest]
    schema = StructType([df.schema[c] for c in rest] + [StructField("score", DoubleType())])

    def run(batches):
        for pdf in batches:
            margin = bc.value.base + tree_values(bc.value, pdf[feats].to_numpy(dtype=float)).sum(axis=1)
            out = pdf[rest].copy()
            out["score"] = 1.0 / (1.0 + np.exp(-margin))
            yield out

    return df.select(*rest, *extra).mapInPandas(run, schema)


def early_stopped(model, feature_cols: list[str], valid: DataFrame, label: str, patience: int = 20) -> tuple[Ensemble, float]:
    """The ensemble cut to its best validation prefix, and that prefix's AUC (M9)."""
    ens = ensemble_from_spark(model, feature_cols)
    curve = [(r["iteration"], r["auc"]) for r in staged_auc(ens, valid, label).collect()]
    best = best_iteration(curve, patience)
    return ens.truncate(best), dict(curve).get(best)


def cv_gbt_folds(df: DataFrame, feature_cols: list[str], label: str, fold_col: str, step_sizes=(0.1, 0.05, 0.01),
                 max_depths=(2, 5, None), patience: int = 20, num_folds: int = 5, parallelism: int = 4,
                 **params) -> DataFrame:
    """Per-fold grid CV with early stopping inside each fold.

    ``(grid_index, step_size, max_depth, fold, rounds, auc)``: rounds is the
    best prefix on the held-out fold.  A null depth is the library's default.
    The fits of a grid run as concurrent Spark jobs; ``metrics.mean_over_folds``
    gives the summary.
    """
    from concurrent.futures import ThreadPoolExecutor
    grid = [(i, s, d) for i, (s, d) in enumerate((s, d) for s in step_sizes for d in max_depths)]

    def one(task):
        (i, step, depth), fold = task
        setting = {"stepSize": step, **({} if depth is None else {"maxDepth": depth})}
        model = gbt_fit(df.where(F.col(fold_col) != fold), feature_cols, label, **{**params, **setting})
        ens, auc = early_stopped(model, feature_cols, df.where(F.col(fold_col) == fold), label, patience)
        return i, float(step), depth, fold, len(ens.trees), auc

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(one, [(g, f) for g in grid for f in range(num_folds)]))
    return df.sparkSession.createDataFrame(
        rows, "grid_index int, step_size double, max_depth int, fold int, rounds int, auc double")


def staged_auc(ens: Ensemble, df: DataFrame, label: str, max_trees: int | None = None,
               every: int = 1) -> DataFrame:
    """AUC of every tree prefix in one pass (M9b): ``(iteration, auc, pos, neg)``.

    Arrow batches walk all trees level by level in numpy (work linear in the
    number of trees; a per-prefix SQL expression would grow quadratically).
    Equal margins of a prefix are one entry of a task, sent by ranges of the
    score, so the shuffle has prefixes x ranges rows for each task.
    """
    k = len(ens.trees) if max_trees is None else min(max_trees, len(ens.trees))
    keep = [i for i in range(1, k + 1) if i % every == 0 or i == k]
    bc = df.sparkSession.sparkContext.broadcast((ens.truncate(k), keep))

    def margins(columns):
        e, its = bc.value
        x, y = np.column_stack(columns[:-1]).astype(float), columns[-1].astype(int)
        total = np.full(len(y), float(e.base))
        values = tree_values(e, x)
        for i in range(1, k + 1):
            # ((base + t0) + t1) + ...: the same association as the scoring expression
            total = total + values[:, i - 1]
            if i in its:
                yield i, total, y

    rows = entries_of(df.select(*ens.features, F.col(label).cast("int").alias("_y")), [*ens.features, "_y"], margins)
    found = [(i, *auc) for i, auc in sorted(auc_of_entries(rows).items())]
    return df.sparkSession.createDataFrame(found, "iteration int, auc double, pos long, neg long")


def best_iteration(curve_rows: list[tuple[int, float]], patience: int = 20) -> int:
    """Early stopping on a validation AUC curve (M9): stop ``patience`` rounds after the best."""
    best_k, best = 0, -math.inf
    for k, auc in sorted(curve_rows):
        if auc is not None and auc > best:
            best_k, best = k, auc
        elif k - best_k >= patience:
            break
    return best_k


def cv_gbt(df: DataFrame, feature_cols: list[str], label: str, fold_col: str,
           step_sizes=(0.1, 0.05, 0.01), max_depths=(2, 5), parallelism: int = 2,
           num_folds: int = 5, **params) -> DataFrame:
    """Grid cross-validation with ``CrossValidator(foldCol=...)``.

    Returns ``(step_size, max_depth, mean_auc, std_auc)`` per grid point; the
    evaluator uses ``numBins=0`` (exact AUC, no down-sampled curve).
    """
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features")
    data = asm.transform(df)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, **params)
    grid = (ParamGridBuilder().addGrid(gbt.stepSize, list(step_sizes))
            .addGrid(gbt.maxDepth, list(max_depths)).build())
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=grid, evaluator=ev, foldCol=fold_col,
                        numFolds=num_folds, parallelism=parallelism, collectSubModels=False)
    model = cv.fit(data)
    rows = []
    for i, (pm, avg, sd) in enumerate(zip(grid, model.avgMetrics, model.stdMetrics)):
        rows.append((i, float(pm[gbt.stepSize]), int(pm[gbt.maxDepth]), float(avg), float(sd)))
    spark = df.sparkSession
    return spark.createDataFrame(rows, "grid_index int, step_size double, max_depth int, "
                                       "mean_auc double, std_auc double")
