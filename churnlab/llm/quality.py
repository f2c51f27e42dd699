"""Quality score by Bradley-Terry pairwise ranking.

Each pair sets a good training document against a bad one; the probability that
the good one wins is the logistic function of the weighted difference of their
features.  Logistic loss on the differences gives the weights, and a document's
raw score is the weighted sum of its own features.  The threshold is the
quantile of the training rows' raw scores at the share of bad labels; raw
scores are shifted so that it has the score ``threshold`` (0.7).

All labelled training rows with distinct texts, with ``pairs_each`` pairs for each of the
larger class, fit the model and set the threshold; every document is scored.  The features
of each document are made once and stored.  Null and empty texts are scored as texts without words.  Without labels of both
classes every score is ``threshold``.  Rows repeat their result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selection import kth_smallest
from .learning import DIGITS, STOPS, SYMBOLS, UPPER, fold, known_labels, removed_by, with_digest
from .store import bounded, stored

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
PAIRS_EACH = 4
N_FEATURES = 16
#: Rows that are numbered in one task, and those of a class that may be broadcast with their features (under 10 MB).
NUMBERED_ROWS, BROADCAST_ROWS = 200_000, 40_000
#: Steps of a 52-bit scale.
SCALE_BITS = 52


def text_features(text: str) -> list[float]:
    raw = text.encode()
    words = raw.split()
    n, size = len(words) or 1, len(raw) or 1
    kinds = len(set(words))
    windows = len(words) - 4
    repeated = 1 - len({tuple(words[i:i + 5]) for i in range(windows)}) / windows if windows > 0 else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    per_word = [removed_by(raw, c) / n for c in (SYMBOLS, b"!", b"|", b"?", DIGITS, b".,;:")]
    return [*(min(x, 3.0) for x in per_word),
            removed_by(raw, UPPER) / size, removed_by(raw, STOPS) / n,
            1 - len(set(lines)) / len(lines) if lines else 0.0, repeated,
            kinds / n, math.sqrt(1 - kinds / n), math.log1p(len(words)) / 8, min(sum(map(len, words)) / n, 30.0) / 10,
            float(len(words) < 10), min(max(map(len, words), default=0), 200) / 100]


def with_features(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with an array column ``f``; the text column goes."""
    rest = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([text_features(x.as_py() or "") for x in batch.column(len(rest))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*rest, "f"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)
    return df.select(*rest, text_col).mapInArrow(run, f"{schema}, f array<double>")


def numbered(rows: DataFrame, total: int, per_task: int = NUMBERED_ROWS) -> DataFrame:
    """``rows`` with ``at``: their number within their label (0 or 1), from 0, in the order of (hash of id, id).

    A task numbers one range of the hash, whose values are spread evenly; the ranges' sizes say where each one starts.
    """
    from pyspark.sql import Window
    ranges = max(1, -(-total // per_task))
    order = F.xxhash64("id")
    within = F.least(F.floor((order.cast("double") / 2.0 ** 64 + 0.5) * ranges), F.lit(ranges - 1)).cast("int")
    rows = rows.withColumn("_range", within)
    starts, before = [], {0: 0, 1: 0}
    for r in sorted(rows.groupBy("label", "_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["label"], r["_range"], before[r["label"]]))
        before[r["label"]] += r["n"]
    where = rows.sparkSession.createDataFrame(starts, "label int, _range int, _start long")
    number = F.row_number().over(Window.partitionBy("label", "_range").orderBy(order, "id")) - 1
    return rows.withColumn("_number", number).join(F.broadcast(where), ["label", "_range"]) \
        .withColumn("at", F.col("_start") + F.col("_number")).drop("_range", "_start", "_number")


def preference_pairs(rows: DataFrame, pairs_each: int = PAIRS_EACH, per_task: int = NUMBERED_ROWS) -> DataFrame:
    """(label, features) of feature differences: each row of the larger class against ``pairs_each`` of the smaller.

    Rows are numbered within their class by hash; both directions of a pair are made.
    """
    numbers = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    few, many = sorted((0, 1), key=lambda x: numbers[x])
    all_rows = stored(numbered(rows, sum(numbers.values()), per_task).select("label", "at", "f"))
    small = all_rows.where(F.col("label") == few).select("at", F.col("f").alias("g"))
    large = all_rows.where(F.col("label") == many).select(F.col("f"), "at") \
        .withColumn("turn", F.explode(F.array(*map(F.lit, range(pairs_each))))) \
        .withColumn("at", F.pmod(F.col("at") * pairs_each + F.col("turn"), F.lit(numbers[few])))
    met = large.join(bounded(small, BROADCAST_ROWS), "at")
    sign = 1.0 if many == 1 else -1.0
    better = F.transform(F.arrays_zip("f", "g"), lambda p: (p["f"] - p["g"]) * sign)
    pairs = met.select(F.explode(F.array(F.struct(F.lit(1.0).alias("label"), better.alias("d")), F.struct(
        F.lit(0.0).alias("label"), F.transform(better, lambda x: -x).alias("d")))).alias("p"))
    return pairs.select("p.label", array_to_vector("p.d").alias("features"))


def quantile(df: DataFrame, col: str, share: float) -> float:
    """The quantile of a double column as ``percentile`` has it, to 2^-52 of the column's width; no task holds the column."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if lo == hi:
        return lo
    scaled = df.select(F.floor((F.col(col) - F.lit(lo)) / F.lit(hi - lo) * F.lit(2.0 ** SCALE_BITS)).cast("long").alias("x"))
    place = share * (n - 1)
    below = math.floor(place)
    a, b = (lo + x / 2.0 ** SCALE_BITS * (hi - lo) for x in kth_smallest(scaled, "x", [below + 1, min(below + 2, n)]))
    return a + (place - below) * (b - a)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
            threshold: float = THRESHOLD, pairs_each: int = PAIRS_EACH) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    known = stored(known_labels(labels, label, fold(id_col, FOLDS) != HELD_OUT, id_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"))
    made = stored(with_features(with_digest(base), "text"))
    # a text's features are the same in all its rows
    rows = stored(made.select(F.col("doc_id").alias("id"), "digest", "f").join(bounded(known), "id")
                  .groupBy("digest").agg(F.min("id").alias("id"), F.max("label").alias("label"), F.first("f").alias("f"))
                  .select("id", "label", "f"))
    if rows.select("label").distinct().count() < 2:
        return made.select("doc_id", "held_out", F.lit(threshold).alias("score"), F.lit(1).alias("predicted"))
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=50).fit(stored(preference_pairs(rows, pairs_each)))
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    raw = F.aggregate(F.zip_with("f", weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    bad = rows.agg(F.avg(1.0 - F.col("label"))).first()[0]
    cut = quantile(stored(rows.select(raw.alias("raw"))), "raw", float(bad))
    shift = math.log(threshold / (1 - threshold)) - cut
    score = 1.0 / (1.0 + F.exp(-(raw + F.lit(shift))))
    return made.select("doc_id", "held_out", score.alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
