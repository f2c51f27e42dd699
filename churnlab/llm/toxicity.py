"""Toxicity score: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word stems (first 4 to 6 letters) that are
far more frequent among toxic than among other training documents.  The
features of a whole text are the densities of lexicon words and stems, hits
near a second-person pronoun, capital, exclamation and other punctuation
rates, the rate of obfuscated words (letters with digits or symbols between)
and of those that are lexicon words once read plainly.  Four fifths of the
training rows fit the trees, the rest the calibration.

Every term of at least ``min_share`` of the toxic training documents and ``min_log_odds``
enters; there are at most ``1 / min_share`` times as many as a toxic document has on average.

All labelled training rows with distinct texts fit the model; every document is scored.  The
features of each document are made once and stored.  Null and empty texts have zero features
and get the score of such a text.  Without labels of both classes every score
is 0.  Rows repeat their result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import STOPS, SYMBOLS, UPPER, WORDS, fold, known_labels, removed_by, training_rows, with_digest
from .store import bounded, stored, without_rows

FOLDS, HELD_OUT = 5, 0
MIN_SHARE = 0.01
MIN_LOG_ODDS = 2.0
STEMS = (4, 5, 6)
NEAR = 5
TREES, DEPTH = 20, 4
# Second-person words of the four languages, and plain readings of look-alike characters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros os su".split())
LOOKALIKES = str.maketrans("@4301!57$", "aaeoiists", "*.-_|")
OBFUSCATED = re.compile(r"[^\W\d_]+(?:[@$*!|0-9._-]+[^\W\d_]+)+")
FEATURES = ("word_density", "stem_density", "hits", "near_density", "plain_density", "obfuscated", "capitals",
            "exclaim", "stops", "symbols", "words")


def learn_lexicon(train: DataFrame, min_share: float = MIN_SHARE, min_log_odds: float = MIN_LOG_ODDS) -> dict[str, float]:
    """Terms (words, and stems with their length in front) by their smoothed log odds among toxic rows."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(WORDS.findall(text.lower()))
                found |= {f"{n}:{w[:n]}" for w in found if w.isalpha() for n in STEMS if len(w) > n}
                seen[label].update(found)
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"term": names, "neg": [seen[0][t] for t in names],
                                          "pos": [seen[1][t] for t in names]},
                                         schema=pa.schema([("term", pa.string()), ("neg", pa.int64()), ("pos", pa.int64())]))

    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    neg, pos = sizes.get(0, 0), sizes.get(1, 0)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    rows = train.select("text", "label").mapInArrow(terms, "term string, neg long, pos long") \
        .groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")) \
        .where(F.col("pos") >= max(3.0, min_share * pos)).select("term", odds.alias("odds")) \
        .where(F.col("odds") >= min_log_odds)
    return {r["term"]: r["odds"] for r in rows.collect()}


def text_features(text: str, words: frozenset, stems: frozenset) -> tuple:
    raw = text.encode()
    found = WORDS.findall(text.lower())
    n = len(found) or 1
    word_at = [i for i, w in enumerate(found) if w in words]
    stem_at = [i for i, w in enumerate(found) if w[:5] in stems or w[:4] in stems or w[:6] in stems]
    near = 0
    if word_at or stem_at:
        person = {i + d for i, w in enumerate(found) if w in SECOND_PERSON for d in range(-NEAR, NEAR + 1)}
        near = sum(i in person for i in {*word_at, *stem_at})
    hidden = OBFUSCATED.findall(text)
    plain = sum(w.lower().translate(LOOKALIKES) in words for w in hidden)
    size = len(raw) or 1
    return (len(word_at) / n, len(stem_at) / n, math.log1p(len({*word_at, *stem_at})), near / n, plain / n,
            len(hidden) / n, removed_by(raw, UPPER) / size, raw.count(b"!") / n, removed_by(raw, STOPS) / n,
            removed_by(raw, SYMBOLS) / size, math.log1p(len(found)))


def with_features(df: DataFrame, lexicon: dict[str, float], text_col: str) -> DataFrame:
    """``df`` with a double column for each of FEATURES; the text column goes."""
    words = frozenset(t for t in lexicon if ":" not in t)
    stems = frozenset(t[2:] for t in lexicon if ":" in t)
    rest = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_features(x.as_py() or "", words, stems) for x in batch.column(len(rest))]
            columns = [pa.array(c, pa.float64()) for c in zip(*made, strict=True)] or [pa.array([], pa.float64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*rest, *FEATURES])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema] + [f"{c} double" for c in FEATURES])
    return df.select(*rest, text_col).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    train = training_rows(docs, labels, label, fold(id_col, FOLDS) != HELD_OUT, id_col, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"))
    if train.select("label").distinct().count() < 2:
        return base.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    lexicon = learn_lexicon(train)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    made = stored(with_features(with_digest(base), lexicon, "text"))
    known = stored(known_labels(labels, label, fold(id_col, FOLDS) != HELD_OUT, id_col))
    # a text's features are the same in all its rows
    rows = made.withColumnRenamed("doc_id", "id").join(bounded(known), "id").groupBy("digest") \
        .agg(F.min("id").alias("id"), F.max("label").alias("label"), *[F.first(c).alias(c) for c in FEATURES])
    rows = stored(assemble.transform(rows).select("id", "label", "features"))
    part = F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=10, seed=7).fit(rows.where(part != 0))
    chance = vector_to_array("probability")[1]
    held = trees.transform(rows.where(part == 0)).select(F.col("label").cast("double").alias("label"), chance.alias("chance"))
    level = IsotonicRegression(featuresCol="chance", predictionCol="level").fit(held)
    scored = trees.transform(assemble.transform(made)) \
        .select("doc_id", "held_out", chance.alias("chance"))
    # isotonic levels are flat in places; a small part of the trees' own value keeps the order inside one
    score = F.least(F.greatest(0.99 * F.col("level") + 0.01 * F.col("chance"), F.lit(0.0)), F.lit(1.0))
    return level.transform(scored).select("doc_id", "held_out", score.alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the score rejects."""
    return without_rows(docs, id_col, lambda named: toxicity(named, labels, id_col, text_col).where("predicted = 1"), labels)
