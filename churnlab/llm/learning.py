"""Labelled rows and text counts shared by the two learned scorers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded, stored


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def known_labels(labels: DataFrame, label: str, in_training: Column, id_col: str) -> DataFrame:
    """(id, label) of all labelled training ids; an id with both labels has 1."""
    return labels.where(in_training & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label)).cast("int").alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, in_training: Column, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of all labelled training rows with distinct texts, stored."""
    chosen = known_labels(labels, label, in_training, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(bounded(stored(chosen)), "id")
    return stored(rows.groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label")))


def with_digest(base: DataFrame) -> DataFrame:
    """(doc_id, held_out, digest, text): rows of equal texts have equal digests; a null text counts as empty."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return base.select("doc_id", "held_out", digest.alias("digest"), "text")


def removed_by(raw: bytes, chars: bytes) -> int:
    """How many bytes of ``raw`` are among ``chars``."""
    return len(raw) - len(raw.translate(None, chars))


UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>{}[]^~=+_\\@"
STOPS = b".!?"
WORDS = re.compile(r"[^\W_]+")
