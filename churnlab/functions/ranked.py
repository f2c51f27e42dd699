"""Exact ROC AUC of many models in one pass.

A task combines equal scores of a model into one entry (score, positives, negatives) and
sends the entries as arrays, one row for each model and range of the score.  A range is
compared in one task; across ranges only their sums matter, and those few come to the
driver.  So the shuffle has models x ranges rows for each task, whatever the number of
rows, and a score that very many rows share is one entry of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RANGES = 64
SCHEMA = "model int, part int, scores binary, pos binary, neg binary"


def combined(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each distinct score, ascending."""
    kinds, where = np.unique(scores, return_inverse=True)
    return kinds, *(np.bincount(where, weights=x, minlength=len(kinds)).astype(np.int64) for x in (pos, neg))


def compared(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[int, int, int]:
    """Positives, negatives, and twice the pairs in which the positive stands higher (ties count half)."""
    order = np.argsort(scores, kind="stable")
    pos, neg = pos[order].astype(object), neg[order].astype(object)
    below = np.cumsum(neg) - neg
    return int(pos.sum()), int(neg.sum()), int((pos * (2 * below + neg)).sum())


class Entries:
    """The entries of a task by model; ``rows`` has one for each model and range."""

    def __init__(self, ranges: int = RANGES):
        self.ranges, self.held = ranges, {}

    def add(self, model: int, margins: np.ndarray, y: np.ndarray) -> None:
        """Margins (log odds) and 0/1 labels of some rows."""
        found = (margins, y.astype(np.int64), 1 - y.astype(np.int64))
        before = self.held.get(model)
        self.held[model] = combined(*(np.concatenate(x) for x in zip(before, found, strict=True)) if before else found)

    def rows(self) -> list[tuple]:
        out = []
        for model, (margins, pos, neg) in self.held.items():
            part = np.minimum((self.ranges / (1 + np.exp(-np.clip(margins, -500, 500)))).astype(int), self.ranges - 1)
            out += [(model, int(r), *(x[part == r].tobytes() for x in (margins, pos, neg))) for r in np.unique(part)]
        return out

    def batch(self) -> pa.RecordBatch:
        rows = self.rows()
        kinds = [pa.int32()] * 2 + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          names=["model", "part", "scores", "pos", "neg"])


def range_sums(columns: list[list]) -> list[int]:
    """``compared`` of the entries of one range from several tasks (buffers of scores, positives, negatives)."""
    entries = (np.concatenate([np.frombuffer(x, kind) for x in c]) for c, kind in zip(columns, (np.float64, np.int64, np.int64), strict=True))
    return list(compared(*combined(*entries)))


def joined_ranges(parts: list[tuple[int, list[int]]]) -> tuple[float | None, int, int]:
    """AUC (None for one class), positives and negatives from the sums of all ranges of a model."""
    pos = neg = twice = 0
    for _, (p, n, t) in sorted(parts):
        twice += t + 2 * p * neg
        pos, neg = pos + p, neg + n
    return (twice / (2 * pos * neg) if pos and neg else None), pos, neg


def auc_of_entries(entries: DataFrame) -> dict[int, tuple[float | None, int, int]]:
    """{model: (AUC, positives, negatives)} of entry rows (SCHEMA); ranges x models sums come to the driver."""
    def total(rows: pa.Table) -> pa.Table:
        sums = range_sums([[x.as_buffer() for x in rows.column(c)] for c in ("scores", "pos", "neg")])
        return pa.table({"model": rows.column("model")[:1], "part": rows.column("part")[:1], "sums": pa.array([[str(v) for v in sums]])})

    found: dict[int, list] = {}
    for r in entries.groupBy("model", "part").applyInArrow(total, "model int, part int, sums array<string>").collect():
        found.setdefault(r["model"], []).append((r["part"], [int(v) for v in r["sums"]]))
    return {m: joined_ranges(parts) for m, parts in found.items()}


def entries_of(df: DataFrame, columns: list[str], margins) -> DataFrame:
    """Entry rows of ``df``; ``margins(batch of columns as arrays)`` yields (model, margins, labels)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Entries()
        for batch in batches:
            for model, m, y in margins([c.to_numpy(zero_copy_only=False) for c in batch.columns]):
                held.add(model, m, y)
        yield held.batch()

    return df.select(*columns).mapInArrow(run, SCHEMA)
