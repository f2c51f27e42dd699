"""Spelling variant grouping: an edit-distance-1 join of the corpus's words by asymmetric q-chunks.

Of two words that differ by one inserted, deleted or replaced code point, the longer
(of equal lengths the smaller) is cut into two disjoint chunks, its halves; the other
gives its grams of the same lengths at the same place, or shifted by the difference of
the lengths, which is at most one.  One edit leaves one of the two chunks whole, so near
words share a (length, chunk, place).

A common chunk (an ending, a prefix) would bring thousands of words together.  So the
part that the shared chunk leaves over is cut into two chunks in the same way, of which
the edit again leaves one whole: words meet on a half and a quarter of the word, that is
on a start and an end of it.  Candidates are verified by their edit distance.

Words are counted over all texts: maximal runs of letters, A-Z lower-cased, with a code
point deleted from the runs that a checksum of the document's id and the run picks.
Words need ``min_length`` code points and ``min_count`` occurrences.  A word's form is
its most frequent near word, if that has at least ``ratio`` times its occurrences; its
root is the end of the chain of forms, found by pointer jumping (each form is ``ratio``
times as frequent as the word before, so few rounds do).

Null texts have no words, a null id counts as the empty text, rows count as often as
they occur, ties take the smallest word in code-point order, other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
PICK = 31
#: Code points of a word (fixed by the query's contract).
LETTERS = "A-Za-zÀ-ÿ"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000


def varied(run: str, prefix: int, pick: int = PICK) -> str:
    """``run`` without one code point if the checksum, begun with the id's ``prefix``, picks it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % pick:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, pick: int = PICK) -> DataFrame:
    """(word, n), stored: the words with their occurrences over all texts."""
    long_runs = re.compile(f"[{LETTERS}]{{{min_length},}}")  # deleting makes no run longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    start = zlib.crc32(f"{name or ''}:".encode())
                    body = text.as_buffer().to_pybytes().translate(LOWER).decode()
                    for found, n in Counter(long_runs.findall(body)).items():
                        seen[varied(found, start, pick)] += n
                    if len(seen) > FLUSH:
                        yield made()
                        seen = Counter()
        yield made()

    counted = docs.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.where((F.length("word") >= min_length) & (F.col("n") >= min_count)))


def _kept(size: Column) -> list[tuple[Column, Column]]:
    """The four signatures of a word of ``size`` code points, each all but a quarter: the lengths of its start and its end."""
    left = F.floor(size / 2).cast("int")
    right = size - left
    first, third = F.floor(left / 2).cast("int"), F.floor(right / 2).cast("int")
    return [(left + third, F.lit(0)), (left, right - third), (first, right), (F.lit(0), size - first)]


def _signed(words: DataFrame, size: Column) -> DataFrame:
    """(word, n, size, key): the signatures under which a partner of ``size`` code points, or the word itself, is found."""
    def key(number: int, start: Column, end: Column) -> Column:
        tail = F.substring(F.col("word"), F.length("word") - end + 1, end)
        return F.xxhash64(size, F.lit(number), F.substring(F.col("word"), F.lit(1), start), tail)
    keys = F.array(*[key(i, *kept) for i, kept in enumerate(_kept(size))])
    return words.select("word", "n", size.alias("size"), F.explode(keys).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), stored: every pair of near words once; ``a`` is the longer, or of equal lengths the smaller."""
    own = F.length("word")
    chunks = _signed(words, own).select(F.col("word").alias("a"), F.col("n").alias("na"), "key")
    grams = _signed(words, own).union(_signed(words, own + 1)).select(F.col("word").alias("b"), F.col("n").alias("nb"), "size", "key")
    met = chunks.join(grams, "key").where(F.length("a") == F.col("size")) \
        .where((F.length("b") < F.col("size")) | (F.col("a") < F.col("b")))
    return stored(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), stored: the ends of the chains of ``forms`` (word, form), each row of which has a form."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, pick: int = PICK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = word_counts(docs, id_col, text_col, min_length, min_count, pick)
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")) \
        .union(pairs.select("b", "a", "na"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    formed = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    rows = stored(words.join(found, "word", "left").withColumn("formed", formed)
                  .select("word", F.col("formed.near").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                          (-F.col("formed.less")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
