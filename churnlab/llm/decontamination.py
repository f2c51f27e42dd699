"""Benchmark decontamination: BM25 retrieval of test items for every training passage.

The inverted index is built over entries of the benchmark's items: the item, its
question of at least ``question_words`` words cut into pieces of at most half a passage,
and such pieces of the whole item if it is longer.  Impacts are BM25 term weights divided by the entry's own
total, so an entry scores 1 against itself, and an item's score is that of its
best entry.  Every document is cut into passages of ``passage`` words that overlap
by half, so a copied piece always lies inside one; each passage is a query.
Retrieval follows block-max WAND, for all passages of an Arrow batch at once:

1. a passage whose terms' greatest impacts do not sum to the threshold is skipped;
2. entries stand in blocks of 8 with the greatest impact of each term in the block;
   a block is skipped where those sums stay below the threshold;
3. the entries of the blocks that are left are scored exactly, and the items of all
   at or above the threshold are retrieved.

A retrieved item counts as leaked if its question and its answer overlap the
text around the passage (the item's length, at least half a passage, on each
side): the shares of their 3-word grams found there.  Both must reach ``overlap``, or a question of at least ``question_words`` words alone
``question_only`` (a shorter one stands in clean texts too).  Items with
columns ``question`` and ``answer`` are taken as they are; a plain ``text`` is split
before its last line, or last sentence, or in the middle.

Words are runs of letters and digits, lower-cased.  The index of up to ``max_items``
items and ``max_chars`` characters goes to all tasks; more take more passes, counted
first, built and written one after the other.  Only an item that is longer by itself
passes that bound.  Postings and block maxima are sparse, in proportion to the words.  The number and mean length of items and the items
that hold a word are counted over the whole benchmark, so passes do not change
scores.  Documents are not shuffled.  Null texts and items have no words and are never retrieved;
equal items are reported each; repeated rows repeat their result; columns other
than ids and texts are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored, without_rows
from .words import NOT_ALNUM, blocks, distinct, shingles, word_hashes, word_spans

PASSAGE = 128
THRESHOLD = 0.5
OVERLAP = 0.5
QUESTION_ONLY = 0.8
GRAM = 3
BLOCK = 8
#: Words that a question needs to have an entry of its own and to be a leak without its answer.
QUESTION_WORDS = 8
MAX_ITEMS = 16_384
MAX_CHARS = 8 << 20
SHARD_WORDS = 1 << 16
K1, B = 1.2, 0.75
_U = np.uint64


def _hashed(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, raw, off in blocks(pc.utf8_lower(pa.array(texts, pa.string()))):
        starts, ends, rows = word_spans(raw, off, NOT_ALNUM)
        out += np.split(word_hashes(raw, starts, ends), rows[1:-1])
    return out


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of a plain item."""
    body = (text or "").strip()
    for cut in (body.rfind("\n"), max((m.end() for m in re.finditer(r"[.!?]\s+", body)), default=-1)):
        if cut > 0 and body[:cut].strip() and body[cut:].strip():
            return body[:cut], body[cut:]
    words = body.split()
    half = (len(words) + 1) // 2
    return " ".join(words[:half]), " ".join(words[half:])


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    return distinct(shingles(words, np.array([0, len(words)]), k)[0])


def _own_grams(part: np.ndarray) -> tuple[int, np.ndarray]:
    """The gram length of a question or an answer, and its distinct grams."""
    k = min(GRAM, len(part))
    return k, _grams(part, k) if k else part


def _share(own: tuple[int, np.ndarray], around: np.ndarray) -> float:
    """Share of the distinct grams of a part that ``around`` holds."""
    k, grams = own
    return float(np.isin(grams, _grams(around, k)).mean()) if k else 0.0


def _entries(question: np.ndarray, whole: np.ndarray, size: int, question_words: int) -> list[np.ndarray]:
    """What is indexed of an item: all of it, and pieces of its question and of itself of at most ``size`` words."""
    cuts = [whole]
    for part, least in ((question, max(1, question_words)), (whole, 1)):
        if len(part) >= least:
            cuts += np.array_split(part, -(-len(part) // size))
    return list({c.tobytes(): c for c in cuts}.values())


def _ranges(first: np.ndarray, term: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the terms' lists, one after the other, and who asked for each."""
    width = first[term + 1] - first[term]
    return np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[term], width), np.repeat(asked, width)


class Counts:
    """Number and mean length of all items, and how many of them hold each of the ``known`` (sorted) words."""

    def __init__(self, n: int, mean: float, known: np.ndarray, held: np.ndarray):
        self.mean = mean or 1.0
        self.known, self.idf = known, np.log1p((n - held + 0.5) / (held + 0.5))

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Counts:
        known, held = np.unique(np.concatenate([distinct(w) for w in items] or [np.zeros(0, _U)]), return_counts=True)
        return cls(len(items), sum(map(len, items)) / max(1, len(items)), known, held)


class ItemIndex:
    """BM25 inverted index of the entries of items, with the greatest impact of each term in each block that holds it."""

    def __init__(self, ids: list[int], questions: list[str], answers: list[str], everything: Counts | list[np.ndarray],
                 passage: int = PASSAGE, question_words: int = QUESTION_WORDS):
        self.ids, hashed, answered = ids, _hashed(questions), _hashed(answers)
        self.questions, self.answers = [_own_grams(w) for w in hashed], [_own_grams(w) for w in answered]
        whole = [np.concatenate(x) for x in zip(hashed, answered, strict=True)]
        self.lengths, self.alone = [len(w) for w in whole], [len(w) >= question_words for w in hashed]
        made = [_entries(q, w, max(1, passage // 2), question_words) for q, w in zip(hashed, whole, strict=True)]
        words = [w for entries in made for w in entries]
        self.owner = np.repeat(np.arange(len(ids)), [len(x) for x in made]).astype(np.int64)
        lengths = np.array([len(w) for w in words], float)
        counts = everything if isinstance(everything, Counts) else Counts.of(everything)
        term, item, impact = [], [], []
        for i, w in enumerate(words):
            kinds, tf = np.unique(w, return_counts=True)
            if not len(kinds):
                continue
            weight = counts.idf[np.searchsorted(counts.known, kinds)] * tf * (K1 + 1) / (
                tf + K1 * (1 - B + B * lengths[i] / counts.mean))
            term.append(kinds)
            item.append(np.full(len(kinds), i))
            impact.append(weight / weight.sum())
        empty = [np.zeros(0, _U)]
        terms, items = np.concatenate(term or empty), np.concatenate(item or [np.zeros(0, np.int64)])
        impacts = np.concatenate(impact or [np.zeros(0)])
        self.terms = distinct(terms)
        at = np.searchsorted(self.terms, terms)
        order = np.lexsort((items, at))
        at, self.items, self.impacts = at[order], items[order], impacts[order]
        self.first = np.searchsorted(at, np.arange(len(self.terms) + 1))
        # a term's postings in one block are neighbours
        self.blocks = -(-max(1, len(words)) // BLOCK)
        cell = at * self.blocks + self.items // BLOCK
        new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        self.block_of = self.items[new] // BLOCK
        self.block_max = np.maximum.reduceat(self.impacts, new) if len(new) else np.zeros(0)
        self.block_first = np.searchsorted(at[new], np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.impacts, self.first[:-1]) if len(self.terms) else np.zeros(0)
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[(self.terms >> _U(48)).astype(np.int64)] = True

    def retrieve(self, words: np.ndarray, rows: np.ndarray, passage: int, threshold: float):
        """(row, passage start, item, score) of all items at or above the threshold, for rows of hashed words."""
        half = passage // 2
        size = np.diff(rows)
        halves = -(-size // half)
        base = np.cumsum(halves) - halves
        maybe = np.flatnonzero(self.known[(words >> _U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
        sure = self.terms[at] == words[maybe]
        place, term = maybe[sure], at[sure]
        if not len(place):
            return
        row = np.searchsorted(rows, place, side="right") - 1
        inside = (place - rows[row]) // half
        # a passage is a half and the next one; the last half of a long row is no passage of its own
        first = base[row] + inside
        alone = (inside == halves[row] - 1) & (inside > 0)
        both = np.concatenate((first[~alone], first[inside > 0] - 1))
        pair = distinct(both * len(self.terms) + np.concatenate((term[~alone], term[inside > 0])))
        owner, term = pair // len(self.terms), pair % len(self.terms)
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        slack = threshold - 1e-4
        likely = np.add.reduceat(self.term_max[term], start) >= slack
        keep = np.repeat(likely, np.diff(np.append(start, len(term))))
        owner, term = owner[keep], term[keep]
        if not len(term):
            return
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        end = np.append(start[1:], len(term))
        step = max(64, min(1 << 11, (1 << 20) // max(1, len(self.owner))))
        for i in range(0, len(start), step):
            lo, hi = start[i], end[min(i + step, len(start)) - 1]
            count = end[i: i + step] - start[i: i + step]
            own, asked = term[lo:hi], np.repeat(np.arange(len(count)), count)
            cell, asked = _ranges(self.block_first, own, asked)
            bound = np.bincount(asked * self.blocks + self.block_of[cell], weights=self.block_max[cell], minlength=len(count) * self.blocks)
            opened = bound.reshape(-1, self.blocks) >= slack
            found = np.flatnonzero(opened.any(axis=1))
            if not len(found):
                continue
            # postings of the opened passages' terms, in opened blocks only
            size = end[i + found] - start[i + found]
            own = term[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[i + found], size)]
            posting, asked = _ranges(self.first, own, np.repeat(np.arange(len(found)), size))
            item = self.items[posting]
            kept = opened[found][asked, item // BLOCK]
            key = asked[kept] * len(self.owner) + item[kept]
            score = np.bincount(key, weights=self.impacts[posting[kept]], minlength=len(found) * len(self.owner))
            passed = np.flatnonzero(score >= threshold)
            if not len(passed):
                continue
            # the entries of an item are neighbours; its best one counts
            pair = passed // len(self.owner) * len(self.ids) + self.owner[passed % len(self.owner)]
            pair, first_of = np.unique(pair, return_index=True)
            for at, top in zip(pair.tolist(), np.maximum.reduceat(score[passed], first_of).tolist(), strict=True):
                which = owner[start[i + found[at // len(self.ids)]]]
                r = int(np.searchsorted(base, which, side="right")) - 1
                while halves[r] == 0:
                    r -= 1
                yield r, int(which - base[r]) * half, at % len(self.ids), top

    def judge(self, item: int, around: np.ndarray, least: float = 0.0) -> tuple[float, float]:
        """Shares of the question and of the answer; the answer's is not computed for a question below ``least``."""
        question = _share(self.questions[item], around)
        return question, _share(self.answers[item], around) if question >= least else 0.0

    def leaked(self, item: int, question: float, answer: float, overlap: float, question_only: float) -> bool:
        """Whether these shares are a leak of the item."""
        return question >= overlap and answer >= overlap or self.alone[item] and question >= question_only


def _parts(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, question, answer) or (id, text) of the items with an id."""
    columns = ["question", "answer"] if {"question", "answer"} <= set(items.columns) else [text_col]
    return items.where(F.col(id_col).isNotNull()).select(id_col, *columns)


def _split(row: tuple) -> tuple[str, str]:
    return (row[0] or "", row[1] or "") if len(row) == 2 else split_item(row[0])


def _word_counts(parts: DataFrame) -> DataFrame:
    """(word, held, words), stored: items that hold each word; the row without a word has the items and all their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_split(r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            items = _hashed([f"{q} {a}" for q, a in rows])
            word, held = np.unique(np.concatenate([distinct(w) for w in items] or [np.zeros(0, _U)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([None, *word.view(np.int64).tolist()], pa.int64()), pa.array([len(items), *held.tolist()], pa.int64()),
                pa.array([sum(map(len, items)), *[0] * len(word)], pa.int64())], names=["word", "held", "words"])

    return stored(parts.mapInArrow(run, "word long, held long, words long").groupBy("word")
                  .agg(F.sum("held").alias("held"), F.sum("words").alias("words")))


def _passes(parts: DataFrame, n: int, max_items: int, max_chars: int) -> int:
    """Into how many passes the items go (by hash of the id), so that none holds more than allowed."""
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in parts.columns[1:]), F.lit(0))
    sizes = stored(parts.select(F.xxhash64(parts.columns[0]).alias("h"), chars.cast("long").alias("chars")))
    passes = max(1, math.ceil(n / max_items))
    while passes < n:
        most = sizes.groupBy(F.pmod("h", F.lit(passes))).agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("one")) \
            .agg(F.max(F.when((F.col("chars") > max_chars) & (F.col("chars") > F.col("one")), F.col("chars"))).alias("chars")).first()
        if most.chars is None:
            break
        passes *= 2
    return passes


def _indexes(parts: DataFrame, counted: DataFrame, n: int, mean: float, passes: int, number: int, passage: int,
             question_words: int) -> list[ItemIndex]:
    id_col = parts.columns[0]
    part = parts.where(F.pmod(F.xxhash64(id_col), F.lit(passes)) == number).orderBy(id_col)
    rows = [(r[0], *_split(r[1:])) for r in part.collect()]
    words = distinct(np.concatenate(_hashed([f"{q} {a}" for _, q, a in rows]) or [np.zeros(0, _U)]))
    if passes > 1:
        mine = part.sparkSession.createDataFrame(pa.table({"word": pa.array(words.view(np.int64))}))
        counted = counted.join(F.broadcast(mine), "word")
    held = {r.word: r.held for r in counted.where("word is not null").collect()}
    counts = Counts(n, mean, words, np.array([held[w] for w in words.view(np.int64).tolist()], float))
    shard = np.cumsum([len(w) for w in _hashed([f"{q} {a}" for _, q, a in rows])]) // SHARD_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(rows)] if rows else []
    return [ItemIndex(*map(list, zip(*rows[a:b], strict=True)), counts, passage, question_words) for a, b in zip(cuts, cuts[1:], strict=False)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", passage: int = PASSAGE, threshold: float = THRESHOLD, overlap: float = OVERLAP,
          question_only: float = QUESTION_ONLY, question_words: int = QUESTION_WORDS, max_items: int = MAX_ITEMS,
          max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified leak, with its best passage's values."""
    sc = docs.sparkSession.sparkContext
    parts = _parts(benchmark, item_col, item_text_col)
    counted = _word_counts(parts)
    total = counted.where("word is null").first()
    n, words_of_all = (total.held, total.words) if total else (0, 0)
    passes = _passes(parts, n, max_items, max_chars)
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def one_pass(number: int) -> DataFrame:
        shared = sc.broadcast(_indexes(parts, counted, n, words_of_all / max(1, n), passes, number, passage, question_words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                best: dict[tuple, tuple] = {}
                for at, raw, off in blocks(pc.utf8_lower(batch.column(1))):
                    starts, ends, rows = word_spans(raw, off, NOT_ALNUM)
                    words = word_hashes(raw, starts, ends)
                    for index in shared.value:
                        for row, start, item, score in index.retrieve(words, rows, passage, threshold):
                            reach = max(index.lengths[item], passage // 2)
                            lo = max(rows[row], rows[row] + start - reach)
                            hi = min(rows[row + 1], rows[row] + start + passage + reach)
                            question, answer = index.judge(item, words[lo:hi], min(overlap, question_only))
                            if index.leaked(item, question, answer, overlap, question_only):
                                key, value = (at + row, index.ids[item]), (score, question, answer)
                                best[key] = max(best.get(key, value), value)
                columns = list(zip(*((ids[r], i, *v) for (r, i), v in best.items()), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return bare.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    if passes == 1:
        return one_pass(0)
    return reduce(DataFrame.union, [stored(one_pass(i)) for i in range(passes)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a verified leak."""
    return without_rows(docs, id_col, lambda named: leaks(named, benchmark, id_col, text_col, **options))
