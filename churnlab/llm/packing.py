"""Packing by lexical retrieval: BM25 neighbours fill each training window.

A document becomes its token ids and an end id.  Its whole windows stand alone;
its tail (fewer ids than a window) is packed with others.  How many tails hold an
id, and their mean length, are counted over all tails.

Tails go to shards of about ``shard_docs`` by content: a tail's key is its
KEY_IDS heaviest ids that enough tails hold, the most common first.  Tails with
the same first id share a shard; a first id with more tails is split by the second,
and so on, and equal keys beyond a shard by hash of the document id.  First ids
with fewer tails share shards.  Retrieval ends at the edge of a shard: tails
whose keys have no common start can be neighbours only where shards hold both.

Each shard builds a BM25 inverted index over its tails' ids.  The longest unused
tail is a seed; the unused tails that score best against all of its ids (or its
``query_terms`` heaviest) follow, in order, until the window is full.  The tail
that overruns the window is cut, and what is left of it is the next seed.  So
only the last sequence of a shard is padded.

Every id lies in exactly one piece.  A null or empty text has the end id alone.
Repeated rows are packed each.  Other columns are ignored.  Only ids of at most
16 bits are supported.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .tokens import Encoder
from .words import mix

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 2048
QUERY_TERMS = None
KEY_IDS = 4
LEAST_HELD = 8
K1, B = 1.2, 0.75
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "window_fill long")
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def vocabulary() -> tuple[str, str]:
    """Path of the rank file, and the pre-tokenizer pattern, of the public byte-level BPE tokenizer with 50k ids."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(docs: DataFrame, path: str, pattern: str, window: int, end_id: int) -> DataFrame:
    """(doc_id, doc_tokens, whole, tail): checksums of the whole windows, and the ids left over."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((path, pattern)) or _ENCODERS.setdefault((path, pattern), Encoder(path, pattern))
        for batch in batches:
            at, tokens, whole, tails, held = 0, [], [], [], 0
            for i, ids in encoder.encode(batch.column(1)):
                ids = np.append(ids, np.uint16(end_id))
                cut = len(ids) // window * window
                tokens.append(len(ids))
                whole.append([_crc(ids[j: j + window]) for j in range(0, cut, window)])
                tails.append(ids[cut:].tobytes())
                held += len(tails[-1])
                if held > 4 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(at, i + 1 - at), pa.array(tokens, pa.int64()),
                        pa.array(whole, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                        names=["doc_id", "doc_tokens", "whole", "tail"])
                    at, tokens, whole, tails, held = i + 1, [], [], [], 0

    return docs.mapInArrow(run, "doc_id long, doc_tokens long, whole array<long>, tail binary")


class Counts:
    """idf of every id, how many tails hold it, and the mean length, over all tails."""

    def __init__(self, n: int, mean: float, held: np.ndarray):
        self.n, self.mean, self.held = n, max(mean, 1), held
        self.idf = np.log1p((n - held + 0.5) / (held + 0.5))

    @classmethod
    def of(cls, tails: list[np.ndarray]) -> Counts:
        return cls(len(tails), sum(map(len, tails)) / max(1, len(tails)), np.bincount(_pairs(tails)[1], minlength=1 << 16))


def _pairs(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tail, id, times) of the distinct ids of each tail."""
    owner = np.repeat(np.arange(len(tails)), np.array([len(x) for x in tails], np.int64))
    pair, tf = np.unique((owner << 16) | np.concatenate([*tails, np.zeros(0, np.uint16)]).astype(np.int64), return_counts=True)
    return pair >> 16, pair & 0xFFFF, tf


def _weights(tails: list[np.ndarray], counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tail, id, BM25 weight)."""
    owner, term, tf = _pairs(tails)
    size = np.array([len(x) for x in tails], np.int64)
    return owner, term, counts.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / counts.mean))


def content_keys(tails: list[np.ndarray], counts: Counts) -> np.ndarray:
    """64-bit key of each tail: its heaviest ids, the most common first, 16 bits each; 0 where there are fewer."""
    keys = np.zeros(len(tails), np.uint64)
    owner, term, weight = _weights(tails, counts)
    # ids of too few tails say nothing of neighbours
    shared = counts.held[term] >= min(LEAST_HELD, counts.n)
    owner, term, weight = owner[shared], term[shared], weight[shared]
    order = np.lexsort((term, -weight, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner, owner)
    order = order[rank < KEY_IDS]
    owner, term = owner[order], term[order]
    order = np.lexsort((term, -counts.held[term], owner))
    owner, term = owner[order], term[order]
    place = np.arange(len(order)) - np.searchsorted(owner, owner)
    np.bitwise_or.at(keys, owner, term.astype(np.uint64) << (16 * (KEY_IDS - 1 - place)).astype(np.uint64))
    return keys


class Shards:
    """Shard numbers of content keys.

    ``levels`` has, for 1 to KEY_IDS leading ids, how many tails start with them:
    all of one id, and of more ids only those of more than ``shard_docs`` tails.
    """

    def __init__(self, levels: list[dict[int, int]], shard_docs: int):
        self.number, self.first, self.split = 0, {}, [{} for _ in levels]
        open_at, held = None, 0

        def place(level: int, prefix: int) -> None:
            nonlocal open_at, held
            size = levels[level][prefix]
            if size > shard_docs and level + 1 < len(levels):
                for child in below[level + 1].get(prefix, ()):
                    size -= levels[level + 1][child]
                    place(level + 1, child)
            if size >= shard_docs and levels[level][prefix] > shard_docs:
                self.split[level][prefix] = (self.number, size // shard_docs)
                self.number += size // shard_docs
                return
            if open_at is None:
                open_at, held, self.number = self.number, 0, self.number + 1
            if levels[level][prefix] > shard_docs:
                self.split[level][prefix] = (open_at, 1)
            else:
                self.first[prefix] = open_at
            held += size
            if held >= shard_docs:
                open_at = None

        below: list[dict[int, list[int]]] = [{} for _ in levels]
        for level in range(1, len(levels)):
            for prefix in sorted(levels[level]):
                below[level].setdefault(prefix >> 16, []).append(prefix)
        for prefix in sorted(levels[0]):
            place(0, prefix)

    def of(self, key: int, own: int) -> int:
        """Shard of a key; ``own`` deals out equal keys."""
        last = KEY_IDS - 1
        for level in range(last, -1, -1):
            found = self.split[level].get(key >> (16 * (last - level)))
            if found:
                base, slots = found
                by = own if level == last else key >> (16 * (last - level - 1))
                return base + int(mix(np.array([by & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] % np.uint64(slots)) if slots > 1 else base
        return self.first[key >> (16 * last)]


class TailIndex:
    """BM25 inverted index over the ids of a shard's tails."""

    def __init__(self, tails: list[np.ndarray], query_terms: int | None, counts: Counts | None = None):
        n = len(tails)
        owner, term, weight = _weights(tails, counts or Counts.of(tails))
        # the seed's query: all its ids, or the heaviest
        order = np.lexsort((term, -weight, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner, owner)
        asked = rank < (query_terms or len(order) + 1)
        self.query = term[order][asked]
        self.query_at = np.concatenate(([0], np.cumsum(np.bincount(owner[asked], minlength=n))))
        by_term = np.argsort(term, kind="stable")
        self.docs, self.weights = owner[by_term], weight[by_term]
        held = np.bincount(term, minlength=1 << 16)
        self.first = np.concatenate(([0], np.cumsum(held)))
        # weights of ids that many tails hold, a row of all tails for each
        common = np.flatnonzero(held > n // 4)
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n))
        at = self.row[term] >= 0
        self.rows[self.row[term[at]], owner[at]] = weight[at]
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        found = self.query[self.query_at[seed]: self.query_at[seed + 1]]
        row = self.row[found]
        rare = found[row < 0]
        width = self.first[rare + 1] - self.first[rare]
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.first[rare], width)
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n) + self.rows[row[row >= 0]].sum(axis=0)


def fill_windows(tails: list[np.ndarray], window: int, query_terms: int | None,
                 counts: Counts | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (tail, from, to), from non-empty tails; ``counts`` are those of ``tails`` if not given."""
    index = TailIndex(tails, query_terms, counts)
    size = np.array([len(x) for x in tails])
    unused = np.ones(len(tails), dtype=bool)
    by_size = iter(np.argsort(-size, kind="stable").tolist())
    seed, at = -1, 0
    while True:
        if seed < 0:
            seed, at = next((i for i in by_size if unused[i]), -1), 0
            if seed < 0:
                return
            unused[seed] = False
        parts, room = [(seed, at, int(size[seed]))], window - int(size[seed]) + at
        left = np.flatnonzero(unused)
        seed_of_next = -1
        if room and len(left):
            order = left[np.argsort(-index.scores(seed)[left], kind="stable")]
            for i in order.tolist():
                unused[i] = False
                take = min(room, int(size[i]))
                parts.append((i, 0, take))
                room -= take
                if take < size[i]:
                    seed_of_next, at = i, take
                if not room:
                    break
        yield parts
        seed = seed_of_next


def tail_counts(made: DataFrame) -> Counts:
    """Counts of all rows with a non-empty ``tail``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            tails = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(0)]
            held += np.bincount(_pairs(tails)[1], minlength=1 << 16)
            n, size = n + sum(len(x) > 0 for x in tails), size + sum(map(len, tails))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int64()),
                                          pa.array([n, size, *held[some].tolist()], pa.int64())], names=["id", "held"])

    found = {r.id: r.held for r in made.select("tail").mapInArrow(run, "id long, held long")
             .groupBy("id").agg(F.sum("held").alias("held")).collect()}
    held = np.zeros(1 << 16, np.int64)
    for i, n in found.items():
        if i >= 0:
            held[i] = n
    return Counts(found.get(-2, 0), found.get(-1, 0) / max(1, found.get(-2, 0)), held)


def _keys(tails: pa.Array, counts: Counts) -> np.ndarray:
    return content_keys([np.frombuffer(x.as_py(), np.uint16) for x in tails], counts)


def shard_table(keys: DataFrame, shard_docs: int) -> Shards:
    """Shards of the column ``key``; the driver gets a row per first id, and one per longer start of over ``shard_docs`` tails."""
    levels = []
    for level in range(KEY_IDS):
        start = F.shiftrightunsigned("key", 16 * (KEY_IDS - 1 - level)).alias("prefix")
        counted = keys.select(start).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
        rows = (counted.where(F.col("n") > shard_docs) if level else counted).collect()
        levels.append({r.prefix & 0xFFFFFFFFFFFFFFFF: r.n for r in rows})
    return Shards(levels, shard_docs)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None,
         window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS,
         query_terms: int | None = QUERY_TERMS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_fill) of every piece.

    ``window_fill`` is the number of ids of the piece's sequence.
    """
    if path is None:
        path, pattern = vocabulary()
    sc = docs.sparkSession.sparkContext
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = stored(_tokenised(bare, path, pattern, window, end_id))
    counts = sc.broadcast(tail_counts(made))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(batch.column(0), counts.value).view(np.int64))], names=["key"])

    table = shard_table(stored(made.select("tail").mapInArrow(keyed, "key long")), shard_docs)
    shards, places = max(1, table.number), sc.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            ids, tokens, whole = (table.column(i).to_pylist() for i in (1, 2, 3))
            tails = [np.frombuffer(x.as_py(), np.uint16) for x in table.column(4)]
            out, number = [], int(shard) << 32
            for i, sums in enumerate(whole):
                for j, crc in enumerate(sums):
                    out.append((ids[i], j * window, window, crc, tokens[i], number, 0, window))
                    number += 1
            some = [i for i, x in enumerate(tails) if len(x)]
            for parts in fill_windows([tails[i] for i in some], window, query_terms, counts.value) if some else ():
                offset, fill = 0, sum(b - a for _, a, b in parts)
                for k, a, b in parts:
                    i = some[k]
                    out.append((ids[i], len(whole[i]) * window + a, b - a, _crc(tails[i][a:b]), tokens[i], number, offset, fill))
                    offset += b - a
                number += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_fill"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        shard, held = None, []
        for batch in batches:
            numbers, at = batch.column(0).to_numpy(), 0
            for to in [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), len(numbers)]:
                if to == at:
                    continue
                if held and numbers[at] != shard:
                    yield packed(shard, held)
                    held = []
                shard = numbers[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield packed(shard, held)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            numbers = []
            for key, own in zip(_keys(batch.column(3), counts.value).tolist(), batch.column(0).to_pylist(), strict=True):
                # rows without an id are dealt out in turn
                numbers.append(places.value.of(key, row if own is None else own))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns],
                                             names=["shard", *batch.schema.names])

    return made.mapInArrow(placed, "shard long, doc_id long, doc_tokens long, whole array<long>, tail binary") \
        .repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "doc_tokens").mapInArrow(run, SCHEMA)
