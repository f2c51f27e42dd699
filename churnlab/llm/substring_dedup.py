"""Substring dedup: words of repeated 50-word windows, found with an FM-index per shard.

A window is ``length`` consecutive words of one document.  A word is removed if
a window that covers it also starts in a document with a smaller id.  All is
judged on the input.  The steps:

1. **Routing.** In every window the smallest hash of its ``gram``-word grams (the
   minimizer) depends on the window's words alone, so equal windows share it.
   Consecutive windows with one minimizer form a run.  Runs whose minimizer
   occurs in one document only have no equal window elsewhere.
2. **Shards.** Runs with equal words collapse to one text with its smallest id.
   The texts go to shards by minimizer; the number of shards follows the number
   of words, so a shard stays at about ``shard_words``.  Minimizers with very
   many different texts are routed again by the windows' own hash: equal
   windows collapse, different ones spread over all shards.
3. **Index.** A shard's texts are indexed by their suffix array (sorted on the
   first ``length`` words), whose Burrows-Wheeler transform is held as a wavelet
   matrix of packed bits with rank blocks.
4. **Search.** The shard's texts are streamed from right to left, all at once.
   A backward step maps the interval of the current match through the wavelet
   matrix; the match is cut to ``length`` words (the matching statistic, capped
   at the threshold).  Where it reaches the threshold, the interval's smallest
   document id is the window's first owner.
5. Windows whose first owner is smaller than the document are covered; the
   covered words of each document are cut out.

Null texts have no words.  A null id is larger than all others.  Texts under one id, or
without one, are kept apart (by a hash of the text, only where an id has several): none
has a smaller id than the other, so none loses words to it.  A row repeated whole keeps
all its rows, with one result.  Only the id and the text are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded, stored
from .words import blocks, distinct, mix, shingles, word_hashes, word_spans

LENGTH = 50
GRAM = 16
SHARD_WORDS = 500_000
HOT_TEXTS = 5_000
MAX_RUN = 128
_U = np.uint64
NO_ID = (1 << 63) - 1


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span:]) if w > span else x


def _runs(words: np.ndarray, rows: np.ndarray, length: int, gram: int):
    """Runs of windows with one minimizer: (row, minimizer, first window, windows) arrays."""
    windows = np.maximum(np.diff(rows) - length + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams, _ = shingles(words, np.array([0, len(words)]), gram)
    least = _sliding_min(grams, length - gram + 1)
    # windows across rows are dropped here
    row = np.repeat(np.arange(len(windows)), windows)
    first = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    low = least[first + rows[:-1][row]]
    cut = np.ones(len(row), dtype=bool)
    cut[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(cut)
    # very long runs (repetitive texts) are split
    size = np.diff(np.append(begin, len(row)))
    if size.max() > MAX_RUN:
        pieces = -(-size // MAX_RUN)
        begin = np.repeat(begin, pieces) + MAX_RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.diff(np.append(begin, len(row)))
    return row[begin], low[begin], first[begin], size


def _text_hash(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of ``size`` words from each start."""
    powers = np.empty(int(size.max()) if len(size) else 1, _U)
    powers[:] = _U(0x9E3779B97F4A7C15)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(powers)
        off = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(off, size)
        value = mix(words)[np.repeat(start, size) + place] * powers[place]
        return mix(np.add.reduceat(value, off) + size.astype(_U)) if len(size) else np.zeros(0, _U)


def _routes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, doc, v, at, n, same): the runs of every text; ``same`` hashes the run's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, version = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for at, raw, off in blocks(batch.column(1)):
                starts, ends, rows = word_spans(raw, off)
                words = word_hashes(raw, starts, ends)
                row, low, first, size = _runs(words, rows, length, gram)
                same = _text_hash(words, rows[:-1][row] + first, size + length - 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(low.view(np.int64)), pa.array(ids[at + row]), pa.array(version[at + row]), pa.array(first.astype(np.int32)),
                    pa.array(size.astype(np.int32)), pa.array(same.view(np.int64))], names=["key", "doc", "v", "at", "n", "same"])
    return docs.select("doc", "text", "v").mapInArrow(run, "key long, doc long, v long, at int, n int, same long")


def _texts(owners: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(key, same, n, doc, words) of the owners' runs; owners: doc, v, runs array<struct<key, same, at, n>>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            lists = batch.column(2)
            cuts = lists.offsets.to_numpy()
            flat = lists.values
            key, same, at, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            out = ([], [], [], [], [])
            made = 0
            for i, text in enumerate(batch.column(1)):
                found = text.as_py().encode().split()
                for j in range(cuts[i], cuts[i + 1]):
                    part = b" ".join(found[at[j]: at[j] + n[j] + length - 1])
                    made += len(part)
                    for column, v in zip(out, (key[j], same[j], n[j], ids[i], part), strict=True):
                        column.append(v)
                if made > 1 << 22:
                    yield _text_batch(out)
                    out, made = ([], [], [], [], []), 0
            yield _text_batch(out)

    return owners.join(docs.where("text is not null"), ["doc", "v"]).select("doc", "text", "runs") \
        .mapInArrow(run, "key long, same long, n int, doc long, words string")


def _text_batch(out) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds, strict=False)),
                                       pa.array([x.decode() for x in out[4]], pa.string())],
                                      names=["key", "same", "n", "doc", "words"])


class WaveletMatrix:
    """Rank over a sequence of symbols below ``2**levels``, in packed bits with a count every 64."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.blocks, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.zeros(len(symbols) // 64 + 1, _U)
            packed.view(np.uint8)[: -(-len(symbols) // 8)] = np.packbits(bit.astype(np.uint8), bitorder="little")
            self.bits.append(packed)
            self.blocks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int32))[:-1])).astype(np.int32))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at`` (both arrays)."""
        at, start = at.astype(np.int64), np.zeros(len(at), np.int64)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            packed, counts = self.bits[i], self.blocks[i]
            def ones(x):
                return counts[x >> 6] + np.bitwise_count(packed[x >> 6] & ((_U(1) << (x & 63).astype(_U)) - _U(1))).astype(np.int64)
            up_at, up_start = ones(at), ones(start)
            at = np.where(one, up_at + self.zeros[i], at - up_at)
            start = np.where(one, up_start + self.zeros[i], start - up_start)
        return at - start


class FMIndex:
    """FM-index of word sequences, for patterns of up to ``length`` words."""

    def __init__(self, symbols: np.ndarray, levels: int, sigma: int, length: int):
        # symbols: words from 1, with a 0 before, between and after the texts
        n = len(symbols)
        rank, depth = symbols.astype(np.int64), 1
        while depth * 2 <= length - 1:
            rank, depth = self._deeper(rank, depth), depth * 2
        # the first length - 1, then length words
        self.shorter = self._deeper(rank, length - 1 - depth) if length - 1 > depth else rank
        full = self._deeper(rank, length - depth)
        order = np.argsort(full, kind="stable")
        self.order = order
        self.count = np.searchsorted(np.sort(symbols), np.arange(sigma + 1))
        self.matrix = WaveletMatrix(symbols[order - 1].astype(np.int64), levels)
        short = self.shorter[order]
        edge = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1], [True])))
        group = np.cumsum(np.concatenate(([0], (short[1:] != short[:-1]).astype(np.int64))))
        self.low, self.high = edge[:-1][group], edge[1:][group]
        deep = full[order]
        self.same = np.cumsum(np.concatenate(([0], (deep[1:] != deep[:-1]).astype(np.int64))))
        self.starts = np.flatnonzero(np.concatenate(([True], deep[1:] != deep[:-1])))

    @staticmethod
    def _deeper(rank: np.ndarray, step: int) -> np.ndarray:
        """Ranks by the current depth, then by what stands ``step`` words on."""
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:] + 1
        pair = rank * (int(after.max()) + 1) + after
        kinds = np.sort(pair)
        kinds = kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))]
        return np.searchsorted(kinds, pair)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray):
        """The intervals of the matches with one more word in front."""
        base = self.count[symbol]
        return base + self.matrix.rank(symbol, low), base + self.matrix.rank(symbol, high)


def first_owners(texts: list[str], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the smallest owner of each of its windows, by backward search in an index of all the texts."""
    parts, sizes = [], []
    column = pa.array(texts, pa.string())
    for _, raw, off in blocks(column):
        starts, ends, rows = word_spans(raw, off)
        parts.append(word_hashes(raw, starts, ends))
        sizes.append(np.diff(rows))
    words, size = np.concatenate(parts), np.concatenate(sizes)
    kinds = distinct(words)
    inner = np.searchsorted(kinds, words) + 1
    sigma = len(kinds) + 1
    off = np.cumsum(size) - size
    symbols = np.zeros(len(words) + len(size) + 1, np.int64)
    begin = off + np.arange(1, len(size) + 1)
    symbols[np.arange(len(words)) + np.repeat(np.arange(1, len(size) + 1), size)] = inner
    owner_at = np.full(len(symbols), NO_ID)
    owner_at[np.arange(len(words)) + np.repeat(np.arange(1, len(size) + 1), size)] = np.repeat(owners, size)
    index = FMIndex(symbols, max(1, int(sigma - 1).bit_length()), sigma, length)
    least = np.minimum.reduceat(owner_at[index.order], index.starts)

    windows = np.maximum(size - length + 1, 0)
    place = np.cumsum(windows) - windows
    out = np.full(int(windows.sum()), NO_ID)
    lanes = np.argsort(-size, kind="stable")
    low, high = np.zeros(len(size), np.int64), np.full(len(size), len(symbols))
    matched = 0
    for step in range(int(size.max()) if len(size) else 0):
        live = int(np.searchsorted(-size[lanes], -step, side="left"))
        lane = lanes[:live]
        if matched == length:  # cut the match to its first length - 1 words
            low, high = index.low[low], index.high[low]
            matched -= 1
        symbol = symbols[begin[lane] + size[lane] - 1 - step]
        low, high = index.step(low[:live], high[:live], symbol)
        matched += 1
        if matched == length:
            out[place[lane] + size[lane] - 1 - step] = least[index.same[low]]
    return np.split(out, place[1:])


def _search(texts: DataFrame, shards: int, length: int) -> DataFrame:
    """(key, same, n, spans): for each text, runs of windows (from, to, first owner)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows):
            table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            owners = table.column(4).to_numpy()
            spans = []
            for found in first_owners(table.column(5).to_pylist(), owners, length):
                cut = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
                end = np.append(cut[1:], len(found))
                spans.append([{"a": int(a), "b": int(b), "who": int(found[a])} for a, b in zip(cut, end, strict=True)])
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("who", pa.int64())]))
            return pa.RecordBatch.from_arrays([table.column(1), table.column(2), table.column(3), pa.array(spans, kind)],
                                              names=["key", "same", "n", "spans"])
        # rows come sorted by shard; a shard ends where its number changes
        shard, held = None, []
        for batch in batches:
            at = 0
            numbers = batch.column(0).to_numpy()
            for to in [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), len(numbers)]:
                if to == at:
                    continue
                if numbers[at] != shard and held:
                    yield result(held)
                    held = []
                shard = numbers[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield result(held)

    placed = texts.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "same", "n", "doc", "words")
    return placed.repartition(shards, "shard").sortWithinPartitions("shard") \
        .mapInArrow(run, "key long, same long, n int, spans array<struct<a:int,b:int,who:long>>")


def _owners_of(distinct_runs: DataFrame) -> DataFrame:
    return distinct_runs.groupBy("doc", "v").agg(F.collect_list(F.struct("key", "same", "at", "n")).alias("runs"))


def _covered(docs: DataFrame, length: int, gram: int, shard_words: int, hot_texts: int) -> DataFrame:
    """(doc, v, cut): for every text with repeated windows, arrays of (first, last) covered words."""
    routes = stored(_routes(docs, length, gram))
    key = ["key", "same", "n"]
    def collapsed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.min(F.struct("doc", "v", "at")).alias("o"), F.max("doc").alias("last"))
    texts = stored(collapsed(routes).select(*key, "o.doc", "o.v", "o.at", "last"))
    shared = stored(texts.groupBy("key").agg(F.min("doc").alias("lo"), F.max("last").alias("hi"),
                                             F.count(F.lit(1)).alias("texts")).where("lo < hi").select("key", "texts"))
    cold, hot = shared.where(F.col("texts") <= hot_texts).select("key"), stored(shared.where(F.col("texts") > hot_texts).select("key"))
    occurrences = routes.join(bounded(shared.select("key")), "key", "left_semi")
    wanted = texts.join(bounded(cold), "key", "left_semi").drop("last")
    if hot.limit(1).count():
        # windows of hot minimizers one by one, under their own hash
        single = stored(_single_windows(docs, routes.join(bounded(hot), "key", "left_semi"), length))
        occurrences = occurrences.join(bounded(hot), "key", "left_anti").select(*single.columns).union(single)
        again = collapsed(single).where("o.doc < last").select(*key, "o.doc", "o.v", "o.at")
        wanted = wanted.select(*key, "doc", "v", "at").union(again)
    wanted = stored(wanted.select(*key, "doc", "v", "at"))
    total = wanted.agg(F.sum(F.col("n") + (length - 1))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    found = _search(_texts(_owners_of(wanted), docs, length), shards, length)
    covered = occurrences.join(found, key).select("doc", "v", "at", F.explode("spans").alias("s")).where("s.who < doc") \
        .select("doc", "v", F.struct((F.col("at") + F.col("s.a")).alias("first"),
                                (F.col("at") + F.col("s.b") + (length - 2)).alias("last")).alias("cut"))
    return stored(covered.groupBy("doc", "v").agg(F.collect_set("cut").alias("cut")))


def _single_windows(docs: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """(key, doc, v, at, n = 1, same) of each window in the ``hot`` runs; key and same are the window's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, version = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            lists = batch.column(2)
            cuts, flat = lists.offsets.to_numpy(), lists.values
            first, size = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for at, raw, off in blocks(batch.column(1)):
                starts, ends, rows = word_spans(raw, off)
                words = word_hashes(raw, starts, ends)
                for i in range(len(off) - 1):
                    own = slice(cuts[at + i], cuts[at + i + 1])
                    where = np.concatenate([np.arange(a, a + n) for a, n in zip(first[own], size[own], strict=True)])
                    same = _text_hash(words[rows[i]: rows[i + 1]], where, np.full(len(where), length)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(same), pa.array(np.full(len(where), ids[at + i])), pa.array(np.full(len(where), version[at + i])),
                        pa.array(where.astype(np.int32)), pa.array(np.ones(len(where), np.int32)), pa.array(same)],
                        names=["key", "doc", "v", "at", "n", "same"])

    runs = hot.groupBy("doc", "v").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    return runs.join(docs.where("text is not null"), ["doc", "v"]).select("doc", "text", "runs", "v") \
        .mapInArrow(run, "key long, doc long, v long, at int, n int, same long")


def _cut_out(df: DataFrame, rest: list[str], with_text: bool) -> DataFrame:
    """``rest``, n_words, n_removed, kept_sha256 (and the kept text) for rows (rest, text, cut)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, texts = [], [], [], []
            cuts = batch.column(len(rest) + 1)
            for i, text in enumerate(batch.column(len(rest))):
                words = (text.as_py() or "").encode().split()
                spans = cuts[i].as_py()
                kept = words
                if spans:
                    keep = np.ones(len(words), dtype=bool)
                    for s in spans:
                        keep[s["first"]: s["last"] + 1] = False
                    kept = [w for w, k in zip(words, keep, strict=True) if k]
                n.append(len(words))
                gone.append(len(words) - len(kept))
                body = b" ".join(kept)
                digest.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    texts.append(body.decode() if gone[-1] else text.as_py())
            made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = [*rest, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                made, names = [*made, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *made], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)
    schema += ", n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return df.select(*rest, "text", "cut").mapInArrow(run, schema)


def _versions(rows: DataFrame) -> DataFrame:
    """``rows`` (doc, text) with ``v``: a hash of the text where an id has several texts, else 0."""
    text = F.xxhash64("text")
    several = stored(rows.groupBy("doc").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo != hi").select("doc"))
    if not several.limit(1).count():
        return rows.withColumn("v", F.lit(0).cast("long"))
    some = several.withColumn("some", F.lit(True))
    return rows.join(bounded(some), "doc", "left").withColumn("v", F.when(F.col("some"), text).otherwise(F.lit(0))).drop("some")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                    shard_words: int = SHARD_WORDS, hot_texts: int = HOT_TEXTS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.col(text_col).alias("text"))
    base = _versions(rows)
    covered = _covered(base.select("doc", "v", "text"), length, gram, shard_words, hot_texts)
    none = F.lit(None).cast("array<struct<first:int,last:int>>")
    ids = covered.select("doc", "v")
    if ids.limit(2_000_001).count() <= 2_000_000:
        # texts without repeats need no shuffle
        whole = base.join(F.broadcast(ids), ["doc", "v"], "left_anti").withColumn("cut", none)
        some = base.join(F.broadcast(ids), ["doc", "v"], "left_semi").join(covered, ["doc", "v"])
        rows = whole.select("doc_id", "text", "cut").union(some.select("doc_id", "text", "cut"))
    else:
        rows = base.join(covered, ["doc", "v"], "left")
    return _cut_out(rows, ["doc_id"], with_text)
