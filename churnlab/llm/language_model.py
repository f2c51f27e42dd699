"""Language-model scores by deleted interpolation.

A token is a lower-cased (A-Z) word or the end of a document.  Its probability is a
mixture of the maximum-likelihood estimates of all orders up to ``order`` and of a
uniform one over the known tokens and one unknown:

    P(w | context) = sum over o of weight[bucket][o] * count(context_o w) / count(context_o)

The bucket is the longest context that was seen and the logarithm of its count.  The
weights are learned by expectation-maximisation on held-out counts: ``1 / PARTS`` of the
training documents are deleted from the counts, and their tokens are what the mixture of
the rest has to predict.  Scores then use the counts of all training documents.

Counting and looking up go through Spark as arrays, not as a row for each token:

1. Documents are written once in blocks of about ``block_bytes`` of text, each of deleted,
   other training, or held-out documents only.
2. A block sends each of its distinct n-grams once, with its occurrences, to one of as
   many buckets as the number of tokens asks for (by hash, so no n-gram is hot: it has
   one entry for each block).  A bucket adds them up and answers every block with the
   totals; the answers are written.
3. Blocks of deleted documents meet their answers and write what the mixture needs of
   each token; each EM round reads that once and brings a few sums for each bucket of
   contexts to the driver.
4. All blocks meet their answers and score their documents.

Every n-gram of every training document is counted; nothing is pruned.  64-bit hashes
stand for n-grams.  A bucket of contexts without held-out tokens takes the weights of the
nearest one (by count) of its order, or equal ones.  Null texts are empty (one token,
the end); a null id counts as the empty text in the split and stays null; each row is a
document, so repeated rows count and repeat; other columns are ignored; without training
documents every score is that of the uniform distribution.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import fold
from .store import stored
from .words import distinct, mix, word_hashes, word_spans

FOLDS, HELD_OUT = 7, 2
ORDER = 2
#: One of so many training documents is deleted.
PARTS = 16
BLOCK_BYTES = 2 << 20
#: Tokens for which there is a bucket of n-grams, and tokens of a block that a bucket gets at least, so that rows stay worth
#: their overhead.  From some hundred gigabytes on the second decides; with blocks of 64 MB (and workers of 2 GB) a bucket
#: of 100 TB has about 25 million tokens.
BUCKET_TOKENS = 1_000_000
CELL_TOKENS = 16
TOKEN_BYTES = 6
ROUNDS, CHANGE = 25, 1e-4
OTHER, DELETED, TESTED = 0, 1, 2
_U = np.uint64
END = _U(0x9E3779B97F4A7C15)
CODEC = "zstd"


def _packed(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, which compress well where high bytes agree."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: pa.Scalar | bytes, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(data if isinstance(data, bytes) else data.as_buffer(), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def text_blocks(docs: DataFrame, id_col: str, text_col: str, folds: int, held_out: int, parts: int, block_bytes: int) -> DataFrame:
    """(block, kind, ids, size, offsets, text), stored: documents of one kind with their texts compressed together."""
    tested = fold(id_col, folds) == held_out
    deleted = F.pmod(F.xxhash64(id_col, text_col, F.lit("deleted")), F.lit(parts)) == 0
    kind = F.when(tested, F.lit(TESTED)).when(deleted, F.lit(DELETED)).otherwise(F.lit(OTHER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {k: [] for k in (OTHER, DELETED, TESTED)}
        weight = dict.fromkeys(held, 0)

        def block(kind: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held[kind]).combine_chunks()
            ids, text = (rows.column(i).combine_chunks() for i in range(2))
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
            raw = text.buffers()[2].slice(off[0], off[-1] - off[0]) if text.buffers()[2] is not None else pa.py_buffer(b"")
            held[kind], weight[kind] = [], 0
            return pa.RecordBatch.from_arrays([
                pa.array([first + made]), pa.array([kind], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([raw.size], pa.int64()), pa.array([_packed(off - off[0])], pa.binary()),
                pa.array([pa.compress(raw, CODEC, asbytes=True)], pa.binary())], names=["block", "kind", "ids", "size", "offsets", "text"])

        for batch in batches:
            kinds = batch.column(2).to_numpy()
            text = batch.column(1).fill_null("").cast(pa.large_string())
            for kind in held:
                at = np.flatnonzero(kinds == kind)
                if not len(at):
                    continue
                rows = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), text.take(pa.array(at))], names=["id", "text"])
                cuts = np.concatenate(([0], np.cumsum(pc.binary_length(rows.column(1)).to_numpy())))
                lo = 0
                while lo < len(at):
                    hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + block_bytes - weight[kind], side="right")) - 1)
                    held[kind].append(rows.slice(lo, hi - lo))
                    weight[kind] += int(cuts[hi] - cuts[lo])
                    if weight[kind] >= block_bytes or hi < len(at):
                        yield block(kind)
                        made += 1
                    lo = hi
        for kind in held:
            if held[kind]:
                yield block(kind)
                made += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), kind.alias("kind"))
    return stored(rows.mapInArrow(run, "block long, kind int, ids array<long>, size long, offsets binary, text binary"))


class Grams(NamedTuple):
    """The n-grams of a block of documents: hashes by order (from 1), token offsets of the documents, first tokens."""

    keys: list[np.ndarray]
    rows: np.ndarray
    first: np.ndarray


def grams(raw: np.ndarray, off: np.ndarray, order: int) -> Grams:
    """Hashes of the 1- to ``order``-grams that end at each token; the end of a document is a token."""
    starts, ends, cuts = word_spans(raw, off)
    words = word_hashes(raw, starts, ends, lower=True)
    rows = cuts + np.arange(len(cuts))
    one = np.full(rows[-1], END, _U)
    is_word = np.ones(rows[-1], dtype=bool)
    is_word[rows[1:] - 1] = False
    one[is_word] = words
    first = np.zeros(rows[-1], dtype=bool)
    first[rows[:-1]] = True
    keys = [one]
    with np.errstate(over="ignore"):
        for o in range(2, order + 1):
            before = np.concatenate((one[:1], keys[-1][:-1]))
            before[first] = _U(o)
            keys.append(mix(before * _U(0xD6E8FEB86659FD93) + one + _U(o)))
    return Grams(keys, rows, first)


def _block_grams(text: pa.Scalar, size: int, offsets: pa.Scalar, order: int) -> Grams:
    raw = np.frombuffer(pa.decompress(text.as_buffer(), size, CODEC), np.uint8) if size else np.zeros(0, np.uint8)
    return grams(raw, _unpacked(offsets), order)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets that rise with the key."""
    return ((keys >> _U(32)) * _U(buckets)) >> _U(32)


def _asked(blocks_of: DataFrame, order: int, buckets: list[int]) -> DataFrame:
    """(o, bucket, block, kind, keys, n): each block's distinct n-grams, sorted, and their occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _block_grams(batch.column(4)[i], batch.column(2)[i].as_py(), batch.column(3)[i], order)
                for o, keys in enumerate(found.keys):
                    kinds, n = np.unique(keys, return_counts=True)
                    bucket = _bucket_of(kinds, buckets[o])
                    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                    end = np.append(cut[1:], len(kinds))
                    k = len(cut)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(k, o + 1, np.int32)), pa.array(bucket[cut].astype(np.int32)),
                        pa.array(np.full(k, batch.column(0)[i].as_py())), pa.array(np.full(k, batch.column(1)[i].as_py(), np.int32)),
                        pa.array([_packed(kinds[a:b]) for a, b in zip(cut, end, strict=True)], pa.binary()),
                        pa.array([_packed(n[a:b].astype(np.int64)) for a, b in zip(cut, end, strict=True)], pa.binary())],
                        names=["o", "bucket", "block", "kind", "keys", "n"])

    return blocks_of.select("block", "kind", "size", "offsets", "text") \
        .mapInArrow(run, "o int, bucket int, block long, kind int, keys binary, n binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(o, bucket, block, kind, trained, deleted, types, tokens, gone), stored: totals of the asked n-grams, in the order of asking.

    ``types``, ``tokens`` and ``gone`` are the bucket's kinds and occurrences in training, and its deleted occurrences, on one
    row of each bucket.
    """
    def total(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        keys = [_unpacked(k, _U) for k in rows.column("keys")]
        size = np.array([len(k) for k in keys])
        n = np.concatenate([_unpacked(c) for c in rows.column("n")]).astype(np.float64)  # exact below 2^53
        kinds, where = np.unique(np.concatenate(keys), return_inverse=True)
        of = np.repeat(kind, size)
        trained = np.bincount(where, weights=n * (of != TESTED), minlength=len(kinds)).astype(np.int64)
        deleted = np.bincount(where, weights=n * (of == DELETED), minlength=len(kinds)).astype(np.int64)
        cuts = np.cumsum(size)[:-1]
        once = [0] * (len(keys) - 1)
        return pa.table({
            "o": rows.column("o"), "bucket": rows.column("bucket"), "block": rows.column("block"), "kind": rows.column("kind"),
            "trained": pa.array([_packed(x) for x in np.split(trained[where], cuts)], pa.binary()),
            "deleted": pa.array([_packed(x) for x in np.split(deleted[where], cuts)], pa.binary()),
            "types": pa.array([int((trained > 0).sum()), *once], pa.int64()), "tokens": pa.array([int(trained.sum()), *once], pa.int64()),
            "gone": pa.array([int(deleted.sum()), *once], pa.int64())})

    return stored(asked.groupBy("o", "bucket").applyInArrow(
        total, "o int, bucket int, block long, kind int, trained binary, deleted binary, types long, tokens long, gone long"))


class Totals(NamedTuple):
    """Of the training documents: tokens, kinds of tokens, documents, and deleted tokens and documents."""

    tokens: int
    types: int
    docs: int
    deleted_tokens: int
    deleted_docs: int


def _counts(found: Grams, answers: pa.Table, column: str) -> list[np.ndarray]:
    """For each order, the count of the n-gram at each token."""
    o, bucket = answers.column("o").to_numpy(), answers.column("bucket").to_numpy()
    out, values = [], answers.column(column)
    for i, keys in enumerate(found.keys):
        rows = np.flatnonzero(o == i + 1)
        rows = rows[np.argsort(bucket[rows])]
        totals = np.concatenate([_unpacked(values[int(r)]) for r in rows])
        out.append(totals[np.searchsorted(distinct(keys), keys)])
    return out


def _parts(found: Grams, counts: list[np.ndarray], tokens: int, types: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the context, probabilities of order 0 to the last) of each token."""
    size, order = len(found.first), len(counts)
    chance = np.zeros((order + 1, size))
    chance[0] = 1.0 / (types + 1)
    chance[1] = counts[0] / max(1, tokens)
    longest = np.full(size, 1 if tokens else 0)
    seen = np.full(size, max(1, tokens), np.int64)
    for o in range(2, order + 1):
        context = np.concatenate(([0], counts[o - 2][:-1]))
        context[found.first] = docs
        known = context > 0
        chance[o, known] = counts[o - 1][known] / context[known]
        longest[known], seen[known] = o, context[known]
    return longest * 64 + np.log2(seen).astype(np.int64), chance


def _joined(blocks_of: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    return blocks_of.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _deleted_tokens(blocks_of: DataFrame, answers: DataFrame, totals: Totals, order: int) -> DataFrame:
    """(buckets, chances), stored: the contexts and probabilities of the deleted tokens under the counts of the rest."""
    tokens, docs = totals.tokens - totals.deleted_tokens, totals.docs - totals.deleted_docs

    def run(block: pa.Table, answered: pa.Table) -> pa.Table:
        buckets, chances = [], []
        for i in range(block.num_rows):
            found = _block_grams(block.column("text")[i], block.column("size")[i].as_py(), block.column("offsets")[i], order)
            rest = [a - b for a, b in zip(*(_counts(found, answered, c) for c in ("trained", "deleted")), strict=True)]
            bucket, chance = _parts(found, rest, tokens, totals.types, docs)
            buckets.append(bucket.astype(np.int32).tobytes())
            chances.append(chance[1:].astype(np.float32).tobytes())
        return pa.table({"buckets": pa.array(buckets, pa.binary()), "chances": pa.array(chances, pa.binary())})

    mine = F.col("kind") == DELETED
    return stored(_joined(blocks_of.where(mine), answers.where(mine), run, "buckets binary, chances binary"))


def _allowed(bucket: int, order: int) -> np.ndarray:
    """Orders whose context was seen, in a bucket of contexts."""
    return np.arange(order + 1) <= bucket // 64


def learned_weights(tokens: DataFrame, types: int, order: int, rounds: int = ROUNDS, change: float = CHANGE) -> dict[int, np.ndarray]:
    """Mixture weights by bucket of contexts, by expectation-maximisation over the deleted tokens.

    One token spread over the allowed orders is added in each round, so that none gets no weight.
    """
    weights: dict[int, np.ndarray] = {}
    uniform = 1.0 / (types + 1)
    last = -np.inf
    for _ in range(rounds):
        current = dict(weights)

        def run(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for buckets, chances in zip(*batch.columns, strict=True):
                    bucket = np.frombuffer(buckets.as_buffer(), np.int32)
                    chance = np.concatenate((np.full((1, len(bucket)), uniform),
                                             np.frombuffer(chances.as_buffer(), np.float32).reshape(order, -1)))
                    kinds, where = np.unique(bucket, return_inverse=True)
                    table = np.array([current.get(int(b), _allowed(b, order) / _allowed(b, order).sum()) for b in kinds])
                    part = table[where].T * chance
                    whole = part.sum(axis=0)
                    part /= whole
                    sums = [np.bincount(where, weights=x, minlength=len(kinds)) for x in (*part, np.log(whole))]
                    for b, row in zip(kinds.tolist(), np.array(sums).T, strict=True):
                        total[b] = total.get(b, 0) + row
            rows = sorted(total.items())
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([r[i] for _, r in rows], pa.float64())
                                              for i in range(order + 2))], names=["bucket", *names, "log"])

        names = [f"s{o}" for o in range(order + 1)]
        found = tokens.mapInArrow(run, ", ".join(["bucket int", *(f"{c} double" for c in names), "log double"])) \
            .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in (*names, "log")]).collect()
        for r in found:
            allowed = _allowed(r.bucket, order)
            sums = np.array([r[c] for c in names]) + allowed / allowed.sum()
            weights[r.bucket] = np.where(allowed, sums, 0) / sums[allowed].sum()
        log = sum(r.log for r in found)
        if log - last <= change * abs(log):
            break
        last = log
    return weights


def weights_of(bucket: int, weights: dict[int, np.ndarray], order: int) -> np.ndarray:
    """The weights of a bucket of contexts, or of the nearest learned one of its order, or equal ones."""
    same = [b for b in weights if b // 64 == bucket // 64]
    if not same:
        allowed = _allowed(bucket, order)
        return allowed / allowed.sum()
    return weights[min(same, key=lambda b: (abs(b - bucket), b))]


def _scored(blocks_of: DataFrame, answers: DataFrame, totals: Totals, weights: dict[int, np.ndarray], order: int) -> DataFrame:
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(block: pa.Table, answered: pa.Table) -> pa.Table:
        out = []
        for i in range(block.num_rows):
            found = _block_grams(block.column("text")[i], block.column("size")[i].as_py(), block.column("offsets")[i], order)
            counts = _counts(found, answered, "trained")
            bucket, chance = _parts(found, counts, totals.tokens, totals.types, totals.docs)
            kinds, where = np.unique(bucket, return_inverse=True)
            table = np.array([weights_of(b, weights, order) for b in kinds.tolist()])
            score = np.log10((table[where].T * chance).sum(axis=0))
            base = np.log10((counts[0] + 1) / (totals.tokens + totals.types + 1))
            ids, n = block.column("ids")[i].values, len(found.rows) - 1
            at = found.rows[:-1]
            out.append(pa.table({
                "doc_id": ids, "held_out": pa.array(np.full(n, block.column("kind")[i].as_py() == TESTED)), "n_tokens": pa.array(np.diff(found.rows)),
                "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), at)), "train_tokens": pa.array(np.full(n, totals.tokens)),
                "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(score, at))}))
        return pa.concat_tables(out)

    return _joined(blocks_of, answers, run, schema)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT,
           order: int = ORDER, parts: int = PARTS, block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    made = text_blocks(docs, id_col, text_col, folds, held_out, parts, block_bytes)
    count = F.sum(F.size("ids")).alias("docs")
    by_kind = {r.kind: r for r in made.groupBy("kind").agg(count, F.sum("size").alias("bytes")).collect()}
    text = sum(r.bytes for r in by_kind.values())
    most = max(1, min(-(-text // (TOKEN_BYTES * bucket_tokens)), block_bytes // (TOKEN_BYTES * CELL_TOKENS)))
    answers = _answered(_asked(made, order, [-(-most // 4), *[most] * (order - 1)]))  # words have the fewest kinds
    one = answers.where("o = 1").agg(*[F.sum(c).alias(c) for c in ("types", "tokens", "gone")]).first()
    rest, deleted = (by_kind[k].docs if k in by_kind else 0 for k in (OTHER, DELETED))
    totals = Totals(one.tokens or 0, one.types or 0, rest + deleted, one.gone or 0, deleted)
    weights = {}
    if rest and deleted:
        weights = learned_weights(_deleted_tokens(made, answers, totals, order), totals.types, order)
    return _scored(made, answers, totals, weights, order)
