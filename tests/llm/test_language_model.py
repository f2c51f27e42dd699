"""Deleted interpolation against dictionaries of whole n-grams."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from churnlab.llm import contract, language_model

from . import brute
from .conftest import prose


def tokens(text):
    return [*(text or "").encode().translate(brute.LOWER).split(), None]


def remainder(name):
    return zlib.crc32(("" if name is None else str(name)).encode()) % 7


class Counted:
    def __init__(self, docs, order):
        self.n = Counter()
        for text in docs:
            w = ["<"] * (order - 1) + tokens(text)
            for i in range(order - 1, len(w)):
                for o in range(order):
                    self.n[tuple(w[i - o:i + 1])] += 1
        self.docs, self.order = len(docs), order
        self.tokens = sum(v for k, v in self.n.items() if len(k) == 1)
        self.types = sum(1 for k in self.n if len(k) == 1)

    def context(self, c):
        return self.docs if all(x == "<" for x in c) else self.n[c]

    def parts(self, text, types):
        w = ["<"] * (self.order - 1) + tokens(text)
        for i in range(self.order - 1, len(w)):
            chance, bucket = [1 / (types + 1), self.n[w[i],] / max(1, self.tokens)], (1 if self.tokens else 0) * 64
            bucket += int(math.log2(max(1, self.tokens)))
            for o in range(2, self.order + 1):
                c = tuple(w[i - o + 1:i])
                seen = self.context(c)
                chance.append(self.n[(*c, w[i])] / seen if seen else 0)
                bucket = o * 64 + int(math.log2(seen)) if seen else bucket
            yield bucket, chance


def learned(rest, deleted, types, order, rounds, change):
    parts = [p for text in deleted for p in rest.parts(text, types)]
    weights, last = {}, -math.inf
    for _ in range(rounds):
        sums, log = {}, 0
        for b, chance in parts:
            w = weights.get(b, [1 / (b // 64 + 1)] * (b // 64 + 1) + [0] * (order - b // 64))
            mixed = [x * y for x, y in zip(w, chance, strict=True)]
            log += math.log(sum(mixed))
            sums[b] = [s + x / sum(mixed) for s, x in zip(sums.get(b, [0] * (order + 1)), mixed, strict=True)]
        for b, s in sums.items():
            k = b // 64 + 1
            s = [x + 1 / k for x in s[:k]] + [0] * (order + 1 - k)
            weights[b] = [x / sum(s) for x in s]
        if log - last <= change * abs(log):
            break
        last = log
    return weights


def expected(docs, deleted, order):
    """{row number: (n_tokens, n_known, train_tokens, base_score, score)}."""
    train = [t for i, (d, t) in enumerate(docs) if remainder(d) != 2]
    full = Counted(train, order)
    gone = [t for i, (d, t) in enumerate(docs) if remainder(d) != 2 and deleted[i]]
    kept = [t for i, (d, t) in enumerate(docs) if remainder(d) != 2 and not deleted[i]]
    weights = {}
    if gone and kept:
        weights = learned(Counted(kept, order), gone, full.types, order, language_model.ROUNDS, language_model.CHANGE)
    out = []
    for _, text in docs:
        w = tokens(text)
        base = sum(math.log10((full.n[x,] + 1) / (full.tokens + full.types + 1)) for x in w)
        score = 0
        for b, chance in full.parts(text, full.types):
            same = [x for x in weights if x // 64 == b // 64]
            table = weights[min(same, key=lambda x: (abs(x - b), x))] if same else [1 / (b // 64 + 1)] * (b // 64 + 1) + [0] * (order - b // 64)
            score += math.log10(sum(x * y for x, y in zip(table, chance, strict=True)))
        out.append((len(w), sum(full.n[x,] > 0 for x in w), full.tokens, base, score))
    return out


def check(spark, docs, order=2, parts=3, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    deleted = {(r.doc_id, r.text): r.d for r in frame.select("doc_id", "text", (F.pmod(
        F.xxhash64("doc_id", "text", F.lit("deleted")), F.lit(parts)) == 0).alias("d")).collect()}
    rows = language_model.scores(frame, order=order, parts=parts, **options).collect()
    wanted = expected(docs, [deleted[x] for x in docs], order)

    def key(x):
        return x[0] is None, x[0] or 0, x[1], x[5]
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out, r.base_score, r.score) for r in rows), key=key)
    want = sorted(((d, a, b, c, remainder(d) == 2, x, y) for (d, _), (a, b, c, x, y) in zip(docs, wanted, strict=True)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5, abs=1e-6)
    return rows


def sentences(n, seed=3):
    r = random.Random(seed)
    vocab = [prose(900 + i, 1) for i in range(40)]
    follow = {w: [r.choice(vocab) for _ in range(4)] for w in vocab}
    out = []
    for i in range(n):
        w = [r.choice(vocab)]
        for _ in range(r.randint(0, 30)):
            known = follow.get(w[-1], vocab)
            w.append(r.choice(known) if r.random() < 0.8 else prose(2000 + r.randint(0, 400), 1))
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("order,options", [(1, {}), (2, {}), (3, {"block_bytes": 3000, "bucket_tokens": 500}), (2, {"block_bytes": 1, "bucket_tokens": 1})])
def test_scores_against_dictionaries(spark, order, options):
    docs = sentences(120) + [(None, "x Y z"), (None, "x Y z"), (None, None), (7, None), (7, ""), (500, "Same words"), (500, "Same words")]
    rows = check(spark, docs, order, **options)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_fixture_rows(spark, docs, rows):
    check(spark, [(r[0], r[1]) for r in rows])


def test_little_or_no_training(spark, empty):
    assert language_model.scores(empty).count() == 0
    tested = [i for i in range(60) if remainder(i) == 2]
    for r in check(spark, [(i, "only tested words") for i in tested]):
        assert r.train_tokens == 0 and r.score == 0 and r.base_score == 0
    check(spark, [(1, "one document")], parts=10 ** 6)
    check(spark, [(1, "one document")], parts=1)


def test_model_beats_the_base_on_the_given_documents(spark):
    found = contract.op12_lm_scoring(spark, "/root/testdata/sf0.01")
    r = found.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s > r.b and found.count() == 1000


def test_blocks_stay_small(spark):
    docs = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    sizes = [r["size"] for r in language_model.text_blocks(docs, "doc_id", "text", 7, 2, 16, language_model.BLOCK_BYTES).collect()]
    assert sum(sizes) == 600 * 10000 and max(sizes) <= 2 << 20
