"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from churnlab.llm import contract, spelling

LOWER = {i: i + 32 for i in range(65, 91)}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(docs, least=7, min_count=2):
    seen = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= min_count}


def variants(docs, ratio=10):
    words = counted(docs)
    rows, forms = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x.encode()), default=None)
        if best is not None and words[best] >= ratio * n:
            forms[w] = best
        rows[w] = (n, len(others), words[best] if w in forms else None)
    out = {}
    for w, (n, n_near, form_n) in rows.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n, n_near, form_n)
    return out


def check(found, docs):
    rows = found.collect()
    assert len(rows) == len({r.word for r in rows})
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == variants(docs)
    return rows


def test_edits_at_every_place(spark):
    rng = random.Random(4)
    docs = []
    for w in ("abcdefg", "wörterbuch", "internationalisation", "aaaaaaaa", "ßtraßenÿ×÷"):
        forms = {w} | {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in "aqÿ"}
        docs += [(rng.choice([None, *range(9)]), f"{f} {f}-{f}") for f in sorted(forms)]
        docs += [(100 + i, f"{w.upper() if w.isascii() else w}!") for i in range(120)]
    rows = check(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), docs)
    assert sum(r.form is not None for r in rows) > 100


def test_chains_ties_and_repeats(spark):
    docs = [(1, "abcdefgh " * 2), (2, "abcdefgx " * 30), (3, "abcdefyx " * 400), (4, "abcdezyx " * 5000), (5, "qqqqqqqa " * 40),
            (6, "qqqqqqqb " * 40), (7, "qqqqqqqc " * 4), (7, "qqqqqqqc " * 4), (8, None), (None, ""), (9, "short words only here")]
    rows = check(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")), docs)
    assert len({r.root for r in rows if r.word.startswith("abcde") and r.form}) <= 2


def test_the_given_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = check(contract.op11_spelling_variants(spark, "/root/testdata/sf0.001"), [(r.doc_id, r.text) for r in frame.collect()])
    assert rows


def test_shared_fixture_and_no_rows(docs, empty):
    docs = docs.where("text is null or length(text) < 9000")  # the comparison of all pairs is slow
    check(spelling.spelling_variants(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("size", [7, 8, 13])
def test_signatures_leave_out_a_quarter(spark, size):
    frame = spark.range(1).select(*[F.array(*x).alias(f"k{i}") for i, x in enumerate(spelling._kept(F.lit(size)))])
    holes = [set(range(a, size - b)) for a, b in frame.first()]
    assert set.union(*holes) == set(range(size)) and sum(map(len, holes)) == size
