"""Operators that compare documents: n-gram join, substring dedup, line dedup, quality rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.llm import line_dedup, ngram_join, quality_rules, substring_dedup
from churnlab.llm.graph import components

from . import brute
from .conftest import prose


def one_row_each(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_ngram_join(docs, pairs, empty):
    found = ngram_join.ngram_components(docs)
    assert found.count() == len(pairs) + 1
    got = {d: (r.n_shingles, r.component_id) for d, r in one_row_each(found).items()}
    assert got == brute.components(pairs)
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_join_opens_groups_the_bands_miss(docs, pairs, monkeypatch):
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a, real=ngram_join.verified: real(pairs.limit(0), *a))
    # without any verified star or central link, only the comparison of groups of one is left to find nothing
    alone = one_row_each(ngram_join.ngram_components(docs))
    same = {d: min(e for e, t in pairs if brute.shingle_set(t) == brute.shingle_set(x)) if brute.shingle_set(x) else d for d, x in pairs}
    assert {d: r.component_id for d, r in alone.items()} == same


def test_opened_groups_find_links_in_packs(spark):
    base = [f"w{i}" for i in range(60)]
    other = [*base[:55], "x", *base[56:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, "nothing alike at all in here")], "doc_id long, text string")
    asking = spark.createDataFrame([(9, 2), (9, 3)], "other long, doc_id long")
    members = spark.createDataFrame([(9, 1)], "other long, doc_id long")
    sizes = spark.createDataFrame([(1, 56), (2, 56), (3, 2)], "doc_id long, n int")
    links = ngram_join._opened(asking, members, sizes, docs, 5, 75, shingles=10).collect()
    assert [(r.a, r.b) for r in links] == [(2, 1)]


def test_a_link_passes_the_group_bound_in_one_direction():
    # the bound takes the lower of the two ends of a group's sizes; rounding can let a size in between need one less,
    # so a link may be missed from one side, but never from both
    percent = 75

    def prefix(n):
        return n - -(-n * percent // 100) + 1

    def needed(n, m):
        return -(-(n + m) * percent // (100 + percent)) - max(n - prefix(n), m - prefix(m))

    def may_miss(n, m):
        least, most = -(-n * percent // 100), n * 100 // percent
        ends = [max(needed(n, x) for x in xs) for xs in (range(least, m + 1), range(m, most + 1))]
        return min(ends) > needed(n, m)

    misses = 0
    for n in range(1, 121):
        for m in range(-(-n * percent // 100), n * 100 // percent + 1):
            misses += may_miss(n, m)
            assert not (may_miss(n, m) and may_miss(m, n)), (n, m)
    assert misses


def test_keep_one_per_component(docs, pairs):
    kept = ngram_join.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute.components(pairs).items() if c == d}


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(edges).collect()} == {0}


@pytest.mark.parametrize("hot,shard", [(5_000, 500_000), (1, 700)])
def test_substring_dedup(docs, pairs, empty, hot, shard):
    found = substring_dedup.substring_dedup(docs, hot_texts=hot, shard_words=shard)
    assert found.count() == len(pairs) + 1
    got = {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in one_row_each(found).items()}
    assert got == brute.substring(pairs)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_keeps_the_text(docs):
    rows = one_row_each(substring_dedup.substring_dedup(docs, with_text=True))
    assert rows[0].kept_text == one_row_each(docs)[0].text and rows[1].kept_text == ""


def test_substring_with_shared_and_missing_ids(spark):
    words = [prose(600 + i, 130).split() for i in range(6)]
    texts = [(1, words[0]), (None, words[0][:120] + words[1][:30]), (None, words[2] + words[3][:70]), (None, words[2]), (5, words[3]),
             (5, words[4] + words[0][20:90]), (5, words[4]), (9, words[4][10:]), (9, words[5]), (9, words[5]), (None, None), (5, None)]
    docs = [(d, None if w is None else " ".join(w)) for d, w in texts]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    # without an id: above all others, and equal to each other
    first = {}
    for d, t in docs:
        w = brute.words(t)
        for i in range(len(w) - 49):
            first[tuple(w[i:i + 50])] = min(first.get(tuple(w[i:i + 50]), 99), 99 if d is None else d)
    expected = []
    for d, t in docs:
        w = brute.words(t)
        gone = {i + j for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < (99 if d is None else d) for j in range(50)}
        expected.append((d is None, d or 0, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    for options in ({}, {"hot_texts": 1, "shard_words": 300}):
        found = substring_dedup.substring_dedup(frame, with_text=True, **options).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text or "") for r in found) == sorted(expected)
    assert sum(r[3] for r in expected) == 120 + 70 + 70 + 120


def test_backward_search_against_a_scan():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 3, n)) for n in (3, 9, 20, 21, 40, 41)]
    for length in (3, 4, 5, 8):
        found = substring_dedup.first_owners(texts, np.array([7, 3, 9, 1, 8, 2]), length)
        first = {}
        for owner, t in sorted(zip([7, 3, 9, 1, 8, 2], texts, strict=True)):
            w = t.split()
            for i in range(len(w) - length + 1):
                first.setdefault(tuple(w[i:i + length]), owner)
        for t, own in zip(texts, found, strict=True):
            w = t.split()
            assert own.tolist() == [first[tuple(w[i:i + length])] for i in range(len(w) - length + 1)]


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_line_dedup(docs, pairs, empty, hot_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", hot_rows)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", hot_rows - 1)
    found = line_dedup.line_report(docs, hot_rows=hot_rows)
    assert found.count() == len(pairs) + 1
    expected = brute.repeated_lines(pairs)
    assert {d: r.removed for d, r in one_row_each(found).items()} == {d: ",".join(map(str, expected.get(d, []))) for d, _ in pairs}
    assert line_dedup.line_report(empty).count() == 0


def test_lines_of_rows_without_an_id(spark):
    a, b, c, d = (prose(800 + i, 11) for i in range(4))
    docs = spark.createDataFrame([(4, f"{a}\n{b}", 1), (None, f"{b}\n{c}", 2), (None, d, 3), (None, a, 4), (9, None, 5)], "doc_id long, text string, _doc int")
    kept = line_dedup.without_repeated_lines(docs)
    assert sorted(((r.doc_id, r.text, r._doc) for r in kept.collect()), key=lambda r: r[2]) == [(4, f"{a}\n{b}", 1), (None, c, 2), (None, d, 3), (9, None, 5)]
    found = line_dedup.line_report(docs).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.removed) for r in found) == [(0, 1, ""), (0, 1, "0"), (0, 2, "0"), (4, 2, ""), (9, 0, "")]


def test_line_dedup_removes_from_texts(docs, pairs):
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    expected, texts = brute.repeated_lines(pairs), {}
    for d, t in pairs:
        gone = set(expected.get(d, []))
        left = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if not gone or left.split():
            texts[d] = left
    assert {r.doc_id: r.text for r in kept.collect()} == texts


def test_quality_rules(docs, pairs, empty):
    found = quality_rules.quality_rules(docs, min_docs=3, max_share=0.05)
    assert found.count() == len(pairs) + 1
    rows = one_row_each(found)
    for d, text in pairs:
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_rules(text), d
    boiler = [d for d, t in pairs if t and "this very same line" in t]
    assert all(rows[d].removed_words == 11 and rows[d].kept for d in boiler if d % 5)
    assert not any(r.kept and r.base_failed for r in rows.values())
    assert quality_rules.quality_rules(empty).count() == 0


def test_depleted_documents_go(spark):
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, f"{line}\n{line} {'extra ' * i}", "h") for i in range(8)], "doc_id long, text string, source string")
    rows = one_row_each(quality_rules.quality_rules(docs, min_docs=2, max_share=0.0))
    assert rows[3].removed_words == 10 and not rows[0].kept
    cut = one_row_each(quality_rules.without_frequent_lines(docs, min_docs=2, max_share=0.0))
    assert line not in cut[3].text.split("\n")
