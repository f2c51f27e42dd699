"""Embedding whitening against Fraction arithmetic and numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from churnlab.llm import contract, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int, deviation string, whitened string, x int, size int"


def frame(spark, vectors, kind="float"):
    rows = [(i, v, "c", 7, "d", "w", 1, 2) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA.replace("float", kind)).repartition(3)


def expected(vectors, components=4):
    """{vec_id: (n, deviation, projections up to sign)} of distinct integer vectors by numpy's eigensolver in extended scatter."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in kept)
    kept = [(i, x + (0,) * (d - len(x))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    m = np.array([[n * sum(x[i] * x[j] for x in fit) - s[i] * s[j] for j in range(d)] for i in range(d)], dtype=float)
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        centred = [n * a - b for a, b in zip(x, s, strict=True)]
        out[i] = (n, sum(c * c for c in centred), [float(np.dot(centred, vectors[:, k])) / math.sqrt(values[k]) if values[k] > 1e-6 else None
                                                    for k in range(min(components, d))])
    return out, values / max(values.sum(), 1e-300)


def check(found, vectors, components=4):
    wanted, explained = expected(vectors, components)
    rows = found.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in rows) == sorted(
        (i is None, i or 0, k + 1) for i, v in vectors if i in wanted and v is not None and all(c is not None and math.isfinite(c) for c in v)
        for k in range(len(wanted[i][2])))
    signs = {}
    for r in rows:
        n, deviation, white = wanted[r.vec_id]
        value = white[r.component - 1]
        assert r.n == n and r.deviation == deviation and abs(r.explained - explained[r.component - 1]) < 1e-9
        if value is None:
            assert r.whitened is None
        elif abs(value) > 1e-6:
            signs.setdefault(r.component, set()).add(math.copysign(1, value) * math.copysign(1, r.whitened))
            assert abs(abs(value) - abs(r.whitened)) < 1e-7 * (1 + abs(value))
    assert all(len(s) == 1 for s in signs.values())
    return rows


def random_vectors(rows, d, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in rng.normal(0, 0.2, d) * np.linspace(2, 0.3, d)]) for i in range(rows)]


def test_whitening_against_numpy(spark):
    vectors = random_vectors(300, 12)
    vectors += [(1000 + i, vectors[0][1]) for i in range(150)] + [vectors[1], (2000, None), (2001, [None] * 12),
                                                                 (2002, [float("nan")] * 12), (2003, [math.inf] + [0.0] * 11)]
    rows = check(whitening.whitened(frame(spark, vectors)), vectors)
    assert all(r.identity_error < 1e-9 for r in rows)


def test_the_given_vectors(spark):
    rows = contract.op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2000 and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    white = np.array([[r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component))]]).reshape(-1, 4)
    assert np.abs(white.T @ white / len(white) - np.eye(4)).max() < 1e-9


def test_odd_vectors(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None), (2, [None])])).count() == 0
    one = whitening.whitened(frame(spark, [(1, [0.5, 1.0]), (None, [0.5, 1.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4
    assert whitening.whitened(frame(spark, [(1, [])])).count() == 0
    # ragged vectors, a constant dimension, less variance than components
    ragged = [(1, [0.1, 0.5, 0.3]), (2, [0.4, 0.5]), (3, [0.1, 0.5, 0.3]), (4, []), (5, [0.2, 0.5, 0.3])]
    check(whitening.whitened(frame(spark, ragged)), ragged)
    flat = [(i, [i / 256, 2 * i / 256, 1.0, 0.0]) for i in range(6)]
    rows = check(whitening.whitened(frame(spark, flat)), flat)
    assert {r.component for r in rows if r.whitened is None} == {2, 3, 4} and all(r.identity_error < 1e-12 for r in rows)


def test_huge_entries_stay_exact(spark):
    r = random.Random(2)
    vectors = [(i, [r.uniform(-1, 1) * 2.0 ** 40, r.uniform(-1, 1), r.uniform(-1, 1) * 2.0 ** 20]) for i in range(40)]
    rows = whitening.whitened(frame(spark, vectors, "double")).collect()
    assert all(r.identity_error < 1e-6 for r in rows) and all(r.deviation is None for r in rows if r.vec_id == 0)
    wide = whitening.whitened(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "double")).collect()
    assert len(wide) == 6


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_against_fractions(spark, seed):
    r = random.Random(seed)
    a = [[r.randint(-9, 9) for _ in range(5)] for _ in range(r.randint(1, 7))]
    m = np.array([[sum(x[i] * x[j] for x in a) for j in range(5)] for i in range(5)], dtype=object)

    def determinant(rows):
        rows, out = [list(x) for x in rows], Fraction(1)
        for c in range(len(rows)):
            pivot = next((i for i in range(c, len(rows)) if rows[i][c]), None)
            if pivot is None:
                return Fraction(0)
            if pivot != c:
                rows[c], rows[pivot], out = rows[pivot], rows[c], -out
            out *= rows[c][c]
            for i in range(c + 1, len(rows)):
                u = rows[i][c] / rows[c][c]
                rows[i] = [p - u * q for p, q in zip(rows[i], rows[c], strict=True)]
        return out

    poly = whitening.characteristic_polynomial(spark, m)
    for at in range(6):
        assert sum(c * at ** k for k, c in enumerate(poly)) == determinant(
            [[Fraction(int((i == j) * at - m[i][j])) for j in range(5)] for i in range(5)])


def test_shared_roots_have_an_orthonormal_space():
    q = np.array([[1, 1, 0, 0, 0, 0], [1, -1, 0, 0, 0, 0], [0, 0, 1, 1, 0, 0], [0, 0, 1, -1, 0, 0], [0, 0, 0, 0, 1, 1], [0, 0, 0, 0, 1, -1]], dtype=object)
    m = q @ np.diag([5, 5, 5, 2, 0, 0]).astype(object) @ q.T
    primes = whitening.primes_beyond(10 ** 30)
    poly = whitening.remaindered(whitening.hessenberg_polynomials(m, primes).astype(object), primes)
    first, last = (whitening.isolated_root(poly, k, 34) for k in (1, 4))
    assert (first.first, first.count, last.first, last.count) == (1, 3, 4, 1) and whitening.isolated_root(poly, 5, 34) is None
    v = whitening.null_space(m, first)
    assert np.abs(v @ v.T - np.eye(3)).max() < 1e-14 and np.abs(m.astype(float) @ v.T - 10 * v.T).max() < 1e-12


def test_close_roots_are_told_apart():
    m = np.diag([10 ** 12, 10 ** 12 + 1, 3, 3]).astype(object)
    primes = whitening.primes_beyond(10 ** 60)
    poly = whitening.remaindered(whitening.hessenberg_polynomials(m, primes).astype(object), primes)
    roots = [whitening.isolated_root(poly, k, 2 * 10 ** 12 + 7) for k in (1, 2, 3)]
    assert [(r.first, r.count) for r in roots] == [(1, 1), (2, 1), (3, 2)]
    assert np.abs(whitening.null_space(m, roots[0])[0]).tolist() == [0, 1, 0, 0]
