"""Embedding whitening by an exact characteristic polynomial.

Entries ``c`` of a vector become integers ``x = floor(256 c)``.  The fit list holds each
distinct x vector once; the covariance's eigenvectors are the components.  The steps:

1. The distinct vectors are written once.  Tasks add up their Gram matrix with a
   constant column in exact integers, so n, the sums S and the scatter
   ``M = n * sum(x x^T) - S S^T`` (n^2 times the covariance) have no rounding.
2. The characteristic polynomial of M modulo many 31-bit primes: tasks bring M to
   Hessenberg form modulo each prime and expand its determinant; Chinese remaindering
   joins the residues.  The bound of Maclaurin's inequality on the coefficients of a
   matrix without negative eigenvalues says how many primes are enough.
3. All roots are real, so Descartes' sign changes of the shifted polynomial *count* the
   roots above a point.  Bisection isolates each wanted root; a root alone in its
   interval is refined by the polynomial's sign, all to ``BITS`` binary places.
4. A component is the null space of M minus its root, by inverse iteration in integers
   with guard bits.  Roots that agree to all places share one null space, of which an
   orthonormal basis is returned.
5. Every row is projected; the whitened covariance over the fit list is measured in two
   passes, centred before multiplying.

What reaches the driver are D + 1 rows of the Gram matrix for each task (summed by Spark
first), residues and components: bounded by the dimension D, not by the rows.

Rows whose vector is null or holds a null, NaN or infinite entry go.  Shorter vectors
count as zero in the dimensions that they lack.  Null ids stay, repeated rows repeat
their result and count once in the fit.  An x beyond the range of a long takes its end;
a deviation beyond it is null.  A component without variance has ``whitened`` null and
``explained`` 0, and does not enter ``identity_error``, which is null if there is no
other.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stored

SCALE = 256
COMPONENTS = 4
#: Binary places of the roots of the integer polynomial, and guard bits of the inverse iteration.
BITS, GUARD = 64, 192
#: Rounds of inverse iteration.
ROUNDS = 3
#: Primes that one task works on at a time.
PRIMES = 32
#: Limbs in which the exact sums travel.
LIMB = 48
#: Integers below this are exact as doubles, in any order of adding.
EXACT = 1 << 53


def _quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the valid rows, their sizes, and their x side by side."""
    lists = column.cast(pa.list_(pa.float64()))
    size = np.diff(lists.offsets.to_numpy())
    first = lists.offsets.to_numpy()[0]
    values = lists.values[first: first + int(size.sum())].to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    at = np.concatenate(([0], np.cumsum(size)))
    valid = (bad[at[1:]] == bad[at[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
    kept = values[np.repeat(valid, size)]
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(scale * kept), -(2.0 ** 63), 2.0 ** 63 - 1024).astype(np.int64)
    return np.flatnonzero(valid), size[valid], x


def _matrix(size: np.ndarray, x: np.ndarray, d: int) -> np.ndarray:
    """Rows of ``d`` dimensions; shorter vectors end in zeros."""
    if len(size) and size.min() == size.max() == d:
        return x.reshape(len(size), d)
    out = np.zeros((len(size), d), np.int64)
    start = np.cumsum(size) - size
    for i, (a, n) in enumerate(zip(start, size, strict=True)):
        out[i, :min(n, d)] = x[a: a + min(n, d)]
    return out


def fit_list(vectors: DataFrame, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(x, size), stored: each distinct x vector without trailing zeros, and its greatest original size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, size, x = _quantised(batch.column(0), scale)
            end = np.cumsum(size)
            last = np.maximum.accumulate(np.where(x != 0, np.arange(1, len(x) + 1), 0)) if len(x) else np.zeros(0, np.int64)
            used = np.where(size > 0, np.append(last, 0)[end - 1], 0) - (end - size)
            used = np.maximum(used, 0)
            keep = np.arange(len(x)) - np.repeat(end - size, size) < np.repeat(used, size)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(used))).astype(np.int32), pa.array(x[keep]))
            yield pa.RecordBatch.from_arrays([lists, pa.array(size.astype(np.int32))], names=["x", "size"])

    return stored(vectors.select(vec_col).mapInArrow(run, "x array<bigint>, size int").groupBy("x").agg(F.max("size").alias("size")))


def _lists(column: pa.Array, d: int) -> np.ndarray:
    off = column.offsets.to_numpy()
    return _matrix(np.diff(off), column.values.to_numpy(zero_copy_only=False)[off[0]: off[-1]], d)


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x^T x in exact integers (objects): by doubles while no sum can pass 2^53, else in Python integers."""
    top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    rows = EXACT // (top * top)
    if not rows:
        x = x.astype(object)
        return x.T @ x
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for at in range(0, len(x), rows):
        part = x[at: at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def scatter(fitted: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and the integer scatter M of the fit list."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), dtype=object)
        for batch in batches:
            x = _lists(batch.column(0), d)
            total += exact_gram(np.column_stack((np.ones(len(x), np.int64), x)))
        limb = 0
        while limb == 0 or total.any():
            part = (total & ((1 << LIMB) - 1)).astype(np.int64)
            total = total >> LIMB
            if not (total * (total + 1)).any():  # all that is left is signs
                part, total = part + (total << LIMB).astype(np.int64), total * 0
            rows = pa.ListArray.from_arrays(np.arange(d + 2, dtype=np.int32) * (d + 1), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(np.full(d + 1, limb, np.int32)), rows],
                                             names=["i", "limb", "sums"])
            limb += 1

    def total(parts):
        rows = np.array(parts.column("sums").to_pylist(), dtype=object)
        return pa.table({"i": parts.column("i")[:1], "limb": parts.column("limb")[:1], "sums": [[str(v) for v in rows.sum(axis=0)]]})

    gram = np.zeros((d + 1, d + 1), dtype=object)
    parts = fitted.select("x").mapInArrow(partial, "i int, limb int, sums array<bigint>")
    for r in parts.groupBy("i", "limb").applyInArrow(total, "i int, limb int, sums array<string>").collect():
        gram[r.i] += np.array([int(v) for v in r.sums], dtype=object) << (LIMB * r.limb)
    n, s = int(gram[0, 0]), gram[0, 1:]
    return n, [int(v) for v in s], n * gram[1:, 1:] - np.outer(s, s)


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all 32-bit numbers."""
    if n % 2 == 0 or n % 3 == 0 or n % 5 == 0:
        return n in (2, 3, 5)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x in (0, 1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """31-bit primes, the greatest first, whose product passes ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg_polynomials(m: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (lowest first) of det(x I - m) modulo each prime; ``m`` holds Python integers."""
    d, k = len(m), len(primes)
    p = np.array(primes, np.int64)
    h = np.stack([(m % q).astype(np.int64) for q in primes]) if d else np.zeros((k, 0, 0), np.int64)
    every, p1, p2 = np.arange(k), p[:, None], p[:, None, None]
    for c in range(d - 2):
        # a row with a pivot below the diagonal comes to row c + 1, and its column likewise
        pivot = (h[:, c + 1:, c] != 0).argmax(axis=1) + c + 1
        top = h[every, c + 1].copy()
        h[every, c + 1], h[every, pivot] = h[every, pivot], top
        left = h[every, :, c + 1].copy()
        h[every, :, c + 1], h[every, :, pivot] = h[every, :, pivot], left
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, c + 1, c], p, strict=True)], np.int64)
        u = h[:, c + 2:, c] * inverse[:, None] % p1
        h[:, c + 2:] = (h[:, c + 2:] - u[:, :, None] * h[:, None, c + 1] % p2) % p2
        h[:, :, c + 1] = (h[:, :, c + 1] + (h[:, :, c + 2:] * u[:, None] % p2).sum(axis=2)) % p1
    polynomials = np.zeros((k, d + 1, d + 1), np.int64)
    polynomials[:, 0, 0] = 1
    for c in range(d):
        new = np.zeros((k, d + 1), np.int64)
        new[:, 1:] = polynomials[:, c, :-1]
        below = np.ones(k, np.int64)
        for i in range(c, -1, -1):
            factor = h[:, i, c] * below % p
            new = (new - factor[:, None] * polynomials[:, i] % p1) % p1
            if i:
                below = below * h[:, i, i - 1] % p
        polynomials[:, c + 1] = new
    return polynomials[:, d]


def remaindered(residues: np.ndarray, primes: list[int]) -> list[int]:
    """The integers of least size with these residues (a row for each prime)."""
    product = math.prod(primes)
    weights = [product // p * pow(product // p % p, -1, p) for p in primes]
    out = []
    for column in residues.T:
        v = sum(int(r) * w for r, w in zip(column, weights, strict=True)) % product
        out.append(v - product if 2 * v > product else v)
    return out


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Exact coefficients, lowest first, of det(x I - m) for a symmetric ``m`` without negative eigenvalues."""
    d = len(m)
    mean = -(-int(np.trace(m)) // d) if d else 0
    primes = primes_beyond(2 * max(math.comb(d, k) * mean ** k for k in range(d + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own = primes[i * PRIMES: (i + 1) * PRIMES]
                yield pa.RecordBatch.from_pydict({"p": own, "residues": hessenberg_polynomials(m, own).tolist()})

    parts = -(-len(primes) // PRIMES)
    found = {r.p: r.residues for r in spark.range(0, parts, 1, parts).mapInArrow(run, "p long, residues array<bigint>").collect()}
    return remaindered(np.array([found[p] for p in primes], dtype=object), primes)


def _scaled(poly: list[int], places: int) -> list[int]:
    """Coefficients of 2^(places * degree) * poly(x / 2^places)."""
    d = len(poly) - 1
    return [c << (places * (d - k)) for k, c in enumerate(poly)]


def roots_above(scaled: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only lie above ``at``, with multiplicity."""
    c = list(scaled)
    if at:
        for i in range(len(c) - 1):
            for j in range(len(c) - 2, i - 1, -1):
                c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(scaled: list[int], at: int) -> int:
    value = 0
    for c in reversed(scaled):
        value = value * at + c
    return (value > 0) - (value < 0)


class Root(NamedTuple):
    """``value / 2^places`` is the root from above; the components ``first`` to ``first + count - 1`` share it."""

    value: int
    places: int
    first: int
    count: int


def isolated_root(poly: list[int], number: int, top: int, places: int = BITS) -> Root | None:
    """The ``number``-th greatest root (from 1) if it is positive; no root passes ``top``."""
    if roots_above(poly, 0) < number:
        return None
    scaled = _scaled(poly, places)
    lo, hi, above_lo, above_hi = 0, (top + 1) << places, None, 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if above_lo is not None and above_lo - above_hi == 1:  # alone: the sign tells the side
            alone = _sign(scaled, mid)
            if alone == 0 or alone == (-1) ** above_hi:
                hi = mid
            else:
                lo = mid
            continue
        above = roots_above(scaled, mid)
        if above >= number:
            lo, above_lo = mid, above
        else:
            hi, above_hi = mid, above
    above_lo = roots_above(scaled, lo) if above_lo is None else above_lo
    return Root(hi, places, above_hi + 1, above_lo - above_hi)


def null_space(m: np.ndarray, root: Root, guard: int = GUARD, rounds: int = ROUNDS) -> np.ndarray:
    """``root.count`` orthonormal vectors (rows) that ``m`` stretches by the root, as doubles.

    Inverse iteration in integers with ``guard`` binary places below those of the root.
    """
    d, one = len(m), guard
    a = np.array([[int(v) << (root.places + guard) for v in row] for row in m], dtype=object).reshape(d, d)
    for i in range(d):
        a[i, i] -= root.value << guard
    order = np.arange(d)
    for c in range(d):
        pivot = c + int(np.argmax([abs(v) for v in a[c:, c]]))
        a[[c, pivot]], order[[c, pivot]] = a[[pivot, c]], order[[pivot, c]]
        if a[c, c] == 0:
            a[c, c] = 1  # the space itself: any small pivot amplifies it
        for r in range(c + 1, d):
            if a[r, c]:
                u = (a[r, c] << one) // a[c, c]
                a[r, c + 1:] -= (u * a[c, c + 1:]) >> one
                a[r, c] = u

    def solved(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for c in range(d):
            y[c + 1:] -= (a[c + 1:, c] * y[c]) >> one
        for c in range(d - 1, -1, -1):
            y[c] = ((y[c] - (int((a[c, c + 1:] * y[c + 1:]).sum()) >> one)) << one) // a[c, c]
        return y

    def unit(v: np.ndarray) -> np.ndarray:
        norm = math.isqrt(sum(int(x) * int(x) for x in v)) or 1
        return np.array([(int(x) << one) // norm for x in v], dtype=object)

    found: list[np.ndarray] = []
    for number in range(root.count):
        v = unit(np.array([(i * 7919 + (number + 1) * 104729 + i * i * (number + 3)) % 65521 + 1 for i in range(d)], dtype=object) << one)
        for _ in range(rounds):
            for _ in range(2):
                for w in found:
                    v = v - ((int((v * w).sum()) >> one) * w >> one)
                v = unit(v)
            v = unit(solved(v))
        for _ in range(2):
            for w in found:
                v = v - ((int((v * w).sum()) >> one) * w >> one)
            v = unit(v)
        found.append(v)
    out = np.array([[int(x) / (1 << one) for x in v] for v in found])
    for v in out:
        v *= np.sign(v[np.abs(v).argmax()])
    return out


class Whitening(NamedTuple):
    """A fitted whitening: ``vectors`` and ``roots`` (eigenvalues of M, n^2 times the covariance's) of the first components."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    roots: list[float]
    explained: list[float]


def fit(fitted: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The first components of a fit list; None for an empty one."""
    spark = fitted.sparkSession
    d = fitted.agg(F.max("size")).first()[0]
    if d is None:
        return None
    n, sums, m = scatter(fitted, d)
    trace, wanted = int(np.trace(m)) if d else 0, min(components, d)
    if not trace:
        return Whitening(n, sums, np.zeros((wanted, d)), [0.0] * wanted, [0.0] * wanted)
    poly = characteristic_polynomial(spark, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                root = isolated_root(poly, number, trace)
                if root is not None:
                    vector = null_space(m, root)[number - root.first]
                    value = (root.value / (1 << root.places), root.value / (trace << root.places))
                    yield pa.RecordBatch.from_pydict({"k": [number], "root": value[:1], "explained": value[1:], "vector": [vector.tolist()]})

    found = {r.k: r for r in spark.range(1, wanted + 1, 1, max(1, wanted)).mapInArrow(
        run, "k long, root double, explained double, vector array<double>").collect()}
    vectors = np.array([found[k].vector if k in found else [0.0] * d for k in range(1, wanted + 1)]).reshape(wanted, d)
    return Whitening(n, sums, vectors, [found[k].root if k in found else 0.0 for k in range(1, wanted + 1)],
                     [found[k].explained if k in found else 0.0 for k in range(1, wanted + 1)])


def _projected(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | list]:
    """Whitened values (a column for each component) and n x - S."""
    top = max([int(np.abs(x.astype(np.float64)).max(initial=0)) * model.n, *map(abs, model.sums)], default=0)
    if top < 1 << 61:
        centred = model.n * x - np.array(model.sums, np.int64)
    else:
        centred = model.n * x.astype(object) - np.array(model.sums, dtype=object)
    roots = np.sqrt(np.array(model.roots))
    with np.errstate(divide="ignore", invalid="ignore"):
        return (centred.astype(np.float64) @ model.vectors.T) / roots, centred


def _deviation(centred: np.ndarray) -> list[int | None]:
    top = float(np.abs(centred.astype(np.float64)).max(initial=0))
    if top * top * max(1, centred.shape[1]) < 2.0 ** 62:
        whole = centred.astype(np.int64)
        return (whole * whole).sum(axis=1).tolist()
    exact = (centred.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def identity_error(fitted: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    used, d = [k for k, r in enumerate(model.roots) if r > 0], len(model.sums)
    if not used:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _projected(model, _lists(batch.column(0), d))[0][:, used]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in w.T], names=[f"w{i}" for i in range(len(used))])

    names = [f"w{i}" for i in range(len(used))]
    white = fitted.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    means = white.agg(*[F.avg(c).alias(c) for c in names]).first()
    pairs = [(i, j) for i in range(len(used)) for j in range(i + 1)]
    covered = white.agg(*[F.avg((F.col(names[i]) - means[i]) * (F.col(names[j]) - means[j])) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(covered, pairs, strict=True))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
             scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every valid row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"))
    fitted = fit_list(base, "vector", scale)
    model = fit(fitted, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, d, kinds = identity_error(fitted, model), len(model.sums), len(model.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, x = _quantised(batch.column(1), scale)
            white, centred = _projected(model, _matrix(size, x, d))
            rows = np.repeat(np.arange(len(at)), kinds)
            values = pa.array(np.where(np.array(model.roots) > 0, white, np.nan).ravel(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(at, kinds))), pa.array(np.tile(np.arange(1, kinds + 1, dtype=np.int32), len(at))),
                pa.array(np.full(len(rows), model.n)), pa.array(_deviation(centred), pa.int64()).take(pa.array(rows)), values,
                pa.array(np.tile(np.array(model.explained, float), len(at))), pa.array([error] * len(rows), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return base.mapInArrow(run, schema)
