"""Word and shingle hashes of whole Arrow string columns, in numpy.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  All words of a
block of documents are hashed together, eight bytes at a time.  64-bit hashes
stand for words and shingles; two different ones agree with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
BLOCK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _table(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


#: The lowest 0 to 8 bytes of a 64-bit value.
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=_U)
_STEP = _table(64, 101) | _U(1)

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but digits and lower-case letters separates words.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[128:] = False
NOT_ALNUM[48:58] = False
NOT_ALNUM[97:123] = False


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of consecutive rows with about ``size`` bytes; a long row is a block of its own."""
    column = column.cast(pa.string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        yield at, raw[off[at]: off[to]], off[at: to + 1] - off[at]
        at = to


def word_spans(raw: np.ndarray, off: np.ndarray, spaces: np.ndarray = SPACES):
    """Starts and ends (bytes) of the words of a block, and word offsets of its rows."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~spaces[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word, from its bytes eight at a time; ``lower`` folds A-Z."""
    if not len(starts):
        return np.zeros(0, _U)
    if lower:
        raw = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(raw) + 1,), "<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    out = np.empty(len(starts), _U)
    with np.errstate(over="ignore"):
        step = 1 << 16
        for at in range(0, len(starts), step):
            size = lengths[at: at + step]
            begin = starts[at: at + step]
            total = mix((eights[begin] & _KEEP[np.minimum(size, 8)]) + size.astype(_U) * _U(0xD6E8FEB86659FD93))
            more, eaten = np.flatnonzero(size > 8), 8
            while len(more):
                total[more] = mix((total[more] ^ (eights[begin[more] + eaten] & _KEEP[np.minimum(size[more] - eaten, 8)]))
                                  * _U(0x9E3779B97F4A7C15) + _U(eaten))
                eaten += 8
                more = more[size[more] > eaten]
            out[at: at + step] = total
    return out


def shingles(words: np.ndarray, rows: np.ndarray, k: int, short: bool = True):
    """Hashes of the ``k``-word windows of each row, and window offsets of the rows.

    With ``short``, a row of 1 to k-1 words has its whole sequence as one window.
    """
    n = len(words)
    count = np.diff(rows)
    made = np.where(count >= k, count - k + 1, (count > 0) if short else 0).astype(np.int64)
    off = np.concatenate(([0], np.cumsum(made)))
    if not off[-1]:
        return np.zeros(0, _U), off
    at = np.arange(off[-1]) - np.repeat(off[:-1], made) + np.repeat(rows[:-1], made)
    have = np.repeat(np.minimum(count, k), made)
    padded = np.concatenate((words, np.zeros(k, _U)))
    with np.errstate(over="ignore"):
        total = have.astype(_U) * _U(0xA0761D6478BD642F)
        few = have.min() < k
        for j in range(k):
            part = padded[at + j] * _STEP[j % 64] * _U(2 * (j // 64) + 1)
            total += np.where(have > j, part, _U(0)) if few else part
    return mix(total), off


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    new = np.empty(len(values), dtype=bool)
    new[0] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_sets(column: pa.Array, k: int = 5, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a string column."""
    for at, raw, off in blocks(column):
        starts, ends, rows = word_spans(raw, off)
        hashes, cuts = shingles(word_hashes(raw, starts, ends, lower), rows, k)
        for i in range(len(off) - 1):
            yield at + i, distinct(hashes[cuts[i]: cuts[i + 1]])
