"""Token ids of whole Arrow string columns.

A byte-level BPE tokenizer never joins text across the start of white space, so a
text splits there into chunks (white space, then the rest) whose ids only depend
on the chunk.  Each distinct chunk is encoded once per worker, many at a time,
and the ids of all texts are gathered in numpy.  Texts with white space outside
ASCII are encoded whole.  The ids are those of the ``tokenizers`` file of the same
vocabulary with ``add_special_tokens=False``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import SPACES, blocks, word_hashes

MAX_CACHE = 1_000_000
#: First bytes of the UTF-8 forms of white space outside ASCII, and the separators x1c to x1f.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
BLOCK_BYTES = 2 << 20


class Encoder:
    """Encodes with a file of byte-level BPE ranks and its pre-tokenizer pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._size = np.zeros(1 << 16, np.int64)
        for token, i in ranks.items():
            self._size[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self._known, self._place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # chunks ascending, and where their ids are noted
        self._first, self._count, self._ids, self._used = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], 0

    def _learn(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new chunks: those from white space to other text joined, the rest one by one."""
        inner = SPACES[raw[starts]] & ~SPACES[raw[ends - 1]]
        size = (ends - starts)[inner]
        off = np.cumsum(size) - size
        joined = raw[np.arange(size.sum()) - np.repeat(off, size) + np.repeat(starts[inner], size)].tobytes()
        ids = np.array(self._bpe.encode_ordinary(joined.decode()), np.uint16)
        cuts = np.searchsorted(np.cumsum(self._size[ids]), off + size, side="left") + 1
        self._keep(keys[inner], np.diff(np.concatenate(([0], cuts))), ids)
        single = [np.array(self._bpe.encode_ordinary(raw[a:b].tobytes().decode()), np.uint16)
                  for a, b in zip(starts[~inner], ends[~inner], strict=True)]
        if single:
            self._keep(keys[~inner], np.array([len(x) for x in single]), np.concatenate(single))

    def _keep(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        at, where = len(self._known), np.searchsorted(self._known, keys)
        self._known = np.insert(self._known, where, keys)
        self._place = np.insert(self._place, where, np.arange(at, at + len(keys)))
        self._first.append(np.cumsum(count) - count + self._used)
        self._count.append(count)
        self._ids.append(ids)
        self._used += len(ids)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where the ids of known chunks are noted; -1 for others."""
        where = np.searchsorted(self._known, keys)
        out = np.full(len(keys), -1)
        inside = np.flatnonzero(where < len(self._known))
        inside = inside[self._known[where[inside]] == keys[inside]]
        out[inside] = self._place[where[inside]]
        return out

    def encode_block(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids (uint16) of each row of a block."""
        n = len(raw)
        if not n:
            return [np.zeros(0, np.uint16)] * (len(off) - 1)
        white = SPACES[raw]
        first = np.zeros(n + 1, dtype=bool)
        first[off] = True
        first[1:n] |= white[1:] & ~white[:-1]
        starts = np.flatnonzero(first[:n])
        ends = np.append(starts[1:], n)
        keys, which, inverse = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self._known) > MAX_CACHE:
            self._clear()
        at = self._places(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(keys[new], raw, starts[which[new]], ends[which[new]])
            at[new] = self._places(keys[new])
        if len(self._ids) > 16:
            self._first, self._count, self._ids = ([np.concatenate(x)] for x in (self._first, self._count, self._ids))
        all_first, all_count, pool = (np.concatenate(x) if len(x) > 1 else x[0] for x in (self._first, self._count, self._ids))
        at = at[inverse]
        count = all_count[at]
        total = np.cumsum(count)
        ids = pool[np.arange(total[-1]) - np.repeat(total - count, count) + np.repeat(all_first[at], count)]
        rows = np.concatenate(([0], total))[np.searchsorted(starts, off)]
        out = np.split(ids, rows[1:-1])
        odd = np.flatnonzero(_LEAD[raw])
        if len(odd):
            for i in np.unique(np.searchsorted(off, odd, side="right") - 1):
                text = raw[off[i]: off[i + 1]].tobytes().decode()
                if any(c.isspace() and c not in " \t\n\x0b\x0c\r" for c in text):
                    out[i] = np.array(self._bpe.encode_ordinary(text), np.uint16)
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for at, raw, off in blocks(column, BLOCK_BYTES):
            for i, ids in enumerate(self.encode_block(raw, off)):
                yield at + i, ids
