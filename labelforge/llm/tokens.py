"""Vectorised word handling for Arrow batches: words of a whole batch are found, lower-cased and
hashed with numpy on the UTF-8 bytes, without a Python object per word.

Byte-wise work is exact: white space, ASCII punctuation and A-Z are single bytes in UTF-8 and
never part of a longer sequence. Word hashes are 64 bits wide; two different words share one with
probability 2^-64, which every user of these hashes accepts or re-checks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19  # text handled at once inside a task: bounds numpy's temporaries

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: words [^\x20\x09-\x0D]+
SPACE_WORDS = _SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM_WORDS = _ALNUM

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of consecutive texts: byte range [start, end) in ``data``, and for text i the words
    ``bounds[i]:bounds[i + 1]``. ``data`` is lower-cased (A-Z) if asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
        n = len(data)
        self.offsets, self.data = offsets, _LOWER[data] if lower else data
        inside = table[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.empty(0, np.uint64)
        up, down = _powers(len(self.data))
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[self.data] * up, out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h ^ (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def hash_of(words: list[str] | list[bytes]) -> np.ndarray:
    """The hashes ``Words.hashes`` gives to these words."""
    raw = [w.encode() if isinstance(w, str) else w for w in words]
    off = np.cumsum([0] + [len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return Words(data, off, np.ones(256, bool), lower=False).hashes()


def runs(h: np.ndarray, offsets: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """Hash of the words at p + each offset, for every p where all of them exist."""
    n = len(h) - max(offsets)
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, (salt * 2 + 1) * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
    for k, o in enumerate(offsets):
        acc += h[o:o + n] * np.uint64(pow(_BASE, 2 * k + 3, 2**64))
    return mix(acc)


def text_chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of row ranges of about CHUNK_BYTES; null is empty.
    One text is never cut, so a longer one is a range of its own."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b
