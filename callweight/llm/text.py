"""Vectorised text primitives shared by the corpus operators.

All work is done on the UTF-8 bytes of an Arrow column, a few megabytes at a time, so no Python
string is made per row or per word. A word is a maximal run of bytes other than space and
0x09-0x0D, which equals the pattern ``[^\\x20\\x09-\\x0D]+`` on code points; A-Z is lower-cased.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # bytes of text taken at once; a longer single text makes a chunk of its own
TOKEN_BITS = 48

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_COEF = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of the base and of its inverse, made where they are used: pickled empty."""

    def __init__(self) -> None:
        self.fwd = self.inv = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.fwd) < n:
            out = []
            for base in (_BASE, _INV):
                p = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.fwd, self.inv = out
        return self.fwd[:n], self.inv[:n]


_POW = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _POW.upto(n)


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `size` bytes and at most `rows` rows."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + rows)
        yield lo, hi
        lo = hi


class Words(NamedTuple):
    """Words of a run of texts: lowered bytes, start and end of each word, its row, its hash."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    n_rows: int


def words(data: np.ndarray, off: np.ndarray, hashed: bool = True) -> Words:
    """Split the texts data[off[i]:off[i+1]] into lower-cased words."""
    n = len(data)
    buf = LOWER[data]
    solid = ~SPACE[buf]
    first = np.zeros(n + 1, dtype=bool)  # a text starts here, so no word runs over it
    first[off] = True
    head = solid.copy()
    head[1:] &= ~solid[:-1] | first[1:n]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:] | first[1:n]
    start = np.flatnonzero(head)
    end = np.flatnonzero(tail) + 1
    row = np.searchsorted(off, start, side="right") - 1
    h = np.zeros(0, np.uint64)
    if hashed:
        fwd, inv = _powers(n + 1)
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * fwd[:n], out=acc[1:])
        h = mix((acc[end] - acc[start]) * inv[start] + (end - start).astype(np.uint64))
    return Words(buf, start, end, row, h, len(off) - 1)


def words_of(blobs: list[bytes], size: int = CHUNK_BYTES) -> Words:
    """Words of many runs of bytes as one text, a bounded part at a time; no word crosses blobs."""
    out, lo, base = [], 0, 0
    while lo < len(blobs):
        hi, n = lo, 0
        while hi < len(blobs) and (hi == lo or n + len(blobs[hi]) <= size):
            n += len(blobs[hi])
            hi += 1
        off = np.concatenate(([0], np.cumsum([len(b) for b in blobs[lo:hi]])))
        w = words(np.frombuffer(b"".join(blobs[lo:hi]), np.uint8), off)
        out.append((w.buf, w.start + base, w.end + base, w.hash))
        base += n
        lo = hi
    if not out:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), z, z, z, np.zeros(0, np.uint64), 1)
    buf, start, end, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return Words(buf, start, end, np.zeros(len(start), np.int64), h, 1)


def release() -> None:
    """Give freed memory back to the system; a worker otherwise keeps the peak of its largest group."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def word_texts(w: Words, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the words `at`, joined, and their lengths."""
    ln = w.end[at] - w.start[at]
    pos = np.repeat(w.start[at] - np.concatenate(([0], np.cumsum(ln)[:-1])), ln) + np.arange(int(ln.sum()))
    return w.buf[pos].tobytes(), ln


def shingles(w: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of every run of k words. Texts with fewer words give their whole
    sequence as one run if `short`."""
    n = len(w.hash)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    m = max(n - k + 1, 0)
    acc = np.zeros(m, np.uint64)
    for j in range(k):
        acc += w.hash[j : j + m] * _COEF[j]
    at = np.flatnonzero(w.row[:m] == w.row[k - 1 : k - 1 + m]) if m else np.zeros(0, np.int64)
    row, h = w.row[at], acc[at]
    if short:
        cnt = np.bincount(w.row, minlength=w.n_rows)
        begin = np.concatenate(([0], np.cumsum(cnt)[:-1]))
        few = np.flatnonzero((cnt > 0) & (cnt < k))
        if len(few):
            s = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                ok = cnt[few] > j
                s[ok] += w.hash[begin[few[ok]] + j] * _COEF[j]
            s += cnt[few].astype(np.uint64) * _COEF[63]
            row, at, h = np.concatenate((row, few)), np.concatenate((at, begin[few])), np.concatenate((h, s))
            o = np.argsort(row, kind="stable")
            row, at, h = row[o], at[o], h[o]
    return row, at, mix(h)


def text_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token): the distinct k-word shingles of every text as 48-bit tokens, sorted by both."""
    row, _, h = shingles(w, k)
    key = np.unique((row.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (h >> np.uint64(64 - TOKEN_BITS)))
    return (key >> np.uint64(TOKEN_BITS)).astype(np.int64), key & np.uint64((1 << TOKEN_BITS) - 1)


def pack(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw, width: int) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :width] = b
    return out.view("<u8").ravel()


def pack48(tok: np.ndarray) -> bytes:
    return pack(tok, 6)


def unpack48(raw) -> np.ndarray:
    return unpack(raw, 6)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal neighbours in x."""
    if len(x) == 0:
        z = np.zeros(0, np.int64)
        return z, z
    s = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return s, np.diff(np.append(s, len(x)))
