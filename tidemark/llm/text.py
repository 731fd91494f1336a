"""Vectorised byte-level primitives: Arrow text columns to word, shingle and k-gram hashes.

Everything works on the UTF-8 bytes that Arrow hands over, so no Python string is made per word.
Hashes are polynomial prefix sums modulo 2**64 over a random byte table, finished by a mixer; they
depend on content alone and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(7121)
RAW = _rng.integers(1, 2**64 - 1, 256, dtype=U64)
FOLD = RAW.copy()  # A-Z count as a-z
FOLD[65:91] = RAW[97:123]
MUL = _rng.integers(1, 2**64 - 1, 64, dtype=U64) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = 0xD1342543DE82EF95
_pw = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _inv
    if len(_pw) < n:
        size = max(n, 1 << 21)
        out = []
        for r in (_R, pow(_R, -1, 2**64)):
            x = np.full(size, r, U64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _pw, _inv = out
    return _pw, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix(data: np.ndarray, table: np.ndarray = RAW) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums c and inverse powers: the bytes [a, b) hash to (c[b] - c[a]) * inv[a]."""
    pw, inv = _powers(len(data) + 1)
    c = np.empty(len(data) + 1, U64)
    c[0] = 0
    np.cumsum(table[data] * pw[: len(data)], out=c[1:])
    return c, inv


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of at most limit bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word ``[^\\x20\\x09-\\x0D]+``, A-Z folded; words end with their row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    ink = ~SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = ~ink[:-1], ~ink[1:]
    edge = off[1:-1]
    before[edge[edge < n]] = True
    after[edge[edge > 0] - 1] = True
    start, end = np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1
    c, inv = prefix(data, FOLD)
    h = mix((c[end] - c[start]) * inv[start] + (end - start).astype(U64))
    return h, np.searchsorted(off, start, side="right") - 1, start, end


def starts(data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the first k bytes of words(), as a word of these bytes has; shorter words keep their own hash."""
    c, inv = prefix(data, FOLD)
    stop = np.minimum(end, start + k)
    return mix((c[stop] - c[start]) * inv[start] + (stop - start).astype(U64))


def grams(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the k-word sequences in order; a row of fewer words, but not none, gives its whole sequence."""
    count = np.bincount(row, minlength=rows)
    m = len(h) - k + 1
    if m > 0:
        ok = row[:m] == row[k - 1 :]
        x = h[:m] * MUL[0]
        for j in range(1, k):
            x += h[j : m + j] * MUL[j]
        g, r = mix(x[ok]), row[:m][ok]
    else:
        g, r = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = (np.cumsum(count) - count)[short]
        x = count[short].astype(U64) * MUL[40]
        for j in range(k - 1):
            has = count[short] > j
            x[has] += h[first[has] + j] * MUL[j]
        at = np.searchsorted(r, short)
        g, r = np.insert(g, at, mix(x)), np.insert(r, at, short)
    return g, r


def sets(g: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, and the rows' bounds (rows + 1 offsets)."""
    g = g.copy()
    bound = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a > 1:
            g[a:b].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[keep], np.concatenate([[0], np.cumsum(keep)])[bound]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set of each row: (ascending distinct hashes, bounds)."""
    h, row, _, _ = words(data, off)
    g, r = grams(h, row, len(off) - 1, k)
    return sets(g, r, len(off) - 1)


def runs(x: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal neighbours, with len(x) at the end."""
    if not len(x):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
