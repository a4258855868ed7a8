"""Vectorised byte-level text primitives shared by the operators of this subpackage.

Everything here works on an Arrow string column viewed as one flat ``uint8`` buffer plus row
offsets, so no Python object is made per row or per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)

#: byte -> lower-cased byte of a word character, 0 for a separator. Bytes of multi-byte
#: characters count as word characters.
WORD_LUT = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or (_c.isascii() and (_c.isalnum())):
        WORD_LUT[_b] = ord(_c.lower()) if _b < 128 else _b


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary array; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off_buf, data_buf = column.buffers()
    n = len(column)
    kind = np.int64 if wide else np.int32
    if off_buf is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(off_buf, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data_buf is None:
        return np.zeros(0, np.uint8), off - off[0]
    data = np.frombuffer(data_buf, np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(off: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, so that temporaries stay small; one very long
    row is a range of its own."""
    out, n, i = [], len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        out.append((i, j))
        i = j
    return out


class Words:
    """Words of many rows: ``hash`` (uint64), ``length`` in bytes, ``bounds`` (row i owns words
    ``bounds[i]:bounds[i+1]``), ``start`` (byte offset)."""

    __slots__ = ("hash", "length", "bounds", "start", "_body", "_at", "_power")

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = WORD_LUT[data]
        isw = low != 0
        n = len(data)
        rows = len(off) - 1
        begin = np.empty(n, bool)
        if n:
            begin[0] = True
            np.logical_not(isw[:-1], out=begin[1:])
            cut = off[1:-1]
            begin[cut[cut < n]] = True
            begin &= isw
        self.start = np.flatnonzero(begin)
        body = low[isw]
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            self.length = np.zeros(0, np.int64)
            self.bounds = np.zeros(rows + 1, np.int64)
            self._body, self._at, self._power = body, self.start, np.ones(1, np.uint64)
            return
        # position of each word's first byte among the word bytes only
        at = np.flatnonzero(begin[isw])
        self.length = np.diff(np.append(at, len(body)))
        self.bounds = np.searchsorted(self.start, off)
        most = int(self.length.max())
        power = np.empty(most, np.uint64)
        power[0] = 1
        if most > 1:
            power[1:] = _BASE | np.uint64(1)
            power = np.multiply.accumulate(power)
        pos = np.arange(len(body), dtype=np.int64) - np.repeat(at, self.length)
        val = power[pos]
        val *= body
        self.hash = mix64(np.add.reduceat(val, at))
        self._body, self._at, self._power = body, at, power

    def prefix(self, k: int, which: np.ndarray) -> np.ndarray:
        """Hashes of the first ``k`` bytes of the words ``which``, all of them at least that long."""
        at = self._at[which]
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h += self._body[at + j] * self._power[j] if j < len(self._power) else np.uint64(0)
        return mix64(h, 77)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def distinct(self) -> np.ndarray:
        """Indices of one word of each (row, hash), by row."""
        row = self.rows()
        order = np.lexsort((self.hash, row))
        h, r = self.hash[order], row[order]
        keep = np.ones(len(order), bool)
        keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        return order[keep]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i+1]]`` along axis 0, 0 for an empty row."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.int64 if values.dtype.kind in "iub" else np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=out.dtype)
    return out
