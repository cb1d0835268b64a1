"""Vectorised word handling over Arrow string columns.

A whole slice of documents is treated as one byte array: word boundaries, word hashes and
rolling sequence hashes are computed with a handful of numpy passes instead of a Python loop
per word.  Separators are ASCII, so working on UTF-8 bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; a longer document is handled alone.
SLICE_BYTES = 1 << 18

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15 | 3)
_INV = _U(pow(int(_MULT), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes that no word of letters, digits and other alphabets holds, in lower-cased text.
SIGNS = np.zeros(256, dtype=bool)
SIGNS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _power(mult: np.uint64, n: int) -> np.ndarray:
    """mult ** 0 .. mult ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _powers.get(int(mult))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), mult, dtype=np.uint64)
        have[0] = 1
        _powers[int(mult)] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def slices(column: pa.Array, cap: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts hold at most ``cap`` bytes, or one long row."""
    column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + cap, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()
    off = np.frombuffer(raw[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range start .. end of ``data``; ranges come in order and don't overlap."""
    out, i = np.empty(len(start), dtype=np.uint64), 0
    while i < len(start):  # a stretch at a time, so that a long text needs no long table of powers
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, lo + SLICE_BYTES, "right")))
        out[i:j] = _span_keys(data[lo : end[j - 1]], start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def _span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * _power(_MULT, n), out=total[1:])
    h = (total[end] - total[start]) * _power(_INV, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64))


class Words:
    """Words of a slice of documents: runs without ``blank`` bytes, white space if not said otherwise.

    start, end: byte ranges in ``data``; first: index of each document's first word, with one
    entry more for the end; key: 64-bit hash of each word.
    """

    def __init__(self, column: pa.Array, lower: bool = False, blank: np.ndarray = SPACE):
        data, off = as_bytes(column)
        self.data, self.off, self.blank = (LOWER[data] if lower else data), off, blank
        inside = ~blank[self.data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        cuts = off[:-1][np.diff(off) > 0]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[cuts[1:] - 1] = False
        if len(after):
            after[-1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    @property
    def key(self) -> np.ndarray:
        return span_keys(self.data, self.start, self.end)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all words, each followed by one space, and the start of each word there."""
        length = self.end - self.start + 1
        at = np.zeros(len(length) + 1, dtype=np.int64)
        np.cumsum(length, out=at[1:])
        out = np.full(at[-1], 32, dtype=np.uint8)
        keep = np.ones(at[-1], dtype=bool)
        keep[at[1:] - 1] = False
        if len(self.data):
            out[keep] = self.data[~self.blank[self.data]]
        return out, at


def rolling(key: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` keys; entry i covers keys i .. i + width - 1."""
    n = len(key) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = key[:n].copy()
    for j in range(1, width):
        h *= _MULT
        h += key[j : j + n]
    return mix(h)


def within(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the ``n`` run starts of ``rolling`` lie with their whole run in one document."""
    ok = np.ones(n, dtype=bool)
    for j in range(1, width):
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def pool_min(value: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` consecutive values, by doubling."""
    n, have = len(value) - width + 1, 1
    if n <= 0:
        return value[:0]
    out = value
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]
