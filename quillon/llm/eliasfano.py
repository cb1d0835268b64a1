"""Elias-Fano sequences over numpy arrays that may be memory-mapped.

A non-decreasing sequence of 64-bit numbers is split into low bits, kept as whole bytes, and high
parts, kept in unary: number i is the one at place high + i of a bit vector.  Two directories with an
entry for each 256 bits make both kinds of places (of the k-th one, of the k-th zero) quick to find.

Sequences with equal numbers of low bits that stand behind each other are one sequence, too: each
one's high parts begin at the zeros before it.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 256
#: Numbers worked on together: their arrays stay in the processor's cache.
CHUNK = 1 << 15
_01, _33, _55, _0F, _80 = (U(int(x * 8, 16)) for x in ("01", "33", "55", "0f", "80"))
#: Place of the k-th one within a byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], dtype=np.int64)


def low_bits(n: int, top: int) -> int:
    """Low bits that take least room for ``n`` numbers up to ``top``."""
    return min(range(0, 64, 8), key=lambda b: n * b + (top >> b))


def arrays(v: np.ndarray, bits: int | None = None) -> dict[str, np.ndarray]:
    """The parts of a sequence: bits (unary), ones and zeros (directories), low8/low16 (low bits), meta."""
    n, top = len(v), int(v[-1]) if len(v) else 0
    bits = low_bits(n, top) if bits is None else bits
    high = (v >> U(bits)).astype(np.int64)
    places = n + (top >> bits) + 1
    unary = np.zeros((places + BLOCK - 1) // BLOCK * BLOCK + BLOCK, dtype=np.uint8)
    unary[high + np.arange(n)] = 1
    words = np.packbits(unary, bitorder="little").view(np.uint64)
    each = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
    ones = np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.int64)
    out = {"bits": words, "ones": ones, "zeros": np.arange(len(ones), dtype=np.int64) * BLOCK - ones, "meta": np.array([n, bits, top >> bits], dtype=np.int64)}
    for k in range(0, bits, 16):
        part = v >> U(k)
        out[f"low{k}"] = part.astype(np.uint16) if bits - k >= 16 else part.astype(np.uint8)
    return out


def _in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of one number k in each 64-bit word."""
    s = x - ((x >> U(1)) & _55)
    s = (s & _33) + ((s >> U(2)) & _33)
    s = ((s + (s >> U(4))) & _0F) * _01  # ones up to each byte
    r = k.astype(np.uint64)
    place = np.bitwise_count(((r * _01 | _80) - s) & _80).astype(np.uint64) << U(3)
    r -= ((s << U(8)) >> place) & U(255)
    return place.astype(np.int64) + _IN_BYTE[((x >> place) & U(255)).astype(np.int64), r.astype(np.int64)]


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.unary, self.ones, self.zeros = parts["bits"], parts["ones"], parts["zeros"]
        self.n, self.bits, self.top = (int(x) for x in parts["meta"])
        self.low = [(U(k), parts[f"low{k}"]) for k in range(0, self.bits, 16)]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for k, part in self.low:
            out |= part[i].astype(np.uint64) << k
        return out

    def _place(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of one (or zero) number k."""
        before = self.zeros if zeros else self.ones
        block = np.searchsorted(before, k, "right") - 1
        left = k - before[block]
        words = self.unary.reshape(-1, 4)[block]
        words = ~words if zeros else words
        upto = np.bitwise_count(words).view(np.uint32).ravel().astype(np.int64) * 0x010101 & 0xFFFFFF  # of the first one, two, three words
        a, b, c = upto & 255, upto >> 8 & 255, upto >> 16
        word = (left >= a).astype(np.int64) + (left >= b) + (left >= c)
        left -= np.where(word == 0, 0, np.where(word == 1, a, np.where(word == 2, b, c)))
        return (block * 4 + word) * 64 + _in_word(words[np.arange(len(k)), word], left)

    def _window(self, q: np.ndarray) -> np.ndarray:
        """The 64 bits from each place."""
        w, s = q >> 6, (q & 63).astype(np.uint64)
        return (self.unary[w] >> s) | np.where(s > 0, self.unary[np.minimum(w + 1, len(self.unary) - 1)] << ((U(64) - s) & U(63)), U(0))

    def _run(self, q: np.ndarray) -> np.ndarray:
        """How many ones follow from each place on."""
        x = self._window(q)
        out = np.bitwise_count(x & ~(x + U(1))).astype(np.int64)
        more = np.flatnonzero(out == 64)
        while len(more):
            x = self._window(q[more] + out[more])
            t = np.bitwise_count(x & ~(x + U(1))).astype(np.int64)
            out[more] += t
            more = more[t == 64]
        return out

    def find(self, v: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value of a strictly increasing sequence, -1 if it isn't there; with ``first``
        and ``end``: searched among those places only."""
        out = np.full(len(v), -1, dtype=np.int64)
        if self.n:
            for lo in range(0, len(v), CHUNK):
                part = slice(lo, lo + CHUNK)
                out[part] = self._find(v[part], None if first is None else first[part], None if end is None else end[part])
        return out

    def _find(self, v: np.ndarray, first: np.ndarray | None, end: np.ndarray | None) -> np.ndarray:
        high = v >> U(self.bits)
        inside = high <= U(self.top)
        h = np.where(inside, high, U(0)).astype(np.int64)
        start = np.where(h > 0, self._place(np.maximum(h - 1, 0), True) + 1, 0)
        a = start - h  # numbers with smaller high parts
        b = a + self._run(start)
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, end)
        want = v & U((1 << self.bits) - 1)
        open_ = np.flatnonzero(inside & (a < b))
        found = np.full(len(v), -1, dtype=np.int64)
        while len(open_):
            m = (a[open_] + b[open_]) >> 1
            here, x = self._lows(m), want[open_]
            equal, less = here == x, here < x
            found[open_[equal]] = m[equal]
            a[open_] = np.where(less, m + 1, a[open_])
            b[open_] = np.where(less, b[open_], m)
            open_ = open_[~equal & (a[open_] < b[open_])]
        return found

    def two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers i and i + 1."""
        a, b = np.empty(len(i), dtype=np.int64), np.empty(len(i), dtype=np.int64)
        for lo in range(0, len(i), CHUNK):
            part = slice(lo, lo + CHUNK)
            a[part], b[part] = self._two(i[part])
        return a, b

    def _two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self._place(i, False)
        x = self._window(p + 1)
        gap = np.bitwise_count(~x & (x - U(1))).astype(np.int64)
        q = p + 1 + gap
        far = np.flatnonzero(gap == 64)
        if len(far):
            q[far] = self._place(i[far] + 1, False)
        return (((p - i) << self.bits) | self._lows(i).astype(np.int64)), (((q - i - 1) << self.bits) | self._lows(i + 1).astype(np.int64))
