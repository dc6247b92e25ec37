"""Elias-Fano coding of sorted integers in numpy, over memory-mapped arrays, with batched search.

The low ``l`` bits of each value are packed; the high parts are a unary bit vector.  A directory of set bits per 512 bits
serves select by a search in the directory and a count inside the block, for arrays of queries at a time.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 8  # 64-bit words
_U = np.uint64
_IN_BYTE = np.full((256, 8), 8, np.uint8)  # the place of the k-th set bit of a byte
for _b in range(256):
    _places = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, : len(_places)] = _places


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits, one after the other in 64-bit words (one word more for reads across words)."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 1, _U)
    if not width or not n:
        return out
    at = np.arange(n, dtype=np.int64) * width
    word, off = at >> 6, (at & 63).astype(_U)
    np.bitwise_or.at(out, word, values << off)
    over = (at & 63) + width > 64
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - off[over]))
    return out


def read_bits(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), _U)
    at = i * width
    word, off = at >> 6, (at & 63).astype(_U)
    high = np.where(off == 0, _U(0), words[word + 1] << ((_U(64) - off) & _U(63)))
    return ((words[word] >> off) | high) & _U((1 << width) - 1)


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a sorted uint64 sequence."""
    values = values.astype(_U)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> _U(low)).astype(np.int64) + np.arange(n)
    size = n + (top >> low) + 2
    bits = np.zeros(-(-size // (64 * _BLOCK)) * 64 * _BLOCK, np.uint8)
    bits[high] = 1
    words = np.packbits(bits, bitorder="little").view(_U)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))))
    return {"low": pack_bits(values & _U((1 << low) - 1), low), "high": words, "ones": ones.astype(np.int64), "meta": np.array([n, low, top >> low], np.int64)}


def _parts(n: int, step: int = 1 << 17) -> list[slice]:
    """Queries are served a part at a time: select looks at a whole block of the bit vector for each."""
    return [slice(a, a + step) for a in range(0, n, step)]


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, kind)


_ONE_8, _TOP_8, _ONE_16, _TOP_16 = _U(0x0101010101010101), _U(0x8080808080808080), _U(0x0001000100010001), _U(0x8000800080008000)


class EliasFano:
    """Batched access and search over the arrays of ``encode``."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.low, self.high, self.ones = (arrays[prefix + k] for k in ("low", "high", "ones"))
        self.n, self.width, self.most = (int(x) for x in arrays[prefix + "meta"])
        self.blocks = self.high.reshape(-1, _BLOCK)
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * (64 * _BLOCK) - self.ones

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th (from 0) bit of that kind."""
        directory = self.ones if bit else self.zeros
        block = np.searchsorted(directory, k, side="right") - 1
        words = self.blocks[block]
        words = words if bit else ~words
        left = k - directory[block]
        # The sums of the words' bits, four to a number of 64 bits, and how many of them are not above what is left.
        upto = np.bitwise_count(words).astype(np.uint16).view(_U) * _ONE_16
        for i in range(1, upto.shape[1]):
            upto[:, i] += (upto[:, i - 1] >> _U(48)) * _ONE_16
        word = np.zeros(len(k), np.int64)
        wanted = left.astype(_U) * _ONE_16 | _TOP_16
        for i in range(upto.shape[1]):
            word += np.bitwise_count((wanted - upto[:, i]) & _TOP_16)
        each = np.arange(len(k))
        left -= np.where(word > 0, upto.view(np.uint16)[each, word - 1], 0)
        # The same with the bytes of the word.
        bits = words[each, word]
        upto = np.bitwise_count(bits.view(np.uint8)).view(_U) * _ONE_8
        octet = np.bitwise_count(((left.astype(_U) * _ONE_8 | _TOP_8) - upto) & _TOP_8).astype(_U) << _U(3)
        left -= ((upto << _U(8) >> octet) & _U(255)).astype(np.int64)
        octet_bits = (bits >> octet) & _U(255)
        return block * (64 * _BLOCK) + word * 64 + octet.astype(np.int64) + _IN_BYTE[octet_bits, left]

    def _next(self, place: np.ndarray, bit: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th bit of that kind, the first one from ``place`` on: most often in the next 64 bits."""
        word, off = place >> 6, (place & 63).astype(_U)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)]
        seen = (self.high[np.minimum(word, len(self.high) - 1)] >> off) | np.where(off == 0, _U(0), after << ((_U(64) - off) & _U(63)))
        seen = seen if bit else ~seen
        out = place + np.bitwise_count((seen & (~seen + _U(1))) - _U(1))
        far = np.flatnonzero((seen == 0) | (off > 0) & (word + 1 >= len(self.high)))
        if len(far):
            out[far] = self._select(k[far], bit)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at indexes."""
        return _joined([self._get(i[part]) for part in _parts(len(i))], _U)

    def _get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, 1) - i).astype(_U)
        return (high << _U(self.width)) | read_bits(self.low, self.width, i)

    def span(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values i and i + 1."""
        both = [self._span(i[part]) for part in _parts(len(i))]
        return _joined([x for x, _ in both], _U), _joined([x for _, x in both], _U)

    def _span(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self._select(i, 1)
        first = ((place - i).astype(_U) << _U(self.width)) | read_bits(self.low, self.width, i)
        j = i + 1
        second = ((self._next(place + 1, 1, j) - j).astype(_U) << _U(self.width)) | read_bits(self.low, self.width, j)
        return first, second

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The index of each value, -1 where it is not there: a successor search among the values that share its high
        part, and from index ``first`` to before ``last`` where these are given."""
        cut = lambda bounds, part: None if bounds is None else bounds[part]
        return _joined([self._find(x[part], cut(first, part), cut(last, part)) for part in _parts(len(x))], np.int64)

    def _find(self, x: np.ndarray, first: np.ndarray | None, last: np.ndarray | None) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = (x >> _U(self.width)).astype(np.int64)
        at = np.flatnonzero((x >> _U(self.width)) <= _U(self.most))
        high, low = high[at], x[at] & _U((1 << self.width) - 1)
        place = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) + 1, 0)
        begin, end = place - high, self._next(place, 0, high) - high
        if first is not None:
            begin, end = np.maximum(begin, first[at]), np.minimum(end, last[at])
        lo, hi = begin.copy(), end.copy()
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                break
            mid = (lo[go] + hi[go]) >> 1
            less = read_bits(self.low, self.width, mid) < low[go]
            lo[go[less]] = mid[less] + 1
            hi[go[~less]] = mid[~less]
        inside = np.flatnonzero(lo < end)
        inside = inside[read_bits(self.low, self.width, lo[inside]) == low[inside]]
        out[at[inside]] = lo[inside]
        return out
