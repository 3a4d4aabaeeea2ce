"""Word and phrase hashes of many texts at once, in numpy over the raw UTF-8 bytes.

A word is a run of bytes other than space and 0x09 to 0x0D. Its 64-bit hash is a polynomial of its bytes
over Z/2^64, put through a finaliser; a phrase's hash is such a polynomial of its words' hashes. Both are
differences of running sums, so any phrase length costs the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from refloom.llm.common import worker_state

#: Bytes of text that are taken apart at a time; each needs about 60 bytes of memory while it is.
BLOCK_BYTES = 1 << 17

_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_SECOND_BYTE_BASE, _SECOND_WORD_BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse powers for i < n, kept in this process."""
    kept = worker_state().__dict__.setdefault("powers", {})
    if base not in kept or len(kept[base][0]) < n:
        size = max(n, BLOCK_BYTES + 65536)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=_U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        kept[base] = tuple(both)
    return kept[base]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Is a byte white space; a random number for each byte; the same with A-Z as a-z."""
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    values = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
    lower = np.arange(256)
    lower[65:91] += 32
    return space, values, values[lower]


class Words:
    """Words of a block of texts: starts, ends (byte positions in data), doc (index of the text), hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        space, values, lowered = _tables()
        self.data, self.offsets = data, offsets
        n = len(data)
        if not n:
            self.starts = self.ends = self.doc = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, _U)
            return
        word = ~space[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        bounds = offsets[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < n)]
        first[bounds] |= word[bounds]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[bounds - 1] |= word[bounds - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        power, inverse = _powers(_BYTE_BASE, n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((lowered if lower else values)[data] * power[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(_U))

    def second(self) -> np.ndarray:
        """Hashes of the words as they are, by another polynomial; with the first they make 128 bits."""
        n = len(self.data)
        if not n:
            return self.hashes
        power, inverse = _powers(_SECOND_BYTE_BASE, n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(mix(self.data.astype(_U) + _U(257)) * power[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(_U))

    def phrases(self, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every phrase of k words inside one text. second: of the words' other hashes."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        power, inverse = _powers(_SECOND_WORD_BASE if second else _WORD_BASE, n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((self.second() if second else self.hashes) * power[:n], out=sums[1:])
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, mix((sums[at + k] - sums[at]) * inverse[at] + _U(k))

    def phrase_at(self, start: int, end: int, k: int) -> np.ndarray:
        """The hash of the k words from each of the words start to end - k on, across the ends of texts too."""
        n = end - start
        power, inverse = _powers(_WORD_BASE, n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(self.hashes[start:end] * power[:n], out=sums[1:])
        return mix((sums[k:] - sums[: n - k + 1]) * inverse[: n - k + 1] + _U(k))

    def bounds(self, n_docs: int) -> np.ndarray:
        """Where the words of each text begin, and their number."""
        return np.searchsorted(self.doc, np.arange(n_docs + 1))


def blocks(column: pa.Array, most: int = BLOCK_BYTES):
    """(first row, data, offsets) of runs of rows with about most bytes at most; a longer text is a run of its own. Nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(column: pa.Array, lower: bool = False):
    """(first row, number of rows, Words) for runs of rows."""
    for at, data, offsets in blocks(column):
        yield at, len(offsets) - 1, Words(data, offsets, lower)
