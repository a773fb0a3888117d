"""Words of whole texts as numpy arrays, for operators that need every word.

Texts come as Arrow string arrays and are handled in groups of some megabytes,
whole texts each, without a Python object per word. Words are runs of bytes other
than the white space bytes 9 to 13 and 32.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def random_numbers(count: int, seed: int) -> np.ndarray:
    """``count`` fixed odd 64-bit numbers."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    return mix(steps + _U(seed)) | _U(1)


@dataclass
class Group:
    """Some whole texts: bytes, text bounds, and the words' bounds and texts."""

    first: int  # place of the first text in its batch
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_bounds: np.ndarray  # words of text i: word_bounds[i] to word_bounds[i + 1]

    def hashes(self, lower: bool, seed: int = 7) -> np.ndarray:
        """A 64-bit hash of each word (a multilinear hash of its bytes, then mixed)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        lengths = self.ends - self.starts
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
        factors = random_numbers(int(lengths.max()), seed)
        values = data[np.repeat(self.starts, lengths) + at].astype(np.uint64) + _U(1)
        sums = np.add.reduceat(values * factors[at], offsets[:-1])
        return mix(sums + lengths.astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.word_bounds))


def _group(first: int, data: np.ndarray, bounds: np.ndarray) -> Group:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    word = ~space
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Group(first, data, bounds, starts, ends, np.searchsorted(starts, bounds))


def groups(texts: pa.Array) -> Iterator[Group]:
    """The texts of an Arrow array, in order; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield _group(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
