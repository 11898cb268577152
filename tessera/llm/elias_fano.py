"""Elias-Fano sequences in numpy over a memory-mapped buffer, with vectorised search.

A monotone sequence of n values below u keeps the low floor(log2(u/n)) bits of
each value in a packed array and the rest as unary gaps in a bit vector. A
small directory of set bits per 64-bit word answers select by one binary
search in the directory and six halving steps in the word.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_U = np.uint64


def mapped(array: np.ndarray) -> np.ndarray:
    """A read-only copy of the array in a memory-mapped file without a name."""
    if not array.nbytes:
        return array
    with tempfile.TemporaryFile() as f:
        f.write(array.data)
        f.flush()
        return np.frombuffer(mmap.mmap(f.fileno(), array.nbytes, access=mmap.ACCESS_READ), array.dtype)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits one after another in 64-bit words."""
    n = len(low)
    words = np.zeros((n * width + 63) // 64 + 1, _U)
    if not n or not width:
        return words
    at = np.arange(n, dtype=_U) * _U(width)
    word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] = np.bitwise_or.reduceat(low << off, first)
    over = off + _U(width) > _U(64)
    if over.any():  # at most one value spills into each next word
        words[word[over] + 1] |= low[over] >> (_U(64) - off[over])
    return words


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) in each word."""
    word, k, pos = word.copy(), k.copy(), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & _U((1 << width) - 1)).astype(np.int64)
        go = k >= low
        k -= np.where(go, low, 0)
        word = np.where(go, word >> _U(width), word)
        pos += np.where(go, width, 0)
    return pos


class EliasFano:
    """A rising sequence (equal neighbours allowed) of unsigned integers below ``universe``."""

    def __init__(self, values: np.ndarray, universe: int):
        values = np.asarray(values, _U)
        self.n = n = len(values)
        self.width = max(0, (universe // n).bit_length() - 1) if n else 63
        high = (values >> _U(self.width)).astype(np.int64)
        self.low = mapped(_pack(values & _U((1 << self.width) - 1), self.width))
        self.buckets = (universe >> self.width) + 1
        bits = np.zeros(((n + self.buckets) // 64 + 1) * 64, bool)
        bits[high + np.arange(n)] = True
        words = np.packbits(bits, bitorder="little").view(_U)
        self.bits = mapped(words)
        ones = np.bitwise_count(words).astype(np.int64)
        self.ones = mapped(np.r_[0, ones.cumsum()])
        self.zeros = mapped(np.r_[0, (64 - ones).cumsum()])

    def nbytes(self) -> int:
        return self.low.nbytes + self.bits.nbytes + self.ones.nbytes + self.zeros.nbytes

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(_U) * _U(self.width)
        word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
        value = self.low[word] >> off
        over = off + _U(self.width) > _U(64)
        value |= np.where(over, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((_U(64) - off) & _U(63)), _U(0))
        return value & _U((1 << self.width) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the bit vector."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + _select(~self.bits[word], k - self.zeros[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        high = word * 64 + _select(self.bits[word], i - self.ones[word]) - i
        return (high.astype(_U) << _U(self.width)) | self._low_at(i)

    def successor(self, keys: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value not below each key, looked for among indices low to high (exclusive)."""
        keys = np.asarray(keys, _U)
        bucket = np.minimum((keys >> _U(self.width)).astype(np.int64), self.buckets - 1)
        end = self._zero(bucket) - bucket
        begin = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) - bucket + 1, 0)
        if low is not None:
            begin, end = np.clip(begin, low, high), np.clip(end, low, high)
        rest = keys & _U((1 << self.width) - 1)
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            mid = (begin[open_] + end[open_]) // 2
            less = self._low_at(mid) < rest[open_]
            begin[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
            open_ = open_[begin[open_] < end[open_]]
        return begin

    def find(self, keys: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Index of each key, -1 if it is no value."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        at = self.successor(keys, low, high)
        inside = at < (self.n if high is None else high)
        same = inside & (self.get(np.minimum(at, self.n - 1)) == np.asarray(keys, _U))
        return np.where(same, at, -1)
