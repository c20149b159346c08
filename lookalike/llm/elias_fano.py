"""Elias-Fano lists and the n-gram trie made of them (numpy, whole arrays).

A list of n ascending numbers below u is kept as low parts of whole bytes and
a bit vector of high parts in unary, about 2 bits each.
"""

from __future__ import annotations

import numpy as np

WORD_BITS = 40  # of a successor's hash, inside one context
#: A context's place and a successor share 64 bits.
MOST_WORDS = 1 << (64 - WORD_BITS)
CODES = 255
STEP = 6.0 / CODES  # codes 1 to 255 cover probabilities from 1 down to 1e-6

_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
# place of the k-th set bit in a byte
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


def codes(p):
    """A code per probability; 0 for none. Uniform in the logarithm."""
    with np.errstate(divide="ignore"):
        level = np.rint(-np.log10(p) / STEP) + 1
    return np.where(p > 0, np.clip(level, 1, CODES), 0).astype(np.uint8)


def values(code):
    return np.where(code > 0, 10.0 ** (-STEP * (code.astype(np.float64) - 1)), 0.0)


class EliasFano:
    """``low`` (n rows of bytes) and ``high`` (bytes of bits), maybe mapped."""

    def __init__(self, n: int, low, high):
        self.n, self.low, self.high = n, low, high
        self.shift = np.uint64(8 * low.shape[1])
        ones = _COUNT[high].astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = 8 * np.arange(len(high) + 1) - self.ones

    @staticmethod
    def parts(numbers) -> tuple:
        """(low, high) of ascending uint64 ``numbers``."""
        n = len(numbers)
        top = int(numbers[-1]) if n else 0
        width = max(0, -(-(top // max(n, 1)).bit_length() // 8))
        low = numbers.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].copy()
        heads = (numbers >> np.uint64(8 * width)) if width < 8 else np.zeros(n, np.uint64)
        bits = np.zeros(-(-(n + (int(heads[-1]) if n else 0) + 2) // 8) * 8, np.uint8)
        bits[heads.astype(np.int64) + np.arange(n)] = 1
        return low, np.packbits(bits, bitorder="little")

    def _select(self, k, of_ones: bool):
        """Place of the k-th set (or unset) bit, k from 0."""
        byte = np.searchsorted(self.ones if of_ones else self.zeros, k, side="right") - 1
        inside = self.high[byte] if of_ones else ~self.high[byte]
        before = (self.ones if of_ones else self.zeros)[byte]
        return 8 * byte + _SELECT[inside, k - before]

    def _lows(self, i):
        out = np.zeros(len(i), np.uint64)
        for b in range(self.low.shape[1]):
            out |= self.low[i, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def get(self, i):
        heads = (self._select(i, True) - i).astype(np.uint64)
        return (heads << self.shift if self.shift < 64 else np.uint64(0)) | self._lows(i)

    def find(self, x, least=0, most=None):
        """Place of each ``x`` within [least, most), or -1: the run of equal
        heads comes from two selects, the low part from a successor search."""
        if not self.n:
            return np.full(len(x), -1)
        head = x >> self.shift if self.shift < 64 else np.zeros(len(x), np.uint64)
        known = head < np.uint64(self.zeros[-1])
        head = np.where(known, head, np.uint64(0)).astype(np.int64)
        start = np.where(head > 0, self._select(np.maximum(head - 1, 0), False) - head + 1, 0)
        end = np.minimum(self._select(head, False) - head, self.n)
        start, end = np.maximum(start, least), np.minimum(end, self.n if most is None else most)
        mask = np.uint64((1 << int(self.shift)) - 1) if self.shift < 64 else np.uint64(2**64 - 1)
        want, stop = x & mask, end.copy()
        while True:
            todo = np.flatnonzero(start < end)
            if not len(todo):
                break
            middle = (start[todo] + end[todo]) >> 1
            less = self._lows(middle) < want[todo]
            start[todo] = np.where(less, middle + 1, start[todo])
            end[todo] = np.where(less, end[todo], middle)
        found = known & (start < stop)
        place = np.minimum(start, self.n - 1)
        return np.where(found & (self._lows(place) == want), place, -1)


class Trie:
    """Two levels. The first has the words with count, back-off and a monotone
    pointer to their successors; the second has the successors, each as
    context * 2^40 + word, with quantised probabilities."""

    FIELDS = ("words", "counts", "backoffs", "pointers", "successors", "probabilities")

    def __init__(self, levels: dict):
        self.counts, self.backoffs, self.probabilities = (levels[f] for f in ("counts", "backoffs", "probabilities"))
        self.words, self.pointers, self.successors = (
            EliasFano(n, *levels[f])
            for f, n in (("words", len(self.counts)), ("pointers", len(self.counts) + 1), ("successors", len(self.probabilities)))
        )

    @staticmethod
    def levels(words, counts, contexts, successors, seen, discount: float) -> dict:
        """``words`` ascend; (``contexts`` as places in words, ``successors``)
        ascend and occur ``seen`` > 0 times."""
        total = np.bincount(contexts, weights=seen, minlength=len(words))
        kinds = np.bincount(contexts, minlength=len(words))
        with np.errstate(divide="ignore", invalid="ignore"):
            backoff = np.where(total > 0, discount * kinds / total, 1.0)
        pointers = np.concatenate([[0], np.cumsum(kinds)]).astype(np.uint64)
        if len(words) > MOST_WORDS:
            raise ValueError(f"{len(words)} words in a shard; raise spark.sql.shuffle.partitions")
        keys = (contexts.astype(np.uint64) << np.uint64(WORD_BITS)) | successors
        return {
            "words": EliasFano.parts(words),
            "counts": counts,
            "backoffs": codes(backoff),
            "pointers": EliasFano.parts(pointers),
            "successors": EliasFano.parts(keys),
            "probabilities": codes(np.maximum(seen - discount, 0) / total[contexts]) if len(seen) else np.zeros(0, np.uint8),
        }

    def word(self, words):
        """(count, back-off code); 0 and 1, which is certain, for unknown."""
        place = self.words.find(words)
        known = place >= 0
        at = np.where(known, place, 0)
        if not len(self.counts):
            return place, np.zeros(len(words), np.int64), np.ones(len(words), np.uint8)
        return place, np.where(known, self.counts[at], 0), np.where(known, self.backoffs[at], 1).astype(np.uint8)

    def pair(self, place, successors):
        """Probability codes of words after the contexts at ``place``."""
        out = np.zeros(len(place), np.uint8)
        known = np.flatnonzero(place >= 0)
        if len(known) and len(self.probabilities):
            at = place[known]
            low, high = (self.pointers.get(p).astype(np.int64) for p in (at, at + 1))
            key = (at.astype(np.uint64) << np.uint64(WORD_BITS)) | successors[known]
            found = self.successors.find(key, low, high)
            out[known] = np.where(found >= 0, self.probabilities[np.maximum(found, 0)], 0)
        return out
