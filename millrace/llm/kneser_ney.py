"""Modified Kneser-Ney character model of order 3 in sorted hash arrays.

Characters are folded to ``SYMBOLS`` symbols: ASCII and the scripts up to U+06FF (Latin, Greek, Cyrillic, Hebrew, Arabic) as
they are but for digits and white space, all others hashed into the rest.  So there are at most SYMBOLS ** 2 bigrams; ``quality.count`` bounds how
many trigrams a model holds itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._text import mix

SYMBOLS, BITS = 2048, 11
SPACE, DIGIT, CONTROL = 1, 2, 3
#: The first code point that is hashed; symbols of those before it begin at FIRST.
HASHED, FIRST = 0x700, 4
_fold: np.ndarray | None = None


def fold(points: np.ndarray) -> np.ndarray:
    """Symbols of code points."""
    global _fold
    if _fold is None:
        cp = np.arange(0x110000, dtype=np.uint64)
        table = np.empty(0x110000, np.uint16)
        table[:HASHED] = FIRST + np.arange(HASHED)
        rest = SYMBOLS - FIRST - HASHED
        table[HASHED:] = FIRST + HASHED + mix(cp[HASHED:]) % np.uint64(rest)
        table[:32], table[127:160] = CONTROL, CONTROL
        table[48:58] = DIGIT
        table[[9, 10, 11, 12, 13, 32]] = SPACE
        _fold = table
    return _fold[points]


def trigrams(symbols: np.ndarray) -> np.ndarray:
    """Keys of the trigrams that end at each symbol; before the first stand two spaces."""
    s = np.concatenate([[SPACE, SPACE], symbols]).astype(np.int64)
    return s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:]


def _sizes(counts: np.ndarray) -> list[int]:
    """How many have the counts 1 to 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _discounts(sizes: list[int]) -> tuple[float, float, float]:
    n = [max(1, k) for k in sizes]
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(0.05, k - (k + 1) * y * n[k] / n[k - 1]), k * 0.95) for k in (1, 2, 3))


def _hash(keys: np.ndarray, order: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) << np.uint64(4) | np.uint64(order))


@dataclass
class Sums:
    """What a model needs of all trigrams."""

    sizes: list[int]  # how many have the counts 1 to 4
    two: np.ndarray  # their last two symbols, sorted
    before: np.ndarray  # and how many different symbols stand before these
    contexts: np.ndarray  # their first two symbols, sorted
    total: np.ndarray  # and the sums of their counts
    few: tuple[np.ndarray, np.ndarray, np.ndarray]  # and how many have the counts 1, 2, and more

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Sums:
        two, before = np.unique(keys & (1 << 2 * BITS) - 1, return_counts=True)
        contexts, at = np.unique(keys >> BITS, return_inverse=True)
        few = tuple(np.bincount(at, np.minimum(counts, 3) == k, len(contexts)) for k in (1, 2, 3))
        return cls(_sizes(counts), two, before, contexts, np.bincount(at, counts, len(contexts)), few)


class Model:
    """Each order: hashes of its grams, sorted, and their probabilities; hashes of contexts, sorted, their weights and sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sums: Sums | None = None):
        """All trigrams; or some, of which those not seen count 0, with the sums of all: then the others' probabilities,
        which ``trigrams`` gives, stand elsewhere, and here they are as if not seen."""
        order = np.argsort(keys, kind="stable")
        tri, c3 = keys[order].astype(np.int64), counts[order].astype(np.float64)
        sums = sums or Sums.of(tri, c3)
        c2 = sums.before.astype(float)
        uni, c1 = np.unique(sums.two & (1 << BITS) - 1, return_counts=True)
        self.orders = []
        below = np.full(SYMBOLS, 1 / SYMBOLS)
        for n, (k, c) in enumerate(((uni, c1.astype(float)), (sums.two, c2)), 1):
            d = _discounts(_sizes(c)) if len(c) else (0.5, 0.5, 0.5)
            off = np.choose(np.minimum(c, 3).astype(int) - 1, d) if len(c) else c
            context = k >> BITS
            own, at = np.unique(context, return_inverse=True)
            total, left = np.bincount(at, c, len(own)), np.bincount(at, off, len(own))
            weight = left / np.maximum(total, 1e-9)
            lower = below[k & SYMBOLS - 1] if n == 1 else self._lookup(n - 1, k & (1 << BITS * (n - 1)) - 1)
            p = (c - off) / total[at] + weight[at] * lower if len(c) else c
            self.orders.append((*self._sorted(k, p, n), *self._sorted(own, weight, n + 8)))
        self.discounts = _discounts(sums.sizes) if len(sums.two) else (0.5, 0.5, 0.5)
        left = sum(d * k for d, k in zip(self.discounts, sums.few, strict=True))
        contexts, weight = self._sorted(sums.contexts, left / np.maximum(sums.total, 1e-9), 11)
        self.totals = self._sorted(sums.contexts, sums.total, 11)[1]
        self.orders.append((np.zeros(0, np.uint64), np.zeros(0), contexts, weight))
        self.orders[2] = (*self._sorted(tri, self.trigrams(tri, c3), 3), contexts, weight)

    def trigrams(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probabilities of the last symbols of trigrams seen so often, 0 times too."""
        _, _, contexts, weights = self.orders[2]
        h = _hash(keys >> BITS, 11)
        weight, known = self._find(contexts, weights, h)
        total, _ = self._find(contexts, self.totals, h)
        c = counts.astype(np.float64)
        off = np.array([0.0, *self.discounts])[np.minimum(counts, 3).astype(int)]
        return (c - off) / np.maximum(total, 1e-9) + np.where(known, weight, 1.0) * self._lookup(2, keys & (1 << 2 * BITS) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether trigrams' probabilities stand here."""
        own, of = np.unique(keys, return_inverse=True)
        return self._find(self.orders[2][0], self.orders[2][1], _hash(own, 3))[1][of]

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        h = _hash(keys, order)
        at = np.argsort(h, kind="stable")
        return h[at], values[at].astype(np.float64)

    @staticmethod
    def _find(h: np.ndarray, values: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(h):
            return np.zeros(len(want)), np.zeros(len(want), bool)
        at = np.minimum(np.searchsorted(h, want), len(h) - 1)
        hit = h[at] == want
        return np.where(hit, values[at], 0.0), hit

    def _lookup(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Probabilities of the last symbols of n-grams; unseen grams back off."""
        grams, p, contexts, weights = self.orders[n - 1]
        found, hit = self._find(grams, p, _hash(keys, n))
        if hit.all():
            return found
        rest = keys[~hit]
        lower = np.full(len(rest), 1 / SYMBOLS) if n == 1 else self._lookup(n - 1, rest & (1 << BITS * (n - 1)) - 1)
        weight, known = self._find(contexts, weights, _hash(rest >> BITS, n + 8))
        found[~hit] = np.where(known, weight, 1.0) * lower
        return found

    def bits(self, keys: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Of trigrams; counts are those of trigrams that don't stand here."""
        return -np.log2(np.maximum(self._lookup(3, keys) if counts is None else self.trigrams(keys, counts), 1e-12))


class Scorer:
    """Bits of trigrams; the ones met last are kept in a table by hash, the others searched for."""

    SLOTS = 20

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.full(1 << self.SLOTS, -1, np.int64)
        self.table = np.zeros(1 << self.SLOTS, np.float32)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        got = self.table[slot]
        lost = np.flatnonzero(self.keys[slot] != keys)
        if len(lost):
            new, of = np.unique(keys[lost], return_inverse=True)
            bits = self.model.bits(new).astype(np.float32)
            got[lost] = bits[of]
            self.keys[slot[lost]], self.table[slot[lost]] = keys[lost], bits[of]
        return got
