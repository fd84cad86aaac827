"""Order statistics and trends of many windows of one series in memory, without copying a window.

``Ranks`` answers "k-th smallest of positions lo to hi" and "how many of them are smaller" for all
windows at once: one bit array with prefix counts per level of the ranks (a wavelet matrix), O(log n)
a question.  Median pairwise slopes come from counting inversions: the slopes up to s of a window are
the pairs that values less ``s * t`` have in descending order, O(n log n) a count and no pairs held.
"""

from __future__ import annotations

import math

import numpy as np

#: Quantile of the normal distribution for two-sided bounds of 95 percent.
NORMAL_95 = 1.959963984540054
#: Windows of so many observations or fewer form their pairs at once.
PAIRS = 128
#: Observations up to which Kendall's p is exact where no values are tied.
EXACT = 33


class Ranks:
    """Ranks of a series' values, for windows ``[lo, hi)`` of positions given as arrays."""

    def __init__(self, values: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            ones = (ranks >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~ones)])))
            ranks = np.concatenate([ranks[~ones], ranks[ones]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each window; windows must hold more than k values."""
        lo, hi, k, rank = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            left = k < b - a
            k = np.where(left, k, k - (b - a))
            rank |= np.where(left, 0, 1 << bit)
            lo, hi = np.where(left, a, lo - a + zeros[-1]), np.where(left, b, hi - b + zeros[-1])
        return self.sorted[rank]

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, side: str = "left") -> np.ndarray:
        """How many values of each window are less than ``x`` (``side`` right: or equal)."""
        rank = np.searchsorted(self.sorted, x, side)
        lo, hi, count = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        every = hi - lo
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            up = rank >> bit & 1 == 1
            count += np.where(up, b - a, 0)
            lo, hi = np.where(up, lo - a + zeros[-1], a), np.where(up, hi - b + zeros[-1], b)
        return np.where(rank >= 1 << len(self.levels), every, count)

    def quantile(self, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
        """Linear quantile of each (non-empty) window."""
        at = (hi - lo - 1) * q
        low = np.floor(at).astype(np.int64)
        x, y = self.kth(lo, hi, low), self.kth(lo, hi, np.minimum(low + 1, hi - lo - 1))
        return x + (y - x) * (at - low)

    def _deviation(self, lo: np.ndarray, hi: np.ndarray, center: np.ndarray, smaller: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least distance from ``center``: of two ascending lists, those below it from its place down and the others up."""
        n = hi - lo
        least, most = np.maximum(0, k + 1 - (n - smaller)), np.minimum(k + 1, smaller)
        value = lambda at: self.kth(lo, hi, np.clip(at, 0, n - 1))
        while (least < most).any():  # of the k + 1 nearest, how many lie below
            mid = (least + most) // 2
            # one more from below, unless the last one taken from above is nearer
            more = center - value(smaller - 1 - mid) < value(smaller + k - mid) - center
            open_ = least < most
            least, most = np.where(open_ & more, mid + 1, least), np.where(open_ & ~more, mid, most)
        below = np.where(least > 0, np.abs(value(smaller - least) - center), -np.inf)
        above = np.where(k + 1 - least > 0, np.abs(value(smaller + k - least) - center), -np.inf)
        return np.maximum(below, above)

    def mad(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Median distance from the median of each window."""
        n, center = hi - lo, self.quantile(lo, hi, 0.5)
        smaller = self.below(lo, hi, center)
        return (self._deviation(lo, hi, center, smaller, (n - 1) // 2) + self._deviation(lo, hi, center, smaller, n // 2)) / 2

    def entropy(self, lo: np.ndarray, hi: np.ndarray, bins: int = 10) -> np.ndarray:
        """Shannon entropy in bits over equal bins from the window's least to its greatest value."""
        n = hi - lo
        low, high = self.kth(lo, hi, np.zeros(len(lo), np.int64)), self.kth(lo, hi, n - 1)
        step = (high - low) / bins
        edges = [np.zeros(len(lo), np.int64), *(self.below(lo, hi, low + b * step) for b in range(1, bins)), n]
        share = np.diff(np.stack(edges), axis=0) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = -np.nansum(np.where(share > 0, share * np.log2(share), 0), axis=0)
        return np.where(high > low, bits + 0.0, 0.0)


def concordance(ranks: Ranks, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Kendall's S (rising less falling pairs) of windows whose ends never go back.

    A value that enters adds what it has below it less what it has above it, one that leaves takes
    that of its later values away: each is counted once, whatever the number of windows.
    """
    if not len(lo):
        return np.zeros(0, np.int64)
    first, last = int(lo[0]), int(hi.max(initial=0))
    entering, leaving = np.arange(first, last), np.arange(first, int(lo.max(initial=first)))
    # the windows in which a value first is, and first is no more
    comes, goes = np.searchsorted(hi, entering, side="right"), np.searchsorted(lo, leaving, side="right")
    met_from = np.minimum(np.where(comes > 0, lo[np.maximum(comes - 1, 0)], first), entering)
    sign = lambda a, b, x: ranks.below(a, b, x) - (b - a - ranks.below(a, b, x, "right"))
    gained = np.bincount(comes, sign(met_from, entering, values[entering]), len(lo) + 1)[: len(lo)]
    until = np.maximum(hi[np.minimum(goes, len(hi) - 1)], leaving + 1)
    lost = np.bincount(goes, -sign(leaving + 1, until, values[leaving]), len(lo) + 1)[: len(lo)]
    return np.rint(np.cumsum(gained - lost)).astype(np.int64)


def ties(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the sums of c (c - 1) / 2 and c (c - 1) (2 c + 5) over the counts c of its values."""
    pairs, terms = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    names = np.unique(values, return_inverse=True)[1].tolist()
    count = [0] * (max(names, default=0) + 1)
    if len(count) == len(values) or not len(lo):
        return pairs, terms
    p = t = 0
    first = last = int(lo[0])
    for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        for x in names[last:b]:
            c = count[x]
            p, t = p + c, t + (c + 1) * c * (2 * c + 7) - c * (c - 1) * (2 * c + 5)
            count[x] = c + 1
        last = max(last, b)
        for x in names[first : min(a, last)]:
            c = count[x] - 1
            p, t = p - c, t - (c + 1) * c * (2 * c + 7) + c * (c - 1) * (2 * c + 5)
            count[x] = c
        first = max(first, min(a, last))
        pairs[k], terms[k] = p, t
    return pairs, terms


def inversion_shares(n: int) -> np.ndarray:
    """Share of the orders of n things that have 0, 1, 2 and so on inversions or fewer."""
    share = np.ones(1)
    for m in range(2, n + 1):
        share = np.convolve(share, np.full(m, 1.0 / m))
    return np.cumsum(share)


_SHARES: dict[int, np.ndarray] = {}


def kendall_p(s: int, n: int, tied: int, terms: int) -> float:
    """Two-sided p of Kendall's S: exact for ``EXACT`` untied observations or fewer, or almost no falling (rising) pairs; else normal."""
    pairs = n * (n - 1) // 2
    fewer = (pairs - abs(s)) // 2
    if tied == 0 and (n <= EXACT or fewer <= 1):
        if n <= EXACT:
            share = _SHARES.setdefault(n, inversion_shares(n))[fewer]
        else:
            share = (n if fewer else 1) * math.exp(-math.lgamma(n + 1))
        return min(1.0, 2 * float(share))
    variance = (n * (n - 1) * (2 * n + 5) - terms) / 18
    return math.erfc(abs(s) / math.sqrt(2 * variance)) if variance > 0 else math.nan


def descents(u: np.ndarray) -> int:
    """Pairs i < j with ``u[j] <= u[i]``.

    Places and ranks are both cut into blocks of about sqrt(n): pairs of one block of places, and of one
    block of ranks, are compared, O(n sqrt(n)) in two vector operations; all others are counted
    from the number of values in each block of places and ranks.
    """
    n = len(u)
    width = math.isqrt(max(n - 1, 0)) + 1
    blocks = -(-n // width)
    # of equal values the later counts as smaller; places that fill the last block up are greatest and in order
    place = np.arange(blocks * width)
    place[:n] = n - 1 - np.argsort(u[::-1], kind="stable")
    rank = np.arange(blocks * width)
    rank[place[:n]] = place_order = np.arange(n)
    met = np.bincount(place[:n] // width * blocks + place_order // width, minlength=blocks * blocks).reshape(blocks, blocks)
    higher = np.cumsum(met[:, ::-1], axis=1)[:, ::-1] - met  # of a block of places, those in higher blocks of ranks
    earlier = np.cumsum(higher, axis=0) - higher
    return int((met * earlier).sum()) + _falling(rank.reshape(blocks, width)) + _falling((place // width).reshape(blocks, width))


def _falling(rows: np.ndarray) -> int:
    """Pairs i < j of one row with the greater value first."""
    width = rows.shape[1]
    small = rows.astype(np.int16 if rows.size < 1 << 15 else np.int32)
    return int(np.count_nonzero((small[:, :, None] > small[:, None, :]) & np.triu(np.ones((width, width), bool), 1)))


class Slopes:
    """Pairwise slopes of one window by their place in ascending order."""

    def __init__(self, t: np.ndarray, v: np.ndarray) -> None:
        self.t, self.v, self.n = t, v, len(t)
        self.pairs = self.n * (self.n - 1) // 2
        self.known: list[tuple[float, int]] = []  # slopes with the number of slopes up to them
        if self.n <= PAIRS:
            i, j = np.triu_indices(self.n, 1)
            self.sorted = np.sort((v[j] - v[i]) / (t[j] - t[i]))
        else:
            rng = np.random.default_rng(self.n)
            i, j = rng.integers(0, self.n, (2, 8 * 1024))
            i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
            self.sample = np.sort((v[j] - v[i]) / (t[j] - t[i]))
            self.step, self.scale = float(np.diff(t).min()), float(np.abs(v).max())
            spread = 2 * self.scale / self.step + 1.0
            self.known = [(-spread, 0), (spread, self.pairs)]

    def upto(self, s: float) -> int:
        count = descents(self.v - s * self.t)
        self.known.append((s, count))
        return count

    def following(self, s: float) -> float:
        """The least slope above ``s``: the next two to swap as s grows stand side by side in the order of ``v - s t``."""
        u = self.v - s * self.t
        order = np.lexsort((-self.t, u))
        t, v = self.t[order], self.v[order]
        rising = t[1:] > t[:-1]
        slopes = (v[1:] - v[:-1])[rising] / (t[1:] - t[:-1])[rising]
        return float(slopes[slopes > s].min(initial=math.inf))

    def at(self, k: int) -> float:
        """The slope of place k, from 0."""
        if self.n <= PAIRS:
            return float(self.sorted[k])
        place, width = (k + 0.5) / self.pairs * len(self.sample), 2.5 * math.sqrt(len(self.sample)) / 2
        for probe in (place - width, place + width):
            guess = float(self.sample[min(max(int(probe), 0), len(self.sample) - 1)])
            a, b = self._around(k)
            if a[0] < guess < b[0]:
                self.upto(guess)
        tries = 0
        while True:
            (a, few), (b, many) = self._around(k)
            if many - few <= 4 or b - a <= 4 * self.width(b):
                break
            tries += 1
            share = (k + 0.5 - few) / (many - few)
            if tries % 2:  # a little off the estimate, to the side that is likely to close the other end
                margin = 1.5 / math.sqrt(many - few)
                share = min(max(share + (margin if share < 0.5 else -margin), 0.02), 0.98)
            elif tries % 6 == 0:
                share = 0.5
            guess = a + (b - a) * share
            if not a < guess < b:
                break
            self.upto(guess)
        while True:  # equal slopes are told from the next by a step that rounding can't bridge
            a = self.following(a)
            up = a + self.width(a)
            if few + 1 > k or self.upto(up) > k:
                return a
            few, a = self.known[-1][1], up

    def width(self, s: float) -> float:
        """Slopes closer to ``s`` than this can't be told from it."""
        return 1e-13 * (self.scale + abs(s) * (self.t[-1] - self.t[0])) / self.step

    def _around(self, k: int) -> tuple[tuple[float, int], tuple[float, int]]:
        """The nearest known slopes below place k and at it or above."""
        return max(x for x in self.known if x[1] <= k), min(x for x in self.known if x[1] > k)


def slope_places(n: int, terms: int, z: float) -> tuple[int, int] | None:
    """Places of the confidence bounds of the median slope; ``z``: the normal quantile of the level."""
    variance = (n * (n - 1) * (2 * n + 5) - terms) / 18
    if variance <= 0:
        return None
    pairs, half = n * (n - 1) // 2, z * math.sqrt(variance)
    return max(int(round((pairs - half) / 2)) - 1, 0), min(int(round((pairs + half) / 2)), pairs - 1)
