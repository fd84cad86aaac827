import itertools
import math

import numpy as np
import pytest

from isobath.functions import windows as W


def series(n, tied, seed=0):
    rng = np.random.default_rng(seed + n)
    values = rng.integers(0, 8, n).astype(float) if tied else rng.normal(size=n) * 30
    lo = np.sort(rng.integers(0, n, 40))
    return np.cumsum(rng.integers(1, 4, n)).astype(float), values, lo, np.minimum(n, np.maximum.accumulate(lo + rng.integers(1, n + 1, 40)))


@pytest.mark.parametrize(("n", "tied"), itertools.product((1, 2, 3, 17, 64, 65, 300), (False, True)))
def test_order_statistics_of_windows(n, tied):
    _, v, lo, hi = series(n, tied)
    ranks = W.Ranks(v)
    cut = [v[a:b] for a, b in zip(lo, hi, strict=True)]
    for q in (0, 0.1, 0.25, 0.5, 0.9, 1):
        assert ranks.quantile(lo, hi, q) == pytest.approx([np.quantile(x, q) for x in cut], abs=1e-12)
    assert ranks.mad(lo, hi) == pytest.approx([np.median(abs(x - np.median(x))) for x in cut], abs=1e-12)
    for x in (-1e9, 0.0, 3.0, 1e9):
        assert ranks.below(lo, hi, np.full(40, x)).tolist() == [(c < x).sum() for c in cut]
        assert ranks.below(lo, hi, np.full(40, x), "right").tolist() == [(c <= x).sum() for c in cut]
    shares = [np.histogram(x, 10)[0] / len(x) for x in cut]
    assert ranks.entropy(lo, hi) == pytest.approx([-(p[p > 0] * np.log2(p[p > 0])).sum() if x.min() < x.max() else 0 for p, x in zip(shares, cut, strict=True)], abs=1e-12)


@pytest.mark.parametrize(("n", "tied"), itertools.product((1, 2, 40, 250), (False, True)))
def test_pairs_of_windows(n, tied):
    _, v, lo, hi = series(n, tied)
    sign = [sum(np.sign(v[j] - v[a:j]).sum() for j in range(a, b)) for a, b in zip(lo, hi, strict=True)]
    assert W.concordance(W.Ranks(v), v, lo, hi).tolist() == sign
    counts = [np.unique(v[a:b], return_counts=True)[1] for a, b in zip(lo, hi, strict=True)]
    pairs, terms = W.ties(v, lo, hi)
    assert pairs.tolist() == [(c * (c - 1) // 2).sum() for c in counts] and terms.tolist() == [(c * (c - 1) * (2 * c + 5)).sum() for c in counts]
    assert W.descents(v) == sum((v[j] <= v[:j]).sum() for j in range(n))


@pytest.mark.parametrize(("n", "tied"), itertools.product((3, 128, 129, 500), (False, True)))
def test_slopes_by_place(n, tied):
    t, v, *_ = series(n, tied)
    i, j = np.triu_indices(n, 1)
    slopes = np.sort((v[j] - v[i]) / (t[j] - t[i]))
    found = W.Slopes(t, v)
    for k in {0, len(slopes) - 1, len(slopes) // 2, (len(slopes) - 1) // 2, len(slopes) // 40, len(slopes) * 9 // 10}:
        assert found.at(k) == pytest.approx(slopes[k], abs=1e-10)


def test_slopes_of_straight_and_constant_series():
    t = np.arange(300.0)
    assert W.Slopes(t, 3 + 2 * t).at(1000) == pytest.approx(2, abs=1e-10)
    assert W.Slopes(t, np.full(300, 7.5)).at(1000) == pytest.approx(0, abs=1e-10)


def test_counting_grows_little_faster_than_the_series():
    # operations: pairs inside blocks of sqrt(n), and the search takes as many counts for any length
    counts = []
    for n in (500, 4000):
        rng = np.random.default_rng(n)
        s = W.Slopes(np.arange(float(n)), rng.normal(size=n))
        s.at(s.pairs // 2)
        counts.append(len(s.known))
    assert counts[1] <= counts[0] + 8


def test_exact_p_of_kendall():
    for n in (3, 5, 7):
        every = [sum((-1) ** (b < a) for k, a in enumerate(x) for b in x[k + 1 :]) for x in itertools.permutations(range(n))]
        for s in set(every):
            assert W.kendall_p(s, n, 0, 0) == pytest.approx(min(1, 2 * sum(x >= abs(s) for x in every) / len(every)))
    assert W.kendall_p(45, 10, 0, 0) == pytest.approx(2 / math.factorial(10))
    assert W.kendall_p(40 * 39 // 2 - 2, 40, 0, 0) == pytest.approx(2 * 40 / math.factorial(40))
    assert W.kendall_p(100, 40, 0, 0) == pytest.approx(math.erfc(100 / math.sqrt(2 * 40 * 39 * 85 / 18)))
    assert math.isnan(W.kendall_p(0, 3, 3, 3 * 2 * 11))
