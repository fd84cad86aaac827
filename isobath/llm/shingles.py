"""Word shingle hashes of many texts at once, over their UTF-8 bytes.

A word is a run of letters and digits of ASCII, after lower-casing A-Z, or of bytes beyond ASCII.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEED = 20240229


def _byte_table() -> np.ndarray:
    """A random odd 64-bit value per word byte, upper case as lower; 0 for the others."""
    values = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    word = np.zeros(256, bool)
    for begin, end in ((48, 58), (65, 91), (97, 123), (128, 256)):
        word[begin:end] = True
    values[65:91] = values[97:123]
    values[~word] = 0
    return values


BYTES = _byte_table()
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, ``n`` of each at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        base = np.full(size, _ODD)
        base[0] = 1
        inverse = np.full(size, np.uint64(pow(int(_ODD), -1, 1 << 64)))
        inverse[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole value."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the words' offsets per text; ``offsets`` has one more entry than texts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    value = BYTES[data]
    inside = value != 0
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False  # a text's first byte follows no word
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data), bool)
    after[:-1] = inside[1:]
    after[-1] = False
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value * up[: len(data)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a text, and the runs' offsets per text."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    ends = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=ends[1:])
    if len(words) < size:
        return np.zeros(0, np.uint64), ends
    n = len(words) - size + 1
    run = np.zeros(n, np.uint64)
    for k in range(size):
        run = run * _ODD + words[k : k + n]
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(ends[-1]) - ends[text] + offsets[:-1][text]
    return mix(run[at] + np.uint64(size)), ends
