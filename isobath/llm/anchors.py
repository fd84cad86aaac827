"""Content-defined anchors of all fixed-length byte windows.

Of the q-grams inside a window of ``DEPTH`` bytes the one with the least hash, the leftmost of
equals, is the window's anchor.  It depends on the window's bytes alone, so equal windows have equal
anchors at equal places, and neighbouring windows mostly share theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

DEPTH = 50
GRAM = 16
#: Windows looked at together: few enough for the processor's cache.  Long documents are cut into overlapping blocks.
BLOCK = 1 << 17


class Anchors(NamedTuple):
    """Runs of windows with one anchor: the gram's hash, the first window, how many, and the anchor's place."""

    hash: np.ndarray
    first: np.ndarray
    count: np.ndarray
    place: np.ndarray


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) at every position that has as many."""
    n = len(data) - gram + 1
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=data, strides=(1,))
    x = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        x ^= eight[k : k + n]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def block_anchors(data: np.ndarray, depth: int, gram: int) -> Anchors | None:
    """Anchors of all windows of ``data``, as if it were one text."""
    n = len(data) - depth + 1
    if n <= 0:
        return None
    hashes = gram_hashes(data, gram)
    # half of the hash and the place in one number, whose minimum is the leftmost of the least
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, wanted = 1, depth - gram + 1
    while span < wanted:
        step = min(span, wanted - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return Anchors(hashes[place], starts, np.diff(np.append(starts, n)), place)


def blocks(offsets: np.ndarray, depth: int, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Byte ranges that hold every window of every text once: of whole texts, or of parts of a long one."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
        if end > begin:
            yield int(offsets[begin]), int(offsets[end])
            begin = end
            continue
        for at in range(int(offsets[begin]), max(int(offsets[begin + 1]) - depth + 1, int(offsets[begin]) + 1), most):
            yield at, min(at + most + depth - 1, int(offsets[begin + 1]))
        begin += 1


def text_anchors(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM, most: int = BLOCK) -> Iterator[Anchors]:
    """Anchors of all windows within texts; positions are those in ``data``."""
    for begin, end in blocks(offsets, depth, most):
        found = block_anchors(data[begin:end], depth, gram)
        if found is None:
            continue
        first, count = found.first + begin, found.count
        # windows that would cross the end of a text are none: cut runs at each text's last window
        text = np.searchsorted(offsets, first, "right") - 1
        last = np.minimum(first + count, offsets[text + 1] - depth + 1)
        whole = [Anchors(found.hash, first, last - first, found.place + begin)]
        # a run may go on in the texts after the one where it began
        over = np.flatnonzero(first + count > offsets[text + 1])
        while len(over):
            text = text[over] + 1 if len(whole) == 1 else text + 1
            if len(whole) == 1:
                ends, hashes, places = (first + count)[over], found.hash[over], found.place[over] + begin
            go = (text < len(offsets) - 1) & (offsets[np.minimum(text, len(offsets) - 1)] < ends)
            text, ends, hashes, places = text[go], ends[go], hashes[go], places[go]
            if not len(text):
                break
            start = offsets[text]
            whole.append(Anchors(hashes, start, np.minimum(ends, offsets[text + 1] - depth + 1) - start, places))
            over = text
        joined = Anchors(*(np.concatenate(x) for x in zip(*whole, strict=True)))
        keep = joined.count > 0
        yield Anchors(*(x[keep] for x in joined))
