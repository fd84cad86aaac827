"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by size: an item of n shingles belongs to the class of the least power of two
L >= n.  A document, whatever its length, is searched in windows of 2L shingles every L shingles,
so an item that lies in it is at least a fixed share of one window: with containment 0.8 the
Jaccard similarity of item and window is 0.19 or more (0.36 for n = L), and each of the 64
independent one-row bands meets with that chance; all miss with a chance below 2e-6.  Window minima
are minima of block minima, so every shingle is hashed once per function for all classes.  Each
candidate is then verified: the share of the item's distinct shingles that the whole document holds.

The items' bands travel to the data, in blocks of at most ``block_items`` items and
``block_bytes`` bytes, one pass over the documents per block: a task's memory and a broadcast have
that bound however many items there are.  No document row is ever shuffled, so neither copies nor
passages in every document make a task larger.

Defined results: words as in ``shingles``; null text has no words; an item without words matches
nothing; an item of fewer than five words is one shingle of all its words, looked up as such; rows
are independent, so repeated documents or items give a pair each; very long texts are searched whole;
without documents or without items there are no pairs; the output has the two ids under
their own names, ``n_shared``, ``n_item`` and ``containment``, and no other input column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import slices, text_bytes, text_rows
from isobath.llm.shingles import shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 64


def band_functions(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(bands)
    return rng.integers(0, 2**32, bands, dtype=np.uint32), rng.integers(0, 2**31, bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(shingles: np.ndarray, starts: np.ndarray, bands: int) -> np.ndarray:
    """Least value of each function over each run of shingles that begins at ``starts``."""
    flip, odd = band_functions(bands)
    low = shingles.astype(np.uint32) ^ (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((bands, len(starts)), np.uint32)
    for k in range(bands):
        x = (low ^ flip[k]) * odd[k]
        x ^= x >> np.uint32(15)
        out[k] = np.minimum.reduceat(x * odd[-1 - k], starts) if len(starts) else 0
    return out


class Items(NamedTuple):
    """One block of items: ids, distinct shingles, and sorted band values per size class."""

    ids: list[Any]
    shingles: list[np.ndarray]
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def class_of(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def index_items(rows: list[tuple[Any, str | None]], shingle: int = SHINGLE, bands: int = BANDS) -> Items:
    ids, kept, sizes, brief = [], [], {}, {}
    for item, text in rows:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        words, ends = word_hashes(raw, np.array([0, len(raw)], np.int64))
        if not len(words):
            continue
        size = min(shingle, len(words))
        own = np.unique(shingle_hashes(words, ends, size)[0])
        (sizes.setdefault(class_of(len(own)), []) if size == shingle else brief.setdefault(size, [])).append(len(ids))
        ids.append(item)
        kept.append(own)
    classes = {}
    for size, members in sizes.items():
        every = np.concatenate([kept[i] for i in members])
        starts = np.cumsum([0] + [len(kept[i]) for i in members])[:-1]
        values = minima(every, starts, bands)
        order = np.argsort(values, axis=1, kind="stable")
        seen = np.zeros((bands, 1 << 13), np.uint8)  # 16 bits of each band's values, as a bitmap
        for k in range(bands):
            top = values[k] >> np.uint32(16)
            np.bitwise_or.at(seen[k], top >> 3, np.left_shift(np.uint8(1), (top & 7).astype(np.uint8)))
        classes[size] = (np.take_along_axis(values, order, axis=1), np.asarray(members)[order], seen)
    short = {k: (np.array([kept[i][0] for i in m], np.uint64), np.array(m)) for k, m in brief.items()}
    return Items(ids, kept, classes, short)


def matches(items: Items, data: np.ndarray, offsets: np.ndarray, shingle: int, threshold: float, bands: int) -> Iterator[tuple[int, int, int]]:
    """(text, item, shared shingles) of every verified pair."""
    words, word_ends = word_hashes(data, offsets)
    for size, (values, members) in items.short.items():
        own, ends = shingle_hashes(words, word_ends, size)
        order = np.argsort(values, kind="stable")
        left, right = (np.searchsorted(values[order], own, side) for side in ("left", "right"))
        hit = np.flatnonzero(right > left)
        text = np.searchsorted(ends, hit, "right") - 1
        found = {(t, members[order[j]]) for t, i in zip(text.tolist(), hit.tolist(), strict=True) for j in range(left[i], right[i])}
        yield from ((t, int(i), 1) for t, i in sorted(found))
    if not items.classes:
        return
    own, ends = shingle_hashes(words, word_ends, shingle)
    if not len(own):
        return
    pairs: set[tuple[int, int]] = set()
    size, blocks, low = 0, ends, np.zeros((bands, 0), np.uint32)
    for wanted in sorted(items.classes):
        if not size:  # blocks of the least class, never across texts
            counts = -(-np.diff(ends) // wanted)
            starts = np.repeat(ends[:-1], counts) + wanted * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            low = minima(own, starts, bands)
        else:  # of blocks of the class before
            merge = wanted // size
            had = np.diff(blocks)
            counts = -(-had // merge)
            starts = np.repeat(blocks[:-1], counts) + merge * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            low = np.minimum.reduceat(low, starts, axis=1) if len(starts) else low
        size = wanted
        blocks = np.concatenate([[0], np.cumsum(counts)])
        text = np.repeat(np.arange(len(counts)), counts)
        window = low.copy()
        same = np.flatnonzero(text[:-1] == text[1:])
        window[:, same] = np.minimum(low[:, same], low[:, same + 1])
        values, members, seen = items.classes[wanted]
        for k in range(bands):
            top = window[k] >> np.uint32(16)
            maybe = np.flatnonzero((seen[k][top >> np.uint32(3)] >> (top & np.uint32(7)).astype(np.uint8)) & 1)
            left, right = (np.searchsorted(values[k], window[k][maybe], side) for side in ("left", "right"))
            for w, a, b in zip(*(x[right > left].tolist() for x in (maybe, left, right)), strict=True):
                pairs.update((int(text[w]), int(m)) for m in members[k][a:b])
    last, held = -1, own[:0]
    for t, i in sorted(pairs):
        if t != last:
            last, held = t, np.unique(own[ends[t] : ends[t + 1]])
        wanted_shingles = items.shingles[i]
        at = np.searchsorted(held, wanted_shingles)
        shared = int((held[np.minimum(at, len(held) - 1)] == wanted_shingles).sum())
        if shared >= threshold * len(wanted_shingles) - 1e-9:
            yield t, i, shared


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_items: int, block_bytes: int) -> Iterator[list[tuple[Any, str | None]]]:
    block: list[tuple[Any, str | None]] = []
    size = 0
    for row in items.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        more = len(row[1] or "")
        if block and (len(block) >= block_items or size + more > block_bytes):
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += more
    yield block


def find_contained(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """Pairs of a document and an item of whose distinct shingles it holds ``threshold`` or more."""
    rows = text_rows(docs, id_col, text_col)
    item_type = items.schema[item_col].dataType
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("item", item_type), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("containment", T.DoubleType())])

    def pass_over(block: list[tuple[Any, str | None]]) -> DataFrame:
        known = docs.sparkSession.sparkContext.broadcast(index_items(block, shingle, bands))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from isobath.llm.common import arrow_type

            index, shape = known.value, arrow_type(schema)
            for batch in batches:
                for part in slices(batch, 1):
                    found = list(matches(index, *text_bytes(part.column(1)), shingle, threshold, bands))
                    total = [len(index.shingles[i]) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array([t for t, _, _ in found], pa.int64())),
                        pa.array([index.ids[i] for _, i, _ in found], shape.field(1).type),
                        pa.array([n for _, _, n in found], pa.int64()),
                        pa.array(total, pa.int64()),
                        pa.array([n / m for (_, _, n), m in zip(found, total, strict=True)], pa.float64()),
                    ], schema=shape)

        return rows.mapInArrow(search, schema)

    found = reduce(DataFrame.unionByName, map(pass_over, item_blocks(items, item_col, text_col, block_items, block_bytes)))
    return found.withColumnsRenamed({"id": id_col, "item": item_col})
