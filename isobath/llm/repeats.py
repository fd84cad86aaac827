"""Removal of byte strings that repeat across documents, with a suffix array's bucket refinement.

A byte goes if it lies in a ``depth``-byte string that also starts in a document with a smaller id.

Distribution.  Equal windows have equal anchors (``anchors``), so only positions with one anchor gram
need to be ordered together.  Documents are dealt to shards by hash; grams to parts by theirs.

1. Every shard sends the distinct hashes of its anchors to their parts; a part answers each shard
   with those that two documents have.  A gram costs one entry per shard, however many documents of
   the shard hold it.
2. Shards send the windows around surviving anchors, each distinct context once with its least
   document, to the grams' parts.
3. A part orders the windows of a gram by bucket refinement: initial buckets are the 8-grams of all
   positions; buckets of 16 and 32 bytes are refined by sorting on the bucket of the position that
   many bytes later, reusing the round before, and the windows by two overlapping buckets of 32.
   Windows that are alone in their bucket leave before every round.  Each final bucket's least
   document decides, and the windows that an earlier document has go back to their shards as bits.
4. Shards mark the windows' bytes and join what is left.

Shards and parts exchange packed rows, bounded by ``shard_bytes`` of text; no task sees a group of
copies beyond one entry per shard.  Texts are shuffled once: every round reads the same exchange.

Defined results: null text is empty; texts shorter than ``depth`` stay whole; copies within a
document, or in documents with the same id, don't count; null ids are larger than all others; rows
that repeat an id are judged each for itself; an empty table gives no rows; other columns of the
input aren't returned.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobath.llm.anchors import DEPTH, GRAM, text_anchors
from isobath.llm.common import text_bytes

SHARD_BYTES = 8 << 20
#: Odd numbers whose powers weigh the bytes of a context.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Contexts that are refined in one round.
ROUND = 1 << 15
LAST = np.iinfo(np.int64).max
#: Bytes of a hash that travel; parts are dealt by the others, so all 64 bits tell.
KEY = 6
CONTEXT = np.dtype([("key", "<u8"), ("index", "<u4"), ("document", "<i8"), ("lead", "u1"), ("windows", "u1")])
ANSWER = np.dtype([("index", "<u4"), ("bits", "<u8")])


def compressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def expanded(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def planes(rows: np.ndarray) -> bytes:
    """Rows by byte planes: what is alike in all of them lies together."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes()


def from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def range_sums(data: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit sum of each byte range: every byte times a power of its place in the range.

    Ranges are ordered by their start; some thousands at a time share the sums of the bytes between.
    """
    out = np.empty(len(first), np.uint64)
    for begin in range(0, len(first), 1 << 13):
        a, b = first[begin : begin + (1 << 13)], end[begin : begin + (1 << 13)]
        low = int(a.min())
        piece = data[low : int(b.max())]
        powers = np.full(len(piece) + 1, np.uint64(base))
        powers[0] = 1
        np.cumprod(powers, out=powers)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=total[1:])
        # aligned at the piece's end rather than divided: no inverse is needed for each
        aligned = (total[b - low] - total[a - low]) * powers[len(piece) - (a - low)]
        out[begin : begin + (1 << 13)] = aligned * _inverse_power(base, len(piece))
    return out


def to_keys(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes()


def from_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    return out.view("<u8").reshape(-1)


LOW = np.uint64((1 << 8 * KEY) - 1)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    high = (hashes >> np.uint64(8 * KEY)).astype(np.int64)
    return (high * 40503 + (hashes & np.uint64(0xFFFF)).astype(np.int64)) % parts


class Shard(NamedTuple):
    """Documents of one shard in order of id and text."""

    ids: np.ndarray
    rows: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def shard_of(table: pa.Table) -> Shard:
    table = table.combine_chunks()
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    ids = table.column("id").fill_null(int(LAST)).to_numpy().astype(np.int64)
    data, offsets = text_bytes(texts)
    return Shard(ids, np.arange(len(ids)), data, offsets)


class Windows(NamedTuple):
    """Runs of windows with one surviving anchor, in order of the text."""

    hash: np.ndarray
    first: np.ndarray
    count: np.ndarray
    lead: np.ndarray
    text: np.ndarray


def windows_of(shard: Shard, depth: int, keep: np.ndarray | None) -> Windows:
    """All anchors' windows, or those whose sorted hashes ``keep`` has."""
    found: list[tuple[np.ndarray, ...]] = []
    for a in text_anchors(shard.data, shard.offsets, depth, GRAM):
        chosen = slice(None)
        if keep is not None:
            at = np.minimum(np.searchsorted(keep, a.hash), max(len(keep) - 1, 0))
            chosen = keep[at] == a.hash if len(keep) else np.zeros(len(a.hash), bool)
        first = a.first[chosen]
        found.append((a.hash[chosen], first, a.count[chosen], a.place[chosen] - first, np.searchsorted(shard.offsets, first, "right") - 1))
    if not found:
        none = np.zeros(0, np.int64)
        return Windows(none.astype(np.uint64), none, none, none, none)
    return Windows(*(np.concatenate(x) for x in zip(*found, strict=True)))


def distinct_contexts(shard: Shard, w: Windows, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct context a run that has it, of the least document; and per run its context's number.

    A context is the bytes of a run's windows.  Runs are ordered by anchor, shape and two 64-bit sums
    of their bytes, each byte times a power of its place; those next to each other are one context
    if their bytes are equal.
    """
    if not len(w.first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = [range_sums(shard.data, w.first, w.first + w.count + depth - 1, base) for base in BASES]
    shape = (w.lead.astype(np.uint64) << np.uint64(8)) | w.count.astype(np.uint64)
    mixed = (w.hash ^ shape * np.uint64(0xBF58476D1CE4E5B9)) + sums[0]
    order = np.lexsort((shard.ids[w.text], sums[1], mixed))
    new = np.ones(len(order), bool)
    new[1:] = (mixed[order][1:] != mixed[order][:-1]) | (sums[1][order][1:] != sums[1][order][:-1]) | (shape[order][1:] != shape[order][:-1])
    apart(new, shard.data, w.first[order], w.count[order] + depth - 1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _inverse_power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(pow(base, -1, 1 << 64), n, 1 << 64))


def bytes_of(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The byte ranges one after another."""
    ends = np.cumsum(size)
    index = np.arange(int(ends[-1]) if len(ends) else 0)
    return data[index + np.repeat(first - (ends - size), size)]


def apart(new: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
    """Set ``new`` where the bytes of a range differ from those of the one before.

    ``new`` is set already where their sizes do.
    """
    alike = np.flatnonzero(~new)
    for begin in range(0, len(alike), 1 << 13):
        at = alike[begin : begin + (1 << 13)]
        unlike = bytes_of(data, first[at], size[at]) != bytes_of(data, first[at - 1], size[at])
        new[at] = np.logical_or.reduceat(unlike, np.cumsum(size[at]) - size[at])


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers in order of the keys, and the size of each row's bucket."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.empty(len(order), bool)
    new[:1] = True
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    bucket = np.cumsum(new, dtype=np.int32) - np.int32(1)
    out = np.empty(len(order), np.int32)
    out[order] = bucket
    return out, np.bincount(bucket)[out]


def paired(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def refined(data: np.ndarray, windows: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Bucket of each window (a position in ``data``): equal for equal ``depth`` bytes of one group.

    -1 for windows that are alone.  Positions keep their buckets from round to round.
    """
    out = np.full(len(windows), -1, np.int64)
    alive = np.arange(len(windows))
    if not len(windows):
        return out
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=np.ascontiguousarray(data), strides=(1,))
    bucket = np.zeros(len(data), np.int32)
    size = 8
    while True:
        # the positions whose buckets this round needs: those inside windows that aren't alone yet
        need = np.bincount(windows[alive], minlength=len(data) + depth).astype(np.int32)
        need[depth - size + 1 :] -= need[: len(need) - (depth - size + 1)].copy()
        positions = np.flatnonzero(np.cumsum(need[: len(data)], dtype=np.int32) > 0)
        values, count = ranks(np.asarray(eight[positions]) if size == 8 else paired(bucket[positions], bucket[positions + size // 2]))
        bucket[positions] = values
        single = np.zeros(len(data), bool)
        single[positions] = count == 1
        # a window with a part that occurs once is alone
        alone = np.zeros(len(alive), bool)
        for p in {*range(0, depth - size + 1, size), depth - size}:
            alone |= single[windows[alive] + p]
        alive = alive[~alone]
        if not len(alive) or size * 2 > depth:
            break
        size *= 2
    if len(alive):
        final, _ = ranks(paired(bucket[windows[alive]], bucket[windows[alive] + depth - size]))
        final, count = ranks(paired(final, group[alive]))
        out[alive[count > 1]] = final[count > 1]
    return out


def earlier(contexts: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """Per context, as bits, the windows that a smaller document has too.

    Contexts that several shards sent, and whose bytes are equal, count once, for the least document.
    What is left of a gram is refined together, and decides for all rows of its context; most grams
    have a single context left, which decides at once.
    """
    size = contexts["windows"].astype(np.int64) + depth - 1
    start = np.cumsum(size) - size
    bits = np.zeros(len(contexts), np.uint64)
    if not len(contexts):
        return bits
    sums = [range_sums(data, start, start + size, base) for base in BASES]
    sums = sums[0] ^ (sums[1] << np.uint64(1))
    order = np.lexsort((contexts["document"], sums, contexts["key"]))
    own, sums = contexts[order], sums[order]
    new = np.ones(len(order), bool)
    new[1:] = (own["key"][1:] != own["key"][:-1]) | (sums[1:] != sums[:-1]) | (own["lead"][1:] != own["lead"][:-1]) | (own["windows"][1:] != own["windows"][:-1])
    apart(new, data, start[order], size[order])
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    # a context that a smaller document has too goes whole
    later = own["document"] > own["document"][first][number]
    bits[order[later]] = (np.uint64(1) << own["windows"][later].astype(np.uint64)) - np.uint64(1)
    key = own["key"][first]
    same = np.zeros(len(first), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    chosen = first[same]
    if not len(chosen):
        return bits
    _, group = np.unique(own["key"][chosen], return_inverse=True)
    # grams one after another, some at a time: the memory of a round has a bound
    cuts = [0]
    for at in np.flatnonzero(np.diff(group)) + 1:
        if at - cuts[-1] > ROUND:
            cuts.append(int(at))
    for a, b in zip(cuts, [*cuts[1:], len(chosen)], strict=True):
        part = chosen[a:b]
        count = own["windows"][part].astype(np.int64)
        piece = bytes_of(data, start[order[part]], count + depth - 1)
        begin = np.cumsum(count + depth - 1) - (count + depth - 1)
        owner = np.repeat(np.arange(len(part)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        bucket = refined(piece, begin[owner] + place, group[a:b][owner], depth)
        met = np.flatnonzero(bucket >= 0)
        if len(met):
            least = np.full(int(bucket[met].max()) + 1, LAST)
            document = own["document"][part][owner[met]]
            np.minimum.at(least, bucket[met], document)
            hit = met[least[bucket[met]] < document]
            found = np.zeros(len(part), np.uint64)
            np.bitwise_or.at(found, owner[hit], np.uint64(1) << place[hit].astype(np.uint64))
            bits[order[part]] |= found
    bits[order] |= bits[order[first]][number]
    return bits


def removed_bytes(shard: Shard, w: Windows, chosen: np.ndarray, number: np.ndarray, bits: np.ndarray, depth: int) -> np.ndarray:
    """Whether each byte of the shard goes.  ``bits``: per context the windows that other shards have earlier."""
    starts = np.zeros(len(shard.data) + 1, np.int32)
    if len(w.first):
        own, least = shard.ids[w.text], shard.ids[w.text[chosen]][number]
        whole = np.flatnonzero(own > least)  # the context itself is in an earlier document of the shard
        np.add.at(starts, w.first[whole], 1)
        np.add.at(starts, w.first[whole] + w.count[whole] + depth - 1, -1)
        some = np.flatnonzero((own == least) & (bits[number] != 0))
        for k in range(depth - GRAM + 1):
            hit = some[(bits[number[some]] >> np.uint64(k)) & np.uint64(1) != 0]
            np.add.at(starts, w.first[hit] + k, 1)
            np.add.at(starts, w.first[hit] + k + depth, -1)
    return np.cumsum(starts[:-1], dtype=np.int32) > 0


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are flagged."""
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, texts: bool = False) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``texts``, ``kept`` bytes too."""
    if not GRAM <= depth <= GRAM + 63:
        raise ValueError(f"depth must be between {GRAM} and {GRAM + 63}")
    sized = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards, parts = max(1, sized // shard_bytes), max(1, 2 * sized // shard_bytes)
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = dealt.select(F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard"), "id", "text").groupBy("shard")

    def rows(schema: pa.Schema, *columns: list[object]) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    offer = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("twice", pa.int64()), ("keys", pa.binary())])
    answer = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("indexes", pa.binary())])
    context = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("heads", pa.binary()), ("data", pa.binary())])

    def ordered(table: pa.Table) -> Shard:
        return shard_of(table.sort_by([("id", "ascending"), ("text", "ascending")]))

    def split(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        return [(int(part[order[a]]), order[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def offers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Distinct hashes of the shard's anchors per part: first those that two of its documents have."""
        shard, out = ordered(table), []
        w = windows_of(shard, depth, None)
        document = shard.ids[w.text]
        order = np.lexsort((document, w.hash))
        hashes, document = w.hash[order], document[order]
        start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        twice = np.minimum.reduceat(document, start) != np.maximum.reduceat(document, start) if len(start) else np.zeros(0, bool)
        hashes = hashes[start]
        for part, members in split(part_of(hashes, parts)):
            members = members[np.argsort(~twice[members], kind="stable")]
            out.append((part, key[0].as_py(), int(twice[members].sum()), to_keys(hashes[members])))
        return rows(offer, *zip(*out, strict=True)) if out else offer.empty_table()

    def survivors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """To each shard, those of its hashes that some other document has."""
        owners, twices, keys = (table.column(c).to_pylist() for c in ("shard", "twice", "keys"))
        hashes = [from_keys(k) for k in keys]
        every = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(owners)), [len(h) for h in hashes])
        twice = np.concatenate([np.arange(len(h)) < n for h, n in zip(hashes, twices, strict=True)])
        order = np.argsort(every, kind="stable")
        same = np.zeros(len(every), bool)
        same[1:] = every[order][1:] == every[order][:-1]
        same[:-1] |= same[1:]
        kept = np.zeros(len(every), bool)
        kept[order] = same
        kept |= twice
        out = [(owners[k], key[0].as_py(), to_keys(every[m]), None) for k, m in split(np.where(kept, owner, -2)) if k >= 0]
        return rows(answer, *zip(*out, strict=True)) if out else answer.empty_table()

    def surviving(shard: Shard, answers: pa.Table) -> tuple[Windows, np.ndarray, np.ndarray, np.ndarray]:
        known = {p: np.sort(from_keys(k)) for p, k, i in zip(*(answers.column(c).to_pylist() for c in ("part", "keys", "indexes")), strict=True) if i is None}
        found = [windows_of(shard, depth, None)]
        w = found[0]
        part = part_of(w.hash, parts)
        keep = np.zeros(len(w.hash), bool)
        for p, members in split(part):
            if p in known:
                low = w.hash[members] & LOW
                at = np.minimum(np.searchsorted(known[p], low), len(known[p]) - 1)
                keep[members] = known[p][at] == low
        w = Windows(*(x[keep] for x in w))
        return w, part[keep], *distinct_contexts(shard, w, depth)

    def contexts(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        """The surviving windows' distinct contexts, with the least of the shard's documents that has each."""
        if not table.num_rows or not answers.num_rows:
            return context.empty_table()
        shard, out = ordered(table), []
        w, part, chosen, _ = surviving(shard, answers)
        for p, members in split(part[chosen]):
            runs = chosen[members]
            heads = np.empty(len(runs), CONTEXT)
            heads["key"], heads["index"], heads["document"] = w.hash[runs] & LOW, members, shard.ids[w.text[runs]]
            heads["lead"], heads["windows"] = w.lead[runs], w.count[runs]
            data = bytes_of(shard.data, w.first[runs], w.count[runs] + depth - 1)
            out.append((p, key[0].as_py(), compressed(planes(heads)), compressed(data.tobytes())))
        return rows(context, *zip(*out, strict=True)) if out else context.empty_table()

    def decided(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """To each shard, its contexts' windows that a smaller document has."""
        owners = table.column("shard").to_pylist()
        heads = [from_planes(expanded(x), CONTEXT) for x in table.column("heads").to_pylist()]
        data = np.frombuffer(b"".join(expanded(x) for x in table.column("data").to_pylist()), np.uint8)
        every = np.concatenate(heads)
        bits = earlier(every, data, depth)
        owner = np.repeat(np.arange(len(owners)), [len(h) for h in heads])
        out = []
        for k, members in split(np.where(bits != 0, owner, -2)):
            if k >= 0:
                packed = np.empty(len(members), ANSWER)
                packed["index"], packed["bits"] = every["index"][members], bits[members]
                out.append((owners[k], key[0].as_py(), None, compressed(packed.tobytes())))
        return rows(answer, *zip(*out, strict=True)) if out else answer.empty_table()

    final = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if texts else [])])

    def result(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return final.empty_table()
        shard = ordered(table)
        w, _, chosen, number = surviving(shard, answers)
        bits = np.zeros(len(chosen), np.uint64)
        for packed in answers.column("indexes").to_pylist():
            if packed is not None:
                own = np.frombuffer(expanded(packed), ANSWER)
                bits[own["index"]] = own["bits"]
        gone = removed_bytes(shard, w, chosen, number, bits, depth)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edges = shard.offsets[:-1][shard.offsets[:-1] < len(gone)]
        begins[edges] = gone[edges]
        removed, spans = (per_text(x, shard.offsets) for x in (gone, begins))
        kept = [shard.data[a:b][~gone[a:b]].tobytes() for a, b in zip(shard.offsets[:-1].tolist(), shard.offsets[1:].tolist(), strict=True)]
        ids = pa.array(shard.ids, mask=shard.ids == LAST)
        columns = [ids, np.diff(shard.offsets), removed, spans, [hashlib.sha256(x).hexdigest() for x in kept], *([kept] if texts else [])]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, final, strict=True)], schema=final)

    def spark_schema(schema: pa.Schema) -> str:
        names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
        return ", ".join(f"{f.name} {names[f.type]}" for f in schema)

    kept_hashes = dealt.applyInArrow(offers, spark_schema(offer)).groupBy("part").applyInArrow(survivors, spark_schema(answer))
    sent = dealt.cogroup(kept_hashes.groupBy("shard")).applyInArrow(contexts, spark_schema(context))
    bits = sent.groupBy("part").applyInArrow(decided, spark_schema(answer))
    done = dealt.cogroup(kept_hashes.unionByName(bits).groupBy("shard")).applyInArrow(result, spark_schema(final))
    return done.withColumnRenamed("id", id_col)
