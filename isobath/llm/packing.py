"""Best-fit packing of documents into sequences of several permitted lengths.

Texts are measured in tokens (of a byte-level tokenizer, as in ``token_counts``) and cut into pieces
of at most the largest length, at borders of pre-tokens; only a pre-token that is itself too long is
cut inside, between characters.  Pieces are packed in decreasing length, each into the open
bin that it fills best; where none has room a new bin is opened whose size costs least per token
that it can still expect to hold.  Every bin is at last downsized to the smallest permitted length
that holds its contents.  The joint choice competes with each preferred single size over the same
pieces, and the cheapest of these plans stands.

Costs: a sequence of length c costs ``c * (1 + c / quadratic) + overhead``.

Pieces are dealt by a hash of their row's id and text to shards of about ``shard_rows``, packed
independently; only the shards' last bins lose to a global packing.  Plans don't depend on how the
rows lie, except for rows that repeat both id and text: these are dealt over all shards, so that
they don't gather.

Defined results: null text has length 0; an empty document is one empty piece; very long texts are
cut, never dropped; repeated rows are packed each for itself; an empty table gives no rows; the id
keeps its name and no other input column is returned or looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import arrow_type, cut, decoded, slices, text_rows
from isobath.llm.token_counts import Splitter, splitter_of

CAPACITIES = (2048, 4096, 8192, 16384)
QUADRATIC = 65536.0
OVERHEAD = 256.0
SHARD_ROWS = 5_000
#: Pieces are packed longest first; equal ones in an order that hangs on their rows alone.
ORDER = ["piece_length", "rank", "piece"]


def cost(capacity: int, quadratic: float = QUADRATIC, overhead: float = OVERHEAD) -> float:
    return capacity * (1 + capacity / quadratic) + overhead


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], costs: dict[int, float], preferred: int | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each of the decreasing ``lengths``, and what each bin holds at last.

    ``preferred`` fixes the size of a new bin where the piece fits it; else the least-cost size is
    opened.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rest = int(lengths.sum())
    room: dict[int, list[int]] = {}  # bins by the room they have left
    mask = 0  # of the rooms that occur
    used: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        rest -= n
        above = mask >> n
        if above:
            left = n + (above & -above).bit_length() - 1
            own = room[left]
            k = own.pop()
            if not own:
                mask ^= 1 << left
            at = used[k]
            used[k] += n
            left -= n
        else:
            able = [c for c in capacities if c >= n]
            if preferred is not None and preferred >= n:
                size = preferred
            else:
                size = min(able, key=lambda c: (costs[c] / max(1, min(c, n + rest)), c))
            k, at, left = len(used), 0, size - n
            used.append(n)
        bins[i], offsets[i] = k, at
        own = room.setdefault(left, [])
        if not own:
            mask |= 1 << left
        own.append(k)
    return bins, offsets, used


def downsized(used: np.ndarray, capacities: tuple[int, ...]) -> np.ndarray:
    sizes = np.asarray(capacities)
    return sizes[np.searchsorted(sizes, used)]


def pack_lengths(lengths: np.ndarray, capacities: tuple[int, ...], quadratic: float, overhead: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin size of each of the decreasing ``lengths``, by the cheapest plan."""
    costs = {c: cost(c, quadratic, overhead) for c in capacities}
    best = None
    for preferred in (None, *capacities):
        bins, offsets, used = best_fit(lengths, capacities, costs, preferred)
        sizes = downsized(np.asarray(used, np.int64), capacities)
        total = float(sum(costs[c] * n for c, n in zip(*np.unique(sizes, return_counts=True), strict=True)))
        if best is None or total < best[0]:
            best = total, bins, offsets, sizes[bins]
    return best[1:]


def cut_text(splitter: Splitter, text: str, largest: int) -> list[tuple[int, int, int]]:
    """(begin, end, tokens) of the text's pieces, of ``largest`` tokens at most; offsets in code points."""
    plain, special = splitter(text)
    total = sum(map(splitter.count, plain)) + special
    if total <= largest:
        return [(0, len(text), total)]
    parts: list[tuple[int, int]] = []  # code points and tokens, in order of the text
    step = max(1, largest // 4)  # a character is 4 bytes at most, and a byte one token
    for run, is_special in splitter.runs(text):
        if is_special:
            parts.append((len(run), 1))
            continue
        own = splitter.part(run)
        for x, n in zip(own, map(splitter.count, own), strict=True):
            if n <= largest:
                parts.append((len(x), n))
            else:
                small = [x[i : i + step] for i in range(0, len(x), step)]
                parts.extend((len(y), m) for y, m in zip(small, splitter.pieces(small), strict=True))
    found, begin, end, held = [], 0, 0, 0
    for size, n in parts:
        if held + n > largest:
            found.append((begin, end, held))
            begin, held = end, 0
        end, held = end + size, held + n
    return [*found, (begin, end, held)]


def token_pieces(docs: DataFrame, path: str, largest: int, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """``id``, ``rank`` (a hash of id and text), ``piece``, ``piece_start`` (code points), ``piece_length`` (tokens) and, if wanted, ``text`` of every piece."""
    with open(path, encoding="utf-8") as file:
        known = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = text_rows(docs, id_col, text_col).select("id", F.xxhash64("id", "text").alias("rank"), "text")
    schema = T.StructType([rows.schema["id"], T.StructField("rank", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("piece_start", T.LongType()), T.StructField("piece_length", T.LongType()), *[T.StructField("text", T.StringType())] * texts])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        splitter, shape = splitter_of(known.value), arrow_type(schema)
        for batch in batches:
            for part in slices(batch, 2):
                whole = decoded(part.column(2))
                pieces = [(i, k, a, b, n) for i, t in enumerate(whole) for k, (a, b, n) in enumerate(cut_text(splitter, t, largest))]
                row, piece, start, end, length = zip(*pieces, strict=True)
                columns = [part.column(c).take(pa.array(row)) for c in (0, 1)]
                text = [pa.array([whole[i][a:b] for i, a, b in zip(row, start, end, strict=True)], pa.string())] if texts else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), *text], schema=shape)
        splitter.count.cache_clear()  # the worker may wait beside others that need its memory

    return rows.mapInArrow(every, schema)


def length_pieces(docs: DataFrame, length: Column, largest: int, id_col: str) -> DataFrame:
    """The same without texts, for rows whose ``length`` is known and that may be cut anywhere."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"), F.xxhash64(*docs.columns).alias("rank"))
    pieces = rows.select("id", "rank", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(n - 1) div {largest}")))).alias("piece"), "n")
    return pieces.select("id", "rank", F.col("piece").cast("int"), (F.col("piece") * largest).cast("long").alias("piece_start"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).cast("long").alias("piece_length"))


def dealt(pieces: DataFrame, shard_rows: int) -> DataFrame:
    """The pieces with their ``shard``."""
    shards = max(1, round(pieces.count() / shard_rows))
    again = pieces.groupBy("rank", "piece").count().where("count > 1").select("rank", "piece", F.lit(True).alias("again"))
    copy = F.lit(0).cast("long")
    if not again.isEmpty():
        pieces, copy = pieces.join(again, ["rank", "piece"], "left"), F.when(F.col("again"), F.monotonically_increasing_id()).otherwise(0)
    return pieces.withColumn("shard", F.pmod(F.xxhash64("rank", "piece", copy), F.lit(shards)))


def pack_pieces(pieces: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES, quadratic: float = QUADRATIC, overhead: float = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per piece: ``id``, ``piece``, ``piece_start``, ``piece_length``, ``bin_id``, ``bin_size``, ``bin_offset``."""
    out = T.StructType([pieces.schema["id"], T.StructField("piece", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in ("piece_start", "piece_length", "bin_id", "bin_size", "bin_offset")]])

    def one_shard(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ORDER, ascending=[False, True, True], kind="stable")
        bins, offsets, sizes = pack_lengths(frame["piece_length"].to_numpy(), capacities, quadratic, overhead)
        return frame.assign(bin_id=(int(key[0]) << 32) + bins, bin_size=sizes, bin_offset=offsets)[out.names]

    small = pieces.select("id", "rank", "piece", "piece_start", "piece_length")
    return dealt(small, shard_rows).groupBy("shard").applyInPandas(one_shard, out)


def permitted(capacities: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sorted(set(capacities)))


def pack(docs: DataFrame, length: Column, *, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, **costs: float) -> DataFrame:
    """The pieces of rows of known ``length``, as ``pack_pieces`` gives them, with the id under its name."""
    sizes = permitted(capacities)
    pieces = cut(length_pieces(docs, length, sizes[-1], id_col), "pieces")
    return pack_pieces(pieces, capacities=sizes, **costs).withColumnRenamed("id", id_col)


def pack_texts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, **costs: float) -> DataFrame:
    """The same of texts, in tokens of the tokenizer in ``path``."""
    sizes = permitted(capacities)
    pieces = cut(token_pieces(docs, path, sizes[-1], id_col, text_col, texts=False), "pieces")
    return pack_pieces(pieces, capacities=sizes, **costs).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, quadratic: float = QUADRATIC, overhead: float = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per packed sequence: ``bin_id``, ``bin_size``, ``n_tokens``, ``doc_ids`` and, for each of these, ``pieces``, ``starts``, ``lengths`` and ``texts``, in order."""
    sizes = permitted(capacities)
    pieces = cut(token_pieces(docs, path, sizes[-1], id_col, text_col), "pieces")
    many = lambda name, kind: T.StructField(name, T.ArrayType(kind))
    out = T.StructType([*[T.StructField(x, T.LongType()) for x in ("bin_id", "bin_size", "n_tokens")], many("doc_ids", pieces.schema["id"].dataType), many("pieces", T.IntegerType()), many("starts", T.LongType()), many("lengths", T.LongType()), many("texts", T.StringType())])

    def one_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece_length", "descending"), ("rank", "ascending"), ("piece", "ascending")])
        bins, _, size = pack_lengths(table.column("piece_length").to_numpy(), sizes, quadratic, overhead)
        order = np.argsort(bins, kind="stable")  # within a bin in order of the offsets
        table, bins, size = table.take(pa.array(order)), bins[order], size[order]
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        ends = pa.array(np.append(first, len(bins)), pa.int32())
        lengths = table.column("piece_length").to_numpy()
        shape = arrow_type(out)
        lists = [pa.ListArray.from_arrays(ends, table.column(c).combine_chunks(), type=shape.field(i).type) for i, c in enumerate(("id", "piece", "piece_start", "piece_length", "text"), 3)]
        return pa.Table.from_arrays([pa.array((key[0].as_py() << 32) + bins[first]), pa.array(size[first]), pa.array(np.add.reduceat(lengths, first)), *lists], schema=shape)

    return dealt(pieces, shard_rows).groupBy("shard").applyInArrow(one_shard, out)


def bins_of(packed: DataFrame) -> DataFrame:
    """One row per bin: its size, contents and cost."""
    return packed.groupBy("bin_id").agg(F.max("bin_size").alias("bin_size"), F.sum("piece_length").alias("used"), F.count(F.lit(1)).alias("pieces"))


