"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``2 * HALF`` bits of each other have a third within ``HALF`` of both.  Every
distinct fingerprint emits all its variants within ``HALF`` (itself and, for 1, the 64 with one bit
flipped); variants are shuffled, and the fingerprints that meet at a variant are read off a bit
mask, for a member of variant v is v with one bit flipped.  Members of one variant are pairwise
within the radius, so links to the least of them keep the graph's components without all pairs;
each link is verified.

Copies count once: rows are reduced to distinct fingerprints before anything is emitted, and read
their component back through ``attach``, so no task gathers the rows of a frequent fingerprint.

Text: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``shingle`` words with
repeats, joined by a space (fewer words: all of them; none: fingerprint zero), XXH64 with seed 42.
A bit is set if it is in more than half of the hashes.  Null text is empty.  Defined results: rows
are independent, so repeated rows share a component; null ids are smallest and never name a
component unless all its ids are null; an empty table gives no rows; other columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import attach, cut, shuffle_width, slices, text_bytes, text_rows
from isobath.llm.components import components

SHINGLE = 3
SEED = 42
#: Variants that one task groups.
VARIANTS = 1 << 20


def _spaces() -> np.ndarray:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return space


SPACE = _spaces()


def fingerprint(shingle_hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have; in blocks, so memory is bounded."""
    if not len(shingle_hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(shingle_hashes), 1 << 14):
        block = shingle_hashes[begin : begin + (1 << 14)]
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingle_hashes)).tobytes(), "big")


def text_hashes(data: np.ndarray, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of one lower-cased text, given as UTF-8 bytes."""
    import xxhash

    gap = SPACE[data]
    word = ~gap
    starts = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    # runs of white space become one space, so a shingle is a slice
    keep = word.copy()
    keep[starts[1:] - 1] = True
    keep[: starts[0]] = False
    body = np.where(gap, np.uint8(0x20), data)[keep]
    begins = np.flatnonzero(np.concatenate([[True], body[:-1] == 0x20]) & (body != 0x20))
    ends = np.append(begins[1:] - 1, len(body))
    size = min(shingle, len(begins))
    view, digest = body.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], SEED) for a, b in zip(begins[: len(begins) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``print``, the 64 bits as a signed long, of every row."""
    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("print", T.LongType())])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data, ends = text_bytes(pc.ascii_lower(part.column(1).fill_null("")))
                prints = np.array([fingerprint(text_hashes(data[a:b], shingle)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    return rows.mapInArrow(every, schema)


def meeting(prints: DataFrame, bits: int = 64) -> DataFrame:
    """``variant`` and ``members``, in order, of every variant at which several of the distinct ``print`` values meet.

    Only the lowest ``bits`` bits are flipped: those above tell apart prints that are never to meet.
    A variant has at most ``bits + 1`` members.  Variants are dealt before they are grouped, about
    ``VARIANTS`` to a task: nearly all differ, so grouping them first where they arise saves nothing.
    """
    tasks = max(shuffle_width(prints.sparkSession), prints.count() * (bits + 1) // VARIANTS)
    flips = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("bit")
    one = F.expr(f"CASE WHEN bit < {bits} THEN shiftleft(1L, bit) ELSE 0L END")
    variants = prints.select("print", flips).select(F.col("print").bitwiseXOR(one).alias("variant"), one.alias("one"), (F.col("bit") == bits).alias("self"))
    met = variants.repartition(tasks, "variant").groupBy("variant").agg(F.bit_or("one").alias("mask"), F.bool_or("self").alias("self"))
    met = met.where(F.bit_count("mask") + F.col("self").cast("int") > 1)
    flipped = F.expr(f"transform(filter(sequence(0, {bits - 1}), i -> getbit(mask, i) = 1), i -> variant ^ shiftleft(1L, i))")
    return met.select("variant", F.array_sort(F.when(F.col("self"), F.concat(flipped, F.array("variant"))).otherwise(flipped)).alias("members"))


def stars(met: DataFrame) -> DataFrame:
    """Links ``a`` < ``b`` from the least member of each variant to the others."""
    return met.select(F.col("members")[0].alias("a"), F.explode(F.expr("slice(members, 2, size(members))")).alias("b")).distinct()


def linked(prints: DataFrame) -> DataFrame:
    """Links ``a`` < ``b`` that connect all distinct ``print`` values within two bits of each other."""
    return stars(meeting(prints)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def labelled(rows: DataFrame, distinct: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Per row (``id``, ``print``) its component's least id: ``distinct`` has the ``least`` of each ``print``, ``labels`` those with links."""
    named = distinct.join(labels.withColumnRenamed("node", "print"), "print")
    named = attach(named, ["label"], ["print"], {"component": (F.min("least"), F.min)}).select("print", "component")
    answer = distinct.join(named, "print", "left").select("print", F.coalesce("component", "least").alias("component"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(True).alias("known"))
    # rows and answers meet by fingerprint: an answer is one more row of its key
    asked = rows.select("print", F.lit(None).cast(rows.schema["id"].dataType).alias("component"), "id", F.lit(False).alias("known"))
    met = attach(asked.unionByName(answer).withColumnRenamed("component", "own"), ["print"], ["id"], {"component_id": (F.min("own"), F.min)})
    return met.where("not known").select(F.col("id").alias(id_col), "print", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: id, ``print`` and ``component_id``, the least id that links reach."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = cut(rows.groupBy("print").agg(F.min("id").alias("least")), "distinct")
    return labelled(rows, distinct, components(linked(distinct)), id_col)
