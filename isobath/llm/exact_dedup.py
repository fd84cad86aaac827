"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their first bytes, each part again by the next, until a group is a single
document or its texts have ended: texts that end together after equal bytes are equal, and no
digest takes part in that.  A level's digit is ``widths[k]`` bytes, then the last width again, so
the number of levels follows the logarithm of the longest text that still has company.

At each level rows are pre-aggregated per (group, digit, salt) before groups meet (``attach``), so
no task gathers a group however many copies it has; singles leave after the first level, and only
texts that still share their prefix move on.  Every level is written to the shared folder.

Equality: after lower-casing A-Z only.  Defined results: null counts as empty, and equal empty
texts are a group; of a group the row with the largest id stays (null ids are smallest), and rows
that repeat both id and text of the one that stays are marked as kept with it; an empty table gives
no rows; no other input column is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm.common import attach, cut, slices, text_bytes, text_rows

WIDTHS = (64, 512, 4096, 32768, 262144)


def normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``sha`` (hex SHA-256) and ``rest``, the bytes of the text with A-Z in lower case."""
    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("sha", T.StringType()), T.StructField("rest", T.BinaryType())])

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                text = pc.ascii_lower(part.column(1).fill_null(""))
                data, ends = text_bytes(text)
                view, ends = memoryview(data), ends.tolist()
                sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sha, pa.string()), text.cast(pa.binary())], names=["id", "sha", "rest"])

    return rows.mapInArrow(lower, schema)


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    active = normalised(docs, id_col, text_col).withColumn("branch", F.lit(None).cast("binary"))
    done = []
    for level in range(1 << 31):
        width = widths[min(level, len(widths) - 1)]
        split = active.select("id", "sha", "branch", (F.length("rest") <= width).alias("ended"), F.substring("rest", 1, width).alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        # a group is named after its least member: unlike digits, that doesn't grow with the level
        name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")).cast("binary"), F.lit(":").cast("binary"), F.unhex("sha"))
        met = attach(split, ["branch", "ended", "digit"], ["id"], {"n": (F.count(F.lit(1)), F.sum), "keep": (F.max("id"), F.max), "name": (F.min(name), F.min)})
        over = F.col("ended") | (F.col("n") == 1)
        state = cut(met.select("id", "sha", "n", "keep", F.when(~over, F.col("name")).alias("branch"), F.when(~over, F.col("rest")).alias("rest"), over.alias("over")), f"radix-{level}")
        done.append(state.where("over").select("id", "keep", "n", "sha"))
        active = state.where("not over").select("id", "sha", "rest", "branch")
        if active.isEmpty():
            break
    found = reduce(DataFrame.union, done)
    return found.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
