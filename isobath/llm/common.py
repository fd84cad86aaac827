"""Pieces that the operators share: tables, the shared folder, salted look-ups and Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.sources.staging import shared_folder

#: Shares into which the rows of one key are dealt before they meet.
SALTS = 64
#: Most bytes of an Arrow batch of texts, unless one text is longer.
BATCH_BYTES = 8 << 20


#: Tables cut inside each open ``scratch``.
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/isobath/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is deleted at the end: by then all results that need it are written."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, in the shared folder; all that it cut for itself is deleted at once, and its shuffles are released."""
    path = fresh_path(spark, name)
    if _open:
        _open[-1].append(path)
    with scratch(spark):
        made = make()
        made.write.parquet(path)
    schema = made.schema
    del made
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that are written: it does so once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt_of(*cols: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def attach(rows: DataFrame, keys: list[str], spread: list[str], aggregates: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """Give every row the aggregates of its key, whatever share of the rows one key holds.

    ``aggregates``: per new column the aggregate of the rows, and the function that merges such
    aggregates (``F.sum``, ``F.min`` and so on).  Rows are first aggregated per (key, salt), the at
    most ``SALTS`` cells of a key then by a window, and each row meets its own cell: no task sees
    more of a key than one salt of it.  ``spread``: columns whose hash deals the rows of a key.
    Null keys are equal to each other.
    """
    names = [f"__key_{i}" for i in range(len(keys))]
    salted = rows.select("*", *[F.struct(F.col(k)).alias(n) for k, n in zip(keys, names, strict=True)], salt_of(*spread).alias("__salt"))
    cells = salted.groupBy(*names, "__salt").agg(*[c.alias(k) for k, (c, _) in aggregates.items()])
    over = Window.partitionBy(*names)
    known = cells.select(*names, "__salt", *[merge(k).over(over).alias(k) for k, (_, merge) in aggregates.items()])
    return salted.join(known.hint("shuffle_hash"), [*names, "__salt"]).drop(*names, "__salt")


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``text`` of every row, in Arrow batches of a few MB where the session has only the default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if docs.sparkSession.conf.get(name) in ("67108864b", "67108864", "64MB", "64m"):
        docs.sparkSession.conf.set(name, str(BATCH_BYTES))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes in column ``text`` and ``rows`` rows at most, or a single row."""
    column = batch.column(text)
    if not len(column):
        return
    ends = text_offsets(column)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), begin + rows, len(column))
        yield batch.slice(begin, end - begin)
        begin = end


def text_offsets(column: pa.Array) -> np.ndarray:
    """Start offsets of the values in the column's data, and the end of the last; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values' UTF-8 bytes in one array, and the offsets of each (one more than values)."""
    ends = text_offsets(column)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    if column.null_count:  # a null may have bytes below it
        null = np.asarray(column.is_null())
        if (np.diff(ends)[null] > 0).any():
            return text_bytes(column.fill_null("" if pa.types.is_string(column.type) else b""))
    return data, ends - ends[0]


def decoded(column: pa.Array) -> list[str]:
    """Texts of a string column; null is empty, bytes that are not UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def decoded_sets(column: pa.Array) -> list[np.ndarray]:
    """Arrays of 64-bit numbers from a binary column."""
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def arrow_type(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
