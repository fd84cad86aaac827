"""Sinks: partitioned cubes, strict JSON and CSV, and bundles that appear all at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinities as null: what JSON can hold."""
    fix = lambda f: F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
    return df.select(*[fix(f) for f in df.schema])


def write_cube(df: DataFrame, path: str, by: str = "date") -> None:
    """Parquet partitioned by date: one day is one directory, its rows in one or few files."""
    df.repartition(by).sortWithinPartitions(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    strict(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """ISO dates, blanks for missing values."""
    fixed = [F.date_format(n, "yyyy-MM-dd").alias(n) if k.startswith(("date", "timestamp")) else F.col(n) for n, k in strict(df).dtypes]
    strict(df).select(*fixed).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    jvm, fs = _file_system(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def publish(frames: dict[str, DataFrame], folder: str) -> None:
    """Write all tables beside ``folder``, read each back, and then put the bundle in its place.

    If any write or check fails, what was there before stays.
    """
    spark = next(iter(frames.values())).sparkSession
    staged, kept = (f"{folder.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "kept"))
    jvm, fs = _file_system(spark, folder)
    path = jvm.org.apache.hadoop.fs.Path
    try:
        for name, df in frames.items():
            df.write.parquet(f"{staged}/{name}")
            again = spark.read.schema(df.schema).parquet(f"{staged}/{name}")
            if [f.name for f in again.schema] != df.columns:
                raise ValueError(f"{name} didn't come back with its columns")
        if fs.exists(path(folder)):
            fs.rename(path(folder), path(kept))
        if not fs.rename(path(staged), path(folder)):
            if fs.exists(path(kept)):
                fs.rename(path(kept), path(folder))
            raise OSError(f"{folder} couldn't be put in place")
        fs.delete(path(kept), True)
    finally:
        fs.delete(path(staged), True)


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest of a table, to tell whether a checkpoint is what it was."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def checkpoint_valid(spark: SparkSession, path: str, expected: dict[str, object]) -> bool:
    """Whether a written checkpoint can be read and has the expected fingerprint."""
    try:
        found = fingerprint(spark.read.parquet(path)).first()
    except Exception as problem:  # noqa: BLE001  unreadable in any way: rebuild it
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER" in str(problem) or "CANNOT_READ" in str(problem):
            return False
        raise
    return found.asDict() == expected


def resumable(spark: SparkSession, years: dict[int, DataFrame], folder: str, manifest: dict[int, dict[str, object]]) -> dict[int, dict[str, object]]:
    """Write each year's checkpoint unless a valid one is there; the manifest of all."""
    out = dict(manifest)
    for year, df in years.items():
        path = f"{folder}/year={year}"
        if year not in out or not checkpoint_valid(spark, path, out[year]):
            df.write.mode("overwrite").parquet(path)
            out[year] = fingerprint(spark.read.parquet(path)).first().asDict()
    return out
