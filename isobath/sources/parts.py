"""Checkpoints by tile and year, and a manifest that tells which of them are what they should be.

A part is sound if its rows have the SHA-256 that the manifest gives, and if it was built under the
contract that is asked for (unit, columns and their types, year, bounds of the tile).  Only parts that aren't are
built again: they are written beside the others, read back, compared with what they were made from,
and then take their places, all others staying untouched.  Digests are taken in two levels, so
no task holds the rows of a part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from isobath.sources import sinks
from isobath.sources.staging import stage

KEYS = ["tile", "year"]
Rectangle = tuple[int, int, int, int]


def tile_of(tiles: list[Rectangle]) -> Column:
    """Number of the tile that a cell lies in: rows and columns from, to (exclusive)."""
    inside = [F.when((F.col("row") >= a) & (F.col("row") < b) & (F.col("col") >= c) & (F.col("col") < d), F.lit(k)) for k, (a, b, c, d) in enumerate(tiles)]
    return F.coalesce(*inside)


def digests(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``keys``, number of ``rows`` and ``digest``: equal if and only if parts hold equal rows, in any order."""
    columns = sorted(c for c in rows.columns if c not in keys)
    one = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    dealt = rows.select(*keys, one.alias("h")).groupBy(*keys, F.substring("h", 1, 3).alias("bucket"))
    level = dealt.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    # at most 4,096 buckets a part
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "")
    return level.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sha2(whole, 256).alias("digest"))


def contract(cells: DataFrame, tiles: list[Rectangle], unit: str) -> Column:
    """Digest of what a part is asked to be."""
    bounds = F.element_at(F.array(*[F.lit(",".join(map(str, t))) for t in tiles]), F.col("tile") + 1)
    fields = ",".join(f"{n}:{t}" for n, t in sorted(cells.dtypes))
    return F.sha2(F.concat_ws("|", F.lit(unit), F.lit(fields), F.col("year").cast("string"), bounds), 256)


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/data")
    except AnalysisException:
        return None


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """``tile, year, rows, digest, contract`` of the parts that are there."""
    try:
        return spark.read.parquet(f"{folder}/manifest/parts")
    except AnalysisException:
        return None


def build(cells: DataFrame, tiles: list[Rectangle], folder: str, *, unit: str = "degree_Celsius", value: str = "value") -> DataFrame:
    """Bring the parts of ``cells`` (``date, row, col`` and values) in ``folder`` up to date; gives the manifest with ``rebuilt``.

    Cells of no tile, and values that are not finite, are refused.
    """
    spark = cells.sparkSession
    placed = cells.withColumn("tile", tile_of(tiles)).withColumn("year", F.year("date"))
    bad = placed.where(F.col("tile").isNull() | F.col("year").isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
    if not bad.isEmpty():
        raise ValueError(f"cells outside all tiles or with values that are not finite, as {bad.first()}")
    wanted = placed.select(*KEYS).distinct().withColumn("contract", contract(cells, tiles, unit))
    known, data = manifest(spark, folder), stored(spark, folder)
    if known is None or data is None or set(data.columns) != set(placed.columns):
        kept = spark.createDataFrame([], "tile int, year int, rows long, digest string, contract string")
    else:
        kept = known.join(digests(data), [*KEYS, "rows", "digest"], "left_semi").join(wanted, [*KEYS, "contract"], "left_semi")
    kept = stage(kept, "kept")
    stale = stage(wanted.join(kept, KEYS, "left_anti"), "stale")
    if not stale.isEmpty():
        fresh = placed.join(F.broadcast(stale.select(*KEYS)), KEYS)  # a row a part: tiles times years
        beside = f"{folder}/beside-{uuid.uuid4().hex}"
        fresh.repartition(*KEYS).write.partitionBy(*KEYS).parquet(beside)
        again = spark.read.schema(fresh.schema).parquet(beside)
        made, meant = digests(again), digests(fresh)
        if not made.exceptAll(meant).union(meant.exceptAll(made)).isEmpty():
            raise OSError("parts came back other than they were written")
        again.repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{folder}/data")
        new = stage(made.join(stale, KEYS).select(*KEYS, "rows", "digest", "contract"), "new")
        sinks.remove(spark, beside)
    else:
        new = kept.limit(0)
    out = stage(kept.withColumn("rebuilt", F.lit(False)).unionByName(new.withColumn("rebuilt", F.lit(True))), "manifest")
    sinks.publish({"parts": out.drop("rebuilt")}, f"{folder}/manifest")
    return out


def assembled(spark: SparkSession, folder: str, *, step: float | None = None) -> DataFrame:
    """The cells of all parts of the manifest; with ``step`` (coordinates ``lat`` and ``lon`` needed), refused if an axis has a wider gap."""
    cells = stored(spark, folder).join(manifest(spark, folder).select(*KEYS), KEYS, "left_semi")
    if step is not None and (wide := axis_gaps(cells, step).first()):
        raise ValueError(f"a gap wider than the resolution: {wide.asDict()}")
    return cells


def axis_gaps(cells: DataFrame, step: float, tolerance: float = 1e-6) -> DataFrame:
    """``axis, low, high``: neighbouring grid lines further apart than the resolution."""
    from pyspark.sql import Window

    lines = cells.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("low")) for c in ("lat", "lon")])).alias("x")).select("x.*").distinct()
    over = Window.partitionBy("axis").orderBy("low")  # grid lines
    return lines.withColumn("high", F.lead("low").over(over)).where(F.col("high") - F.col("low") > step * (1 + tolerance))
