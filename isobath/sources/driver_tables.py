"""Daily series and gridded cells over the star-schema tables, standing in for ocean data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date``, ``value``: the mean order price of each day, in units of 997 so that means aren't round; with gaps."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_totalprice")
    return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 997.0).alias("value"))


SERIES_SQL = "series AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 997.0 AS value FROM orders GROUP BY 1)"


def grid_cells(spark: SparkSession, sf_dir: str, rows: int = 12, columns: int = 12, step: float = 1.0) -> DataFrame:
    """``date``, ``row``, ``col``, ``lat``, ``lon``, ``value`` of a grid whose days are the months of the shipments."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_suppkey", "l_partkey", "l_quantity")
    day = F.date_add(F.lit("2000-01-01").cast("date"), ((F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate")).cast("int"))
    keys = [day.alias("date"), (F.col("l_suppkey") % rows).cast("int").alias("row"), (F.col("l_partkey") % columns).cast("int").alias("col")]
    cells = items.groupBy(*keys).agg((F.avg("l_quantity") / 1.0013).alias("value"))
    return cells.select("date", "row", "col", (F.lit(-10.0) + F.col("row") * step).alias("lat"), (F.lit(-90.0) + F.col("col") * step).alias("lon"), "value")


def grid_sql(rows: int = 12, columns: int = 12, step: float = 1.0) -> str:
    return f"""cells AS (
  SELECT date, row, col, -10.0 + row * {step} AS lat, -90.0 + col * {step} AS lon, value FROM (
    SELECT DATE '2000-01-01' + CAST((year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS INTEGER) AS date,
      CAST(l_suppkey % {rows} AS INTEGER) AS row, CAST(l_partkey % {columns} AS INTEGER) AS col, avg(l_quantity) / 1.0013 AS value
    FROM lineitem GROUP BY ALL))"""


def full_grid(cells: DataFrame) -> DataFrame:
    """Every row and column of the grid on every date; cells without data have a null value."""
    axes = cells.select("row", "lat").distinct(), cells.select("col", "lon").distinct()
    every = cells.select("date").distinct().crossJoin(F.broadcast(axes[0])).crossJoin(F.broadcast(axes[1]))
    return every.join(cells.select("date", "row", "col", "value"), ["date", "row", "col"], "left")


FULL_SQL = """full_cells AS (
  SELECT d.date, r.row, c.col, r.lat, c.lon, x.value
  FROM (SELECT DISTINCT date FROM cells) d CROSS JOIN (SELECT DISTINCT row, lat FROM cells) r CROSS JOIN (SELECT DISTINCT col, lon FROM cells) c
  LEFT JOIN cells x ON x.date = d.date AND x.row = r.row AND x.col = c.col)"""
