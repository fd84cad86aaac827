"""Sources of gridded cells and product tables, and the normalisation of what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from isobath.functions import columns as C

#: Names under which the temperature may come, in order of preference.  Fixed values.
ALIASES = ("analysed_sst", "sst", "thetao", "sea_surface_temperature")


def find_variable(df: DataFrame, aliases: tuple[str, ...] = ALIASES) -> str:
    found = next((a for a in aliases if a in df.columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(aliases)} among the columns {', '.join(df.columns)}")
    return found


def is_kelvin(df: DataFrame, variable: str, unit: str | None = None) -> bool:
    """By the unit if it is given, else by the exact median: above 150 Kelvin, from -10 to 60 Celsius.

    Four counts settle it, unless the two middle values lie on different sides of a bound.
    """
    if unit is not None:
        kind = df.sparkSession.range(1).select(C.unit_kind(F.lit(unit)).alias("k")).first()["k"]
        if kind not in ("kelvin", "celsius"):
            raise ValueError(f"{unit!r} is no unit of temperature")
        return kind == "kelvin"
    v = C.finite(F.col(variable))
    n, low, celsius, high = df.agg(F.count(v), F.count_if(v < -10), F.count_if(v.between(-10, 60)), F.count_if(v > 150)).first()
    if n and high > n // 2:  # both middle values are there, so the median is
        return True
    if n and low < (n + 1) // 2 and n // 2 + 1 <= low + celsius:
        return False
    median = df.agg(F.percentile(C.finite(F.col(variable)), 0.5).alias("m")).first()["m"]
    if median is None or not (median > 150 or -10 <= median <= 60):
        raise ValueError("the unit can't be told from the values")
    return median > 150


def normalised(df: DataFrame, *, unit: str | None = None, aliases: tuple[str, ...] = ALIASES) -> DataFrame:
    """``date, lat, lon, value`` in degrees Celsius and canonical longitudes, missing values null."""
    variable = find_variable(df, aliases)
    pick = lambda *names: next(F.col(n) for n in names if n in df.columns)
    value = C.finite(F.col(variable))
    value = C.celsius(value) if is_kelvin(df, variable, unit) else value
    return df.select(F.to_date(pick("date", "time")).alias("date"), pick("lat", "latitude").cast("double").alias("lat"), C.canonical_longitude(pick("lon", "longitude").cast("double")).alias("lon"), value.alias("value"))


def indexed(cells: DataFrame) -> DataFrame:
    """Cells with integer ``row`` and ``col``, from the south and west; axes are small tables."""
    from pyspark.sql import Window

    def axis(coordinate: str, name: str) -> DataFrame:
        return cells.select(coordinate).distinct().select(coordinate, (F.row_number().over(Window.orderBy(coordinate)) - 1).alias(name))

    return cells.drop("row", "col").join(F.broadcast(axis("lat", "row")), "lat").join(F.broadcast(axis("lon", "col")), "lon")  # one row per grid line


def repeated_longitudes(cells: DataFrame) -> DataFrame:
    """Longitudes that fall together once they are canonical, to 12 decimals."""
    return cells.select("lon").distinct().groupBy(F.round(C.canonical_longitude(F.col("lon")), 12).alias("canonical")).count().where("count > 1")


def read_cells(spark: SparkSession, path: str, *, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None, dates: tuple[str, str] | None = None) -> DataFrame:
    """A Parquet cube, filtered by plain ranges so that they prune partitions and row groups."""
    df = spark.read.parquet(path)
    if dates:
        df = df.where(F.col("date").between(*[F.lit(d).cast("date") for d in dates]))
    if lat and lon:
        df = df.where(C.inside_box(F.col("lat"), F.col("lon"), lat, lon))
    return df


def read_live_or_demo(spark: SparkSession, live: str, demo: str) -> DataFrame:
    """The live cube if it can be read and has a finite temperature, else the demo, with ``data_mode``."""
    try:
        df = spark.read.parquet(live)
        if not df.where(C.finite(F.col(find_variable(df))).isNotNull()).isEmpty():
            return df.withColumn("data_mode", F.lit("live"))
    except (AnalysisException, ValueError):
        pass
    return spark.read.parquet(demo).withColumn("data_mode", F.lit("demo"))


def demo_cells(spark: SparkSession, *, rows: int = 21, columns: int = 21, days: int = 10, seed: int = 42) -> DataFrame:
    """A deterministic demonstration cube in Kelvin: a plane in space and time with small noise."""
    base = spark.range(rows * columns * days)
    row, col, day = F.col("id") % rows, F.floor(F.col("id") / rows) % columns, F.floor(F.col("id") / (rows * columns))
    lat, lon = -10.0 + row * 0.5, -90.0 + col * 0.5
    noise = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2001)) - 1000) / 1000.0 * 0.08
    return base.select(F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("date"), lat.alias("lat"), lon.alias("lon"), (273.15 + 25 + 0.12 * (lat + 10) + 0.05 * (lon + 90) + 0.08 * day + noise).alias("sst"))


def describe(cells: DataFrame) -> DataFrame:
    """One row: sizes, bounds, last date and finite count."""
    return cells.agg(F.countDistinct("lat").alias("n_lat"), F.countDistinct("lon").alias("n_lon"), F.countDistinct("date").alias("n_dates"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.max("date").alias("latest"), F.count("value").alias("finite"))


def available_dates(cells: DataFrame) -> DataFrame:
    return cells.select(F.date_format("date", "yyyy-MM-dd").alias("date")).distinct().orderBy("date")


def load_product(spark: SparkSession, path: str, required: list[str], dates: list[str] = [], *, kind: str = "parquet") -> tuple[str, DataFrame | None]:
    """A product and its state: ``available``, ``empty``, ``unavailable`` or ``invalid``."""
    try:
        df = spark.read.parquet(path) if kind == "parquet" else spark.read.option("multiLine", True).json(path)
    except AnalysisException:
        return "unavailable", None
    if set(required) - set(df.columns):
        return "invalid", None
    if dates and df.where(" OR ".join(f"{c} IS NOT NULL AND try_to_date(CAST({c} AS STRING)) IS NULL" for c in dates)).limit(1).count():
        return "invalid", None
    return ("empty" if df.isEmpty() else "available"), df


def load_series(bank: DataFrame | None, metrics: DataFrame | None, metric: str, column: str, scale: float = 1.0) -> DataFrame:
    """A named series from the bank, values of other status nulled, or a scaled column of the metrics table."""
    if bank is not None:
        return bank.where(F.col("metric") == metric).select("date", F.when(F.col("status").isin("valid", "warning"), F.col("value")).alias("value"), "valid_coverage")
    return metrics.select("date", (F.col(column) * scale).alias("value"), (F.col("valid_data_coverage_percent") / 100.0).alias("valid_coverage"))


def is_stale(derived: DataFrame, upstream: DataFrame) -> bool:
    """Whether a product's newest file is older than its input's."""
    newest = [df.select(F.max("_metadata.file_modification_time").alias("t")).first()["t"] for df in (derived, upstream)]
    return newest[0] is None or newest[1] is not None and newest[0] < newest[1]
