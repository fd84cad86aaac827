"""Queries of sources, sinks, gates, thresholds, axes, regions, and selections over the products."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.functions import columns as C
from isobath.operators import assembly, climatology, daily, events, overview, patches, quality, regional, rules, tracks
from isobath.plans import daily as daily_plans
from isobath.plans import spatial as spatial_plans
from isobath.plans.common import CLIMATOLOGY, report, rounded
from isobath.plans.features import _BOX_SQL, BOXES
from isobath.sources import cells as cell_sources
from isobath.sources import netcdf, parts, sinks
from isobath.sources.driver_tables import FULL_SQL, SERIES_SQL, daily_series, full_grid, grid_cells, grid_sql
from isobath.sources.staging import shared_folder, stage
from isobath.streaming import daily as stream_daily

GRID = grid_sql()
DAY = "2000-04-20"
_CELL = "CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col"
_SQL = {name: sql for plan in (daily_plans, spatial_plans) for name, (_, sql) in plan.QUERIES.items()}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/isobath/{name}-{uuid.uuid4().hex}"


def _foreign(cells: DataFrame) -> DataFrame:
    """Cells as another source names them: in Kelvin, east of Greenwich, with a missing value that is NaN."""
    value = F.when(F.col("row") == F.col("col"), float("nan")).otherwise(F.col("value") + 273.15)
    return cells.select(F.col("date").cast("timestamp").alias("time"), F.col("lat").alias("latitude"), (F.col("lon") + 360.0).alias("longitude"), value.alias("analysed_sst"))


def normalised_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign cube written, read by dates, normalised and indexed."""
    path = _folder(spark, "cube")
    sinks.write_cube(_foreign(grid_cells(spark, sf_dir)).withColumn("date", F.to_date("time")), path)
    cube = cell_sources.read_cells(spark, path, dates=("2000-02-01", "2000-04-01"))
    return report(cell_sources.indexed(cell_sources.normalised(cube)))


NORMALISED_CELLS = rounded(f"WITH {GRID} SELECT date, lat, lon, CASE WHEN row <> col THEN value END AS value, dense_rank() OVER (ORDER BY lat) - 1 AS row, dense_rank() OVER (ORDER BY lon) - 1 AS col FROM cells WHERE date BETWEEN DATE '2000-02-01' AND DATE '2000-04-01'", "lat, lon, value", "date, row, col")


def netcdf_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube in Kelvin written as NetCDF, its months of one spring read back, normalised and indexed."""
    path = _folder(spark, "netcdf")
    cells = full_grid(grid_cells(spark, sf_dir)).select("date", F.col("lat"), (F.col("lon") + 360.0).alias("lon"), (F.col("value") + 273.15).alias("analysed_sst"))
    netcdf.write_netcdf(cells, path, units="kelvin")
    back = netcdf.read_netcdf(spark, path, dates=("2000-02-01", "2000-04-01"))
    return report(cell_sources.indexed(cell_sources.normalised(back)))


NETCDF_CUBE = rounded(f"WITH {GRID}, {FULL_SQL} SELECT date, lat, lon, value, dense_rank() OVER (ORDER BY lat) - 1 AS row, dense_rank() OVER (ORDER BY lon) - 1 AS col FROM full_cells WHERE date BETWEEN DATE '2000-02-01' AND DATE '2000-04-01'", "lat, lon, value", "date, row, col")


def netcdf_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of one date of a NetCDF cube, of its last month."""
    path = _folder(spark, "netcdf")
    cells = full_grid(grid_cells(spark, sf_dir)).select("date", "lat", "lon", "value")
    netcdf.write_netcdf(cells, path)
    last = cells.agg(F.max("date").cast("string").alias("d")).first()["d"]
    return report(netcdf.read_netcdf_date(spark, path, last, ("value",)))


NETCDF_DAY = rounded(f"WITH {GRID}, {FULL_SQL} SELECT date, lat, lon, value FROM full_cells WHERE date = (SELECT max(date) FROM cells)", "lat, lon, value", "date")


def live_or_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by mode where the live cube is there, and where it holds no finite value."""
    cells = grid_cells(spark, sf_dir).withColumnRenamed("value", "sst")
    paths = {name: _folder(spark, name) for name in ("live", "void", "demo")}
    cells.write.parquet(paths["live"])
    cells.withColumn("sst", F.lit(None).cast("double")).write.parquet(paths["void"])
    cells.where("row < 3").write.parquet(paths["demo"])
    found = [cell_sources.read_live_or_demo(spark, paths[n], paths["demo"]).withColumn("asked", F.lit(n)) for n in ("live", "void")]
    return found[0].unionByName(found[1]).groupBy("asked", "data_mode").agg(F.count(F.lit(1)).alias("n"))


LIVE_OR_DEMO = f"WITH {GRID} SELECT 'live' AS asked, 'live' AS data_mode, count(*) AS n FROM cells UNION ALL SELECT 'void', 'demo', count(*) FROM cells WHERE row < 3"


def available_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_sources.available_dates(grid_cells(spark, sf_dir))


AVAILABLE_DATES = f"WITH {GRID} SELECT DISTINCT strftime(date, '%Y-%m-%d') AS date FROM cells"


def unit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of unit of spellings by nation key."""
    names = F.array(*[F.lit(x) for x in (" Celsius", "degK", "1", "psu", "degrees_celsius")])
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.get(names, (F.col("n_nationkey") % 5).cast("int")).alias("unit"))
    return report(rows.select("n_nationkey", C.unit_kind(F.col("unit")).alias("kind")))


UNIT_NAMES = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_nationkey % 5 WHEN 1 THEN 'kelvin' WHEN 2 THEN 'dimensionless' WHEN 3 THEN NULL ELSE 'celsius' END AS kind FROM nation"


def product_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of products that are there, empty, without a column, and absent."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    none = _folder(spark, "none")
    orders.limit(0).write.parquet(none)
    specs = {"there": (f"{sf_dir}/orders.parquet", ["o_orderkey"]), "empty": (none, ["o_orderkey"]), "short": (none, ["o_missing"]), "absent": (f"{none}-not", [])}
    found = assembly.load_products(spark, specs)
    return spark.createDataFrame([(name, state) for name, (state, _) in found.items()], "product string, state string")


PRODUCT_STATES = "SELECT * FROM (VALUES ('there', 'available'), ('empty', 'empty'), ('short', 'invalid'), ('absent', 'unavailable')) AS t(product, state)"


def published_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of two tables that replaces an older one, read back."""
    folder = _folder(spark, "bundle")
    series = daily_series(spark, sf_dir)
    sinks.publish({"series": series.limit(0), "other": series}, folder)
    sinks.publish({"series": series, "other": series.where("value > 150")}, folder)
    read = [spark.read.parquet(f"{folder}/{n}").withColumn("part", F.lit(n)) for n in ("series", "other")]
    return report(read[0].unionByName(read[1]))


PUBLISHED_BUNDLE = rounded(f"WITH {SERIES_SQL} SELECT *, 'series' AS part FROM series UNION ALL SELECT *, 'other' FROM series WHERE value > 150", "value", "date, part")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written as strict JSON and read back; NaN comes back as null."""
    path = _folder(spark, "json")
    cells = grid_cells(spark, sf_dir).select("date", "row", "col", F.when(F.col("row") == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    sinks.write_json(cells, path)
    return report(spark.read.schema(cells.schema).json(path))


JSON_ROUND_TRIP = rounded(f"WITH {GRID} SELECT date, row, col, CASE WHEN row <> 0 THEN value END AS value FROM cells", "value", f"date, {_CELL}")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    cells = grid_cells(spark, sf_dir).select("date", "row", "col", F.when(F.col("row") == 0, None).otherwise(F.col("value")).alias("value"))
    sinks.write_csv(cells, path)
    return report(spark.read.schema(cells.schema).option("header", True).csv(path))


CSV_ROUND_TRIP = JSON_ROUND_TRIP


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of counts as strict JSON text."""
    counts = grid_cells(spark, sf_dir).groupBy("date").agg(F.count("value").alias("n"), F.lit(float("nan")).alias("gap"))
    return assembly.json_records(counts)


JSON_LINES = f"""WITH {GRID} SELECT '{{"date":"' || strftime(date, '%Y-%m-%d') || '","n":' || count(value) || ',"gap":null}}' AS json FROM cells GROUP BY date"""


def resumed_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The climatology built from yearly checkpoints, a second time from those that are there."""
    cells, folder = grid_cells(spark, sf_dir, 6, 6).select("date", "row", "col", "value"), _folder(spark, "years")
    _, manifest = assembly.build_climatology(cells, folder)
    return report(assembly.build_climatology(cells, folder, manifest)[0].select("doy", "row", "col", "n", "clim_mean", "clim_p90"))


RESUMED_CLIMATOLOGY = rounded(f"WITH {grid_sql(6, 6)}, {CLIMATOLOGY} SELECT * FROM clim", "clim_mean, clim_p90", f"n, CAST(doy AS BIGINT) AS doy, {_CELL}")


def rebuilt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints by tile and year, after one of them was spoiled and all were brought up to date."""
    folder, tiles = _folder(spark, "parts"), climatology.tiles(6, 6, 9)
    month = F.add_months(F.lit("1990-01-01").cast("date"), F.datediff("date", F.lit("2000-01-01")))
    cells = stage(grid_cells(spark, sf_dir, 6, 6).select(month.alias("date"), "row", "col", "value"), "months")
    parts.build(cells, tiles, folder)
    spoiled = stage(parts.stored(spark, folder).where("tile = 2 AND year = 1995").withColumn("value", F.col("value") + 1), "spoiled")
    spoiled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts.KEYS).parquet(f"{folder}/data")
    state = parts.build(cells, tiles, folder)
    totals = parts.assembled(spark, folder).groupBy(*parts.KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return report(state.select(*parts.KEYS, "rows", "rebuilt").join(totals, parts.KEYS))


REBUILT_PARTS = rounded(
    f"WITH {grid_sql(6, 6)}, m AS (SELECT CAST(DATE '1990-01-01' + to_months(CAST(date - DATE '2000-01-01' AS INTEGER)) AS DATE) AS date, row // 3 * 2 + col // 3 AS tile, value FROM cells) SELECT tile, year(date) AS year, count(*) AS rows, tile = 2 AND year(date) = 1995 AS rebuilt, count(*) AS n, sum(value) AS total FROM m GROUP BY ALL",
    "total",
    "CAST(tile AS BIGINT) AS tile, CAST(year AS BIGINT) AS year, rows, rebuilt, n",
)


def streamed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days with a mean value above 50 per event type, given out by a stream over the events."""
    path, notes = _folder(spark, "runs"), _folder(spark, "runs-notes")
    source = f"{sf_dir}/events.parquet"
    # a stream takes a pattern for a file, but not its plain path
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source[:-1]}[t]")
    runs = stream_daily.settled_runs(events.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "value"), 50.0)
    runs.writeStream.format("parquet").option("path", path).option("checkpointLocation", notes).trigger(availableNow=True).start().awaitTermination()
    return report(spark.read.schema(runs.schema).parquet(path))


STREAMED_RUNS = rounded(
    """WITH days AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY ALL),
o AS (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) AS day FROM events),
g AS (SELECT series, date, mean, date - CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER) AS island FROM days, o WHERE date < day AND mean > 50),
r AS (SELECT series, min(date) AS start, max(date) AS "end", count(*) AS days, max(mean) AS maximum FROM g GROUP BY series, island)
SELECT r.* FROM r, o WHERE r."end" + 1 < day""",
    "maximum",
    'series, start, "end", days',
)


#: Checks of the star schema: some rows break most of them.
RULES = (
    rules.Rule("price in range", "orders", "range", ("o_totalprice",), {"low": 2000.0, "high": 300000.0}, "warning"),
    rules.Rule("status known", "orders", "among", ("o_orderstatus",), {"values": ["O", "F"]}),
    rules.Rule("priority given", "orders", "required", ("o_orderpriority",)),
    rules.Rule("customer known", "orders", "reference", ("o_custkey",), {"to": "customer", "columns": ("c_custkey",)}),
    rules.Rule("one order a customer", "orders", "unique", ("o_custkey",), severity="warning"),
    rules.Rule("discount at most tax", "lineitem", "order", ("l_discount", "l_tax"), severity="warning"),
    rules.Rule("not returned", "lineitem", "matches", ("l_returnflag",), {"pattern": "^[AN]$"}),
    rules.Rule("quantity by discount", "lineitem", "holds", ("l_quantity",), {"condition": "l_quantity < 49 OR l_discount > 0.02"}),
    rules.Rule("order known", "lineitem", "reference", ("l_orderkey",), {"to": "orders", "columns": ("o_orderkey",)}),
)


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of orders and line items that break the rules."""
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "customer")}
    return rules.violations(tables, RULES, {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey"})


RULE_VIOLATIONS = """SELECT 'price in range' AS rule, 'warning' AS severity, 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS key, 'o_totalprice=' || CAST(o_totalprice AS VARCHAR) AS detail FROM orders WHERE o_totalprice NOT BETWEEN 2000 AND 300000
UNION ALL SELECT 'status known', 'error', 'orders', CAST(o_orderkey AS VARCHAR), 'o_orderstatus=' || o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT 'priority given', 'error', 'orders', CAST(o_orderkey AS VARCHAR), 'o_orderpriority=' || coalesce(o_orderpriority, 'null') FROM orders WHERE coalesce(trim(o_orderpriority), '') = ''
UNION ALL SELECT 'customer known', 'error', 'orders', CAST(o_orderkey AS VARCHAR), 'o_custkey=' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'one order a customer', 'warning', 'orders', CAST(min(o_orderkey) AS VARCHAR), 'o_custkey=' || o_custkey || ': ' || count(*) || ' rows' FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'discount at most tax', 'warning', 'lineitem', CAST(l_orderkey AS VARCHAR), 'l_discount=' || CAST(l_discount AS VARCHAR) || ', l_tax=' || CAST(l_tax AS VARCHAR) FROM lineitem WHERE l_discount > l_tax
UNION ALL SELECT 'not returned', 'error', 'lineitem', CAST(l_orderkey AS VARCHAR), 'l_returnflag=' || l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT 'quantity by discount', 'error', 'lineitem', CAST(l_orderkey AS VARCHAR), 'l_quantity=' || CAST(l_quantity AS VARCHAR) FROM lineitem WHERE NOT (l_quantity < 49 OR l_discount > 0.02)
UNION ALL SELECT 'order known', 'error', 'lineitem', CAST(l_orderkey AS VARCHAR), 'l_orderkey=' || l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""


def rule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(rules.verdict(rule_violations(spark, sf_dir), RULES))


RULE_VERDICT = f"""WITH v AS ({RULE_VIOLATIONS}) SELECT CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'failed' WHEN count(*) > 0 THEN 'warning' ELSE 'passed' END AS status,
count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CAST({len(RULES)} AS BIGINT) AS rules, count(DISTINCT rule) AS rules_broken FROM v"""


def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and tiles of a tiled climatology, and its cells that aren't in one tile exactly."""
    tiled = stage(assembly.build_tiles(grid_cells(spark, sf_dir, 6, 6), 9), "tiled")
    return tiled.agg(F.countDistinct("row", "col").alias("cells"), F.count("tile").alias("rows")).crossJoin(assembly.tile_problems(tiled).agg(F.count(F.lit(1)).alias("problems")))


TILE_COVER = f"WITH {grid_sql(6, 6)}, {CLIMATOLOGY} SELECT count(DISTINCT row * 100 + col) AS cells, count(*) AS rows, CAST(0 AS BIGINT) AS problems FROM clim"


def source_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of the metrics table as a series for events, in tenths."""
    cells = grid_cells(spark, sf_dir)
    return report(cell_sources.load_series(None, daily.metrics_table(cells, None), "unused", "mean_sst_c", 10.0))


SOURCE_SERIES = rounded(f"WITH {GRID} SELECT date, 10 * sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS value, 1.0 AS valid_coverage FROM cells GROUP BY date", "value, valid_coverage", "date")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as measurements: several of a cell on a date, in order of arrival."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.date_add(F.lit("2000-01-01").cast("date"), ((F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate")).cast("int"))
    return items.select(day.alias("date"), (F.col("l_suppkey") % 12).cast("int").alias("row"), (F.col("l_partkey") % 12).cast("int").alias("col"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))


def resolved_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir)
    found = [quality.resolve_duplicates(rows, p).withColumn("policy", F.lit(p)) for p in ("mean", "first", "last")]
    return report(found[0].unionByName(found[1]).unionByName(found[2]))


_SAMPLES = "samples AS (SELECT DATE '2000-01-01' + CAST((year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS INTEGER) AS date, l_suppkey % 12 AS row, l_partkey % 12 AS col, CAST(l_quantity AS DOUBLE) AS value, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem)"
RESOLVED_DUPLICATES = rounded(
    f"WITH {_SAMPLES} SELECT date, row, col, avg(value) AS value, 'mean' AS policy FROM samples GROUP BY ALL UNION ALL SELECT date, row, col, arg_min(value, ordinal), 'first' FROM samples GROUP BY ALL UNION ALL SELECT date, row, col, arg_max(value, ordinal), 'last' FROM samples GROUP BY ALL",
    "value",
    f"date, policy, {_CELL}",
)


def gated_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means that need a coverage of 0.35, and 140 cells."""
    v, w = F.col("value"), C.latitude_weight(F.col("lat"))
    days = full_grid(grid_cells(spark, sf_dir, 20, 20)).groupBy("date").agg((F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))).alias("m"), (F.count(v) / F.count(F.lit(1))).alias("share"), F.count(v).alias("n"))
    rows = days.select("date", quality.coverage_gate(F.col("m"), F.col("share"), 0.35).alias("c"), quality.observation_gate(F.col("m"), F.col("n"), 140).alias("o"))
    return report(rows.select("date", F.col("c.value").alias("covered"), F.col("c.status").alias("cover_status"), F.col("c.reason").alias("cover_reason"), F.col("o.value").alias("observed"), F.col("o.status").alias("count_status"), F.col("o.reason").alias("count_reason")))


GATED_MEANS = rounded(
    f"""WITH {grid_sql(20, 20)}, {FULL_SQL}, d AS (SELECT date, sum(value * cos(radians(lat))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END) AS m, count(value) / count(*) AS share, count(value) AS n FROM full_cells GROUP BY date)
SELECT date, CASE WHEN share >= 0.35 THEN m END AS covered, CASE WHEN share >= 0.35 THEN 'valid' ELSE 'not_calculated' END AS cover_status, CASE WHEN share < 0.35 THEN printf('Valid coverage %.3f is below 0.350', round(share, 3)) END AS cover_reason,
CASE WHEN n >= 140 THEN m END AS observed, CASE WHEN n >= 140 THEN 'valid' ELSE 'not_calculated' END AS count_status, CASE WHEN n < 140 THEN printf('Only %d observations; minimum is 140', n) END AS count_reason FROM d""",
    "covered, observed",
    "date, cover_status, cover_reason, count_status, count_reason",
)


def auxiliary_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that aren't positive."""
    cells = grid_cells(spark, sf_dir).select("date", "row", "col", (F.col("value") - 25.0).alias("weight"))
    return report(quality.auxiliary_problems(cells, "weight", strictly_positive=True))


AUXILIARY_PROBLEMS = rounded(f"WITH {GRID} SELECT date, row, col, value - 25 AS weight FROM cells WHERE value <= 25", "weight", f"date, {_CELL}")


def dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps cells without values, and cells without a column, from use."""
    cells = grid_cells(spark, sf_dir)
    cases = {"sound": cells, "void": cells.withColumn("value", F.lit(float("nan"))), "none": cells.where("row < 0"), "short": cells.drop("lat")}
    parts = [quality.dataset_problems(df).withColumn("case", F.lit(name)) for name, df in cases.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


DATASET_PROBLEMS = """SELECT * FROM (VALUES ('There are no finite values', 'void'), ('There are no dates', 'none'), ('There are no finite values', 'none'), ('Column lat is missing', 'short')) AS t(problem, "case")"""


def lost_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitudes that only one of two parts of the grid has."""
    cells = grid_cells(spark, sf_dir)
    return report(quality.coordinates_agree(cells.where("row < 8"), cells.where("row > 3"), "lat"))


LOST_COORDINATES = rounded(f"WITH {GRID} SELECT DISTINCT lat, CASE WHEN row <= 3 THEN 'right' ELSE 'left' END AS missing_on FROM cells WHERE row <= 3 OR row >= 8", "lat", "missing_on")


def prepared_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day of a series that repeats days, by each policy."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("date"), (F.col("o_totalprice") / 997.0).cast("double").alias("value"), F.col("o_orderkey").alias("ordinal"))
    found = [events.prepared(orders, duplicates=p).withColumn("policy", F.lit(p)) for p in ("mean", "first", "last")]
    return report(found[0].unionByName(found[1]).unionByName(found[2]))


PREPARED_SERIES = rounded(
    """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice / 997.0 AS value, o_orderkey AS k FROM orders)
SELECT date, 'mean' AS policy, avg(value) AS value, 1.0 AS valid_coverage FROM o GROUP BY ALL UNION ALL SELECT date, 'first', arg_min(value, k), 1.0 FROM o GROUP BY ALL UNION ALL SELECT date, 'last', arg_max(value, k), 1.0 FROM o GROUP BY ALL""",
    "value, valid_coverage",
    "date, policy",
)


def threshold_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's own 90th percentile beside its values."""
    return report(events.percentile_threshold(grid_cells(spark, sf_dir).select("date", "row", "col", "value"), 90.0, ["row", "col"]))


THRESHOLD_PERCENTILE = rounded(f"WITH {GRID}, t AS (SELECT row, col, quantile_cont(value, 0.9) AS threshold FROM cells GROUP BY ALL) SELECT date, row, col, value, threshold FROM cells JOIN t USING (row, col)", "value, threshold", f"date, {_CELL}")


def threshold_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold of its own for every even day."""
    series = daily_series(spark, sf_dir)
    own = series.where("day(date) % 2 = 0").select("date", (F.col("value") - F.day("date")).alias("threshold"))
    return report(events.custom_threshold(series, own))


THRESHOLD_CUSTOM = rounded(f"WITH {SERIES_SQL} SELECT date, value, CASE WHEN day(date) % 2 = 0 THEN value - day(date) END AS threshold FROM series", "value, threshold", "date")


def axis_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the latitudes, and of longitudes taken over the date line."""
    cells = grid_cells(spark, sf_dir)
    lat = assembly.cell_edges(cells.select("lat").distinct(), "lat").select(F.lit("lat").alias("axis"), F.col("lat").alias("x"), "edge_low", "edge_high")
    turned = assembly.unwrapped_longitudes(cells.select("col", C.canonical_longitude(F.col("lon") - 95.0).alias("lon")).distinct())
    lon = assembly.cell_edges(turned, "lon").select(F.lit("lon").alias("axis"), F.col("lon").alias("x"), "edge_low", "edge_high")
    return report(lat.unionByName(lon))


AXIS_EDGES = rounded(f"WITH {GRID} SELECT DISTINCT 'lat' AS axis, lat AS x, lat - 0.5 AS edge_low, lat + 0.5 AS edge_high FROM cells UNION ALL SELECT DISTINCT 'lon', 175.0 + col, 174.5 + col, 175.5 + col FROM cells", "x, edge_low, edge_high", "axis")


def axis_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of the whole latitudes, and of latitudes without one line."""
    cells = grid_cells(spark, sf_dir)
    return report(regional.regular_step(cells, "row", "lat").unionByName(regional.regular_step(cells.where("row <> 4"), "row", "lat")))


AXIS_STEPS = rounded(f"WITH {GRID}, l AS (SELECT DISTINCT lat, row FROM cells), s AS (SELECT 0 AS k, lat - lag(lat) OVER (ORDER BY lat) AS d FROM l UNION ALL SELECT 1, lat - lag(lat) OVER (ORDER BY lat) FROM l WHERE row <> 4) SELECT median(d) AS step, max(d) - min(d) <= 0.001 AS regular FROM s GROUP BY k", "step", "regular")

_BOXES = (*BOXES, ("whole", "Whole grid", (-10.4, 1.4), (-90.4, -78.6)), ("beyond", "Beyond the grid", (-10.0, 3.0), (-90.0, -80.0)), ("afar", "Elsewhere", (20.0, 30.0), (10.0, 20.0)))


def region_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that the grid overlaps, and those it covers."""
    cells = grid_cells(spark, sf_dir)
    boxes = regional.region_table(spark, _BOXES)
    met = None
    for ident, _, lat, lon in _BOXES:
        one = regional.box_overlap(cells, regional.Box(lat, lon)).withColumn("region_id", F.lit(ident))
        met = one if met is None else met.unionByName(one)
    covered = regional.complete_regions(cells, boxes).select("region_id", F.lit(True).alias("covered"))
    return regional.region_completeness(cells, boxes).join(met, "region_id").join(covered, "region_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


REGION_EXTENTS = f"""WITH {GRID}, x AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM cells), r AS (SELECT * FROM (VALUES ('west', -10.0, -4.0, -90.0, -85.0), ('east', -7.0, 1.0, -86.0, -79.0), ('whole', -10.4, 1.4, -90.4, -78.6), ('beyond', -10.0, 3.0, -90.0, -80.0), ('afar', 20.0, 30.0, 10.0, 20.0)) AS t(region_id, south, north, west, east)),
q AS (SELECT region_id, a <= south + 0.5 AND b >= north - 0.5 AND c <= west + 0.5 AND d >= east - 0.5 AS complete, b >= south AND a <= north AND d >= west AND c <= east AS meets FROM r CROSS JOIN x)
SELECT region_id, complete, meets, complete AS covered FROM q"""


def region_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regional mean of a gridded climatology per day of the year."""
    cells = grid_cells(spark, sf_dir)
    clim = climatology.daily_statistics(cells).join(cells.select("row", "lat").distinct(), "row").join(cells.select("col", "lon").distinct(), "col")
    return report(regional.region_climatology(clim, regional.region_table(spark, BOXES)))


_MEAN_OF = "sum({c} * cos(radians(lat))) / sum(cos(radians(lat))) AS {c}"
REGION_CLIMATOLOGY = rounded(
    f"""WITH {GRID}, {CLIMATOLOGY}, {_BOX_SQL}, g AS (SELECT *, -10.0 + row AS lat, -90.0 + col AS lon FROM clim)
SELECT doy, region_id, region_label, {', '.join(_MEAN_OF.format(c=c) for c in ('clim_mean', 'clim_std', 'clim_p10', 'clim_p90'))}, 1.0 AS valid_coverage FROM g JOIN boxes ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY ALL""",
    "clim_mean, clim_std, clim_p10, clim_p90, valid_coverage",
    "CAST(doy AS BIGINT) AS doy, region_id, region_label",
)


def grid_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a whole-year climatology fits the grid, a part of it, and a part of the calendar."""
    cells, clim = grid_cells(spark, sf_dir), assembly.demo_climatology(spark, 12, 12)
    cases = {"whole": clim, "rows": clim.where("row < 9"), "days": clim.where("doy <> 60"), "spread": clim.withColumn("clim_std", F.when(F.col("doy") == 7, -1.0).otherwise(F.col("clim_std")))}
    parts = [regional.compatibility(cells, c).withColumn("case", F.lit(name)) for name, c in cases.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


GRID_COMPATIBILITY = """SELECT *, status = 'compatible' AS anomaly_allowed, status = 'compatible' AS percentiles_allowed FROM (VALUES ('compatible', 'whole'), ('incompatible_coordinates', 'rows'), ('incompatible_calendar', 'days'), ('invalid_deviation', 'spread')) AS t(status, "case")"""


def day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's cells with those of the wanted columns that exist."""
    return report(overview.rows_for_date(grid_cells(spark, sf_dir), DAY, ["row", "col", "value", "absent"]))


DAY_ROWS = rounded(f"WITH {GRID} SELECT row, col, value FROM cells WHERE date = DATE '{DAY}'", "value", _CELL)


def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(overview.padded_domain(daily_series(spark, sf_dir), "value"))


VALUE_RANGE = rounded(f"WITH {SERIES_SQL} SELECT min(value) - greatest((max(value) - min(value)) * 0.08, 0.1) AS low, max(value) + greatest((max(value) - min(value)) * 0.08, 0.1) AS high FROM series", "low, high")


def melted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = daily.metrics_table(grid_cells(spark, sf_dir), None).select("date", "mean_sst_c", "valid_data_coverage_percent", "maximum_anomaly_c")
    return report(overview.melted(means, ["mean_sst_c", "valid_data_coverage_percent", "maximum_anomaly_c"]))


MELTED_METRICS = rounded(f"WITH {GRID}, m AS (SELECT date, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS m FROM cells GROUP BY date) SELECT date, 'mean_sst_c' AS series, m AS value FROM m UNION ALL SELECT date, 'valid_data_coverage_percent', 100.0 FROM m", "value", "date, series")


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values up to a date, with the event that peaks on its own day."""
    flags = daily_plans._flags(spark, sf_dir)
    found = events.event_metrics(flags, daily_plans.BANDS).withColumn("event_id", events.event_id("Order price", F.col("event")))
    return report(overview.event_timeline(flags, found, "1995-06-30").select("date", "value", "threshold", "peak_event_id"))


EVENT_TIMELINE = rounded(f"SELECT f.date, f.value, f.threshold, m.event_id AS peak_event_id FROM ({_SQL['event_flags']}) AS f LEFT JOIN ({_SQL['event_metrics']}) AS m ON m.peak_date = f.date WHERE f.date <= DATE '1995-06-30'", "value, threshold", "date, peak_event_id")


def event_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within an interval, of a least duration and intensity, that a search finds."""
    found = daily_plans.event_metrics(spark, sf_dir)
    kept = overview.filter_catalogue(found.withColumnRenamed("cumulative_intensity", "cumulative_severity"), start="1993-01-01", end="1997-12-31", minimum_duration=3, minimum_severity=5.0, search="Order-Price")
    return kept.select("event_id", "start_date", "end_date", "duration_calendar_days")


EVENT_CATALOGUE = f"SELECT event_id, start_date, end_date, duration_calendar_days FROM ({_SQL['event_metrics']}) WHERE end_date >= DATE '1993-01-01' AND start_date <= DATE '1997-12-31' AND duration_calendar_days >= 3 AND cumulative_intensity >= 5"


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the tracks between consecutive days."""
    return report(overview.trajectory_segments(spatial_plans._lineage(spark, sf_dir)[0]), 4)


_PLACE = "centroid_latitude, centroid_longitude"
TRAJECTORIES = f"SELECT * FROM (SELECT track_id, date, {_PLACE}, lead(date) OVER o AS date_to, lead(centroid_latitude) OVER o AS centroid_latitude_to, lead(centroid_longitude) OVER o AS centroid_longitude_to FROM ({_SQL['lineage_nodes']}) WINDOW o AS (PARTITION BY track_id ORDER BY date)) WHERE date_to - date <= 1"


def active_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.active_ids(spatial_plans._lineage(spark, sf_dir)[0], DAY, "track_id")


ACTIVE_TRACKS = f"SELECT DISTINCT track_id FROM ({_SQL['lineage_nodes']}) WHERE date = DATE '{DAY}'"


def largest_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest family's nodes and the edges within it, told apart by ``kind``."""
    nodes, edges = spatial_plans._lineage(spark, sf_dir)
    observed = stage(nodes, "nodes")
    largest = observed.groupBy("event_family_id").count().orderBy(F.desc("count"), "event_family_id").first()
    family = largest["event_family_id"] if largest else ""
    own, inner, _ = overview.family_tables(family, observed, edges, overview.consistent_selection(observed, None, family))
    return own.select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("track_id").alias("b")).union(inner.select(F.lit("edge"), "predecessor_node_id", "successor_node_id"))


LARGEST_FAMILY = f"""WITH n AS ({_SQL['lineage_nodes']}), o AS (SELECT * FROM n WHERE event_family_id = (SELECT event_family_id FROM n GROUP BY 1 ORDER BY count(*) DESC, event_family_id LIMIT 1))
SELECT 'node' AS kind, node_id AS a, track_id AS b FROM o UNION ALL SELECT 'edge', predecessor_node_id, successor_node_id FROM ({_SQL['lineage_edges']}) WHERE predecessor_node_id IN (SELECT node_id FROM o) AND successor_node_id IN (SELECT node_id FROM o)"""


def class_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per date about how well the mean represents the cells."""
    return overview.interpretation(spatial_plans.representativeness(spark, sf_dir))


CLASS_TEXT = f"""SELECT date, class, CASE class WHEN 'strong_coherent' THEN printf('The regional mean of %.2f is strong and shared by most of the area.', m) WHEN 'strong_heterogeneous' THEN printf('The regional mean of %.2f is strong but the area differs widely from it.', m) WHEN 'compensated_mixed' THEN printf('Opposite anomalies cancel in the regional mean of %.2f.', m)
WHEN 'patch_distributed' THEN printf('The regional mean of %.2f comes from scattered patches.', m) WHEN 'weak_homogeneous' THEN printf('The regional mean of %.2f is weak and the area is alike.', m) WHEN 'insufficient_coverage' THEN 'Too little of the area has data to interpret its mean.' ELSE 'No rule describes the regional mean.' END AS text FROM (SELECT date, class, round(weighted_mean_anomaly, 2) AS m FROM ({_SQL['representativeness']}))"""


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, found = spatial_plans._found(spark, sf_dir)
    table = stage(patches.patch_table(cells, spatial_plans.RULE, found), "patches")
    nodes, _ = tracks.lineage(table, tracks.links(found, table, spatial_plans.LINKS))
    series = daily_plans.area_means(spark, sf_dir).select("date", F.col("mean").alias("value"))
    flags = events.daily_flags(events.percentile_threshold(events.prepared(series), 70.0), daily_plans.RULE)
    classes = spatial_plans.representativeness(spark, sf_dir)
    return overview.event_overview(DAY, flags=flags, patches=table, daily=patches.daily_summary(cells, table, spatial_plans.RULE), observations=nodes, classes=classes)


def event_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of one day over all products, and its text in two languages."""
    day = stage(_overview(spark, sf_dir), "overview")
    texts = [overview.event_text(day, k).select(F.col("text").alias(f"text_{k}")) for k in ("en", "es")]
    return report(day.crossJoin(texts[0]).crossJoin(texts[1]).withColumns({c: F.col(c).cast("double") for c in ("event", "event_day")}), 4)  # one row each


_GRID_FLAGS = daily_plans.EVENT_FLAGS.replace(SERIES_SQL, f"series AS (SELECT date, mean AS value FROM ({_SQL['area_means']}))")
EVENT_OVERVIEW = rounded(
    f"""WITH f AS ({_GRID_FLAGS}), p AS ({_SQL['patch_table']}), s AS ({_SQL['patch_summary']}), n AS ({_SQL['lineage_nodes']}), c AS ({_SQL['representativeness']}),
o AS (SELECT DATE '{DAY}' AS date, (SELECT max(event) FROM f WHERE date = DATE '{DAY}') AS event, (SELECT max(event_day) FROM f WHERE date = DATE '{DAY}') AS event_day, (SELECT max(intensity) FROM f WHERE date = DATE '{DAY}') AS intensity, (SELECT max(status) FROM f WHERE date = DATE '{DAY}') AS event_status,
(SELECT count(*) FROM p WHERE date = DATE '{DAY}') AS patches, (SELECT max(area_km2) FROM p WHERE date = DATE '{DAY}') AS largest_patch_km2, (SELECT max(total_patch_area_km2) FROM s WHERE date = DATE '{DAY}') AS total_patch_area_km2,
(SELECT count(DISTINCT track_id) FROM n WHERE date = DATE '{DAY}') AS active_tracks, (SELECT count(DISTINCT event_family_id) FROM n WHERE date = DATE '{DAY}') AS active_families, (SELECT max(class) FROM c WHERE date = DATE '{DAY}') AS representativeness_class)
SELECT *, concat('On {DAY}, ', CASE WHEN event IS NULL THEN 'no regional event' ELSE printf('event day %d of a regional event at an intensity of %.2f', CAST(event_day AS BIGINT), intensity) END, printf('. Patches: %d, tracks: %d, families: %d', patches, active_tracks, active_families), CASE WHEN patches > 0 THEN printf('; the largest patch has %.0f km2', largest_patch_km2) END, '.') AS text_en,
concat('El {DAY}, ', CASE WHEN event IS NULL THEN 'sin evento regional' ELSE printf('día %d de un evento regional con una intensidad de %.2f', CAST(event_day AS BIGINT), intensity) END, printf('. Parches: %d, trayectorias: %d, familias: %d', patches, active_tracks, active_families), CASE WHEN patches > 0 THEN printf('; el parche mayor tiene %.0f km2', largest_patch_km2) END, '.') AS text_es FROM o""",
    "event, event_day, intensity, largest_patch_km2, total_patch_area_km2",
    "date, event_status, patches, active_tracks, active_families, representativeness_class, text_en, text_es",
    4,
)


QUERIES = {
    "normalised_cells": (normalised_cells, NORMALISED_CELLS), "netcdf_cube": (netcdf_cube, NETCDF_CUBE), "netcdf_day": (netcdf_day, NETCDF_DAY), "live_or_demo": (live_or_demo, LIVE_OR_DEMO), "available_dates": (available_dates, AVAILABLE_DATES), "unit_names": (unit_names, UNIT_NAMES), "product_states": (product_states, PRODUCT_STATES),
    "published_bundle": (published_bundle, PUBLISHED_BUNDLE), "json_round_trip": (json_round_trip, JSON_ROUND_TRIP), "csv_round_trip": (csv_round_trip, CSV_ROUND_TRIP), "json_lines": (json_lines, JSON_LINES), "resumed_climatology": (resumed_climatology, RESUMED_CLIMATOLOGY), "rebuilt_parts": (rebuilt_parts, REBUILT_PARTS), "streamed_runs": (streamed_runs, STREAMED_RUNS), "rule_violations": (rule_violations, RULE_VIOLATIONS), "rule_verdict": (rule_verdict, RULE_VERDICT),
    "tile_cover": (tile_cover, TILE_COVER), "source_series": (source_series, SOURCE_SERIES), "resolved_duplicates": (resolved_duplicates, RESOLVED_DUPLICATES), "gated_means": (gated_means, GATED_MEANS), "auxiliary_problems": (auxiliary_problems, AUXILIARY_PROBLEMS),
    "dataset_problems": (dataset_problems, DATASET_PROBLEMS), "lost_coordinates": (lost_coordinates, LOST_COORDINATES), "prepared_series": (prepared_series, PREPARED_SERIES), "threshold_percentile": (threshold_percentile, THRESHOLD_PERCENTILE), "threshold_custom": (threshold_custom, THRESHOLD_CUSTOM),
    "axis_edges": (axis_edges, AXIS_EDGES), "axis_steps": (axis_steps, AXIS_STEPS), "region_extents": (region_extents, REGION_EXTENTS), "region_climatology": (region_climatology, REGION_CLIMATOLOGY), "grid_compatibility": (grid_compatibility, GRID_COMPATIBILITY),
    "day_rows": (day_rows, DAY_ROWS), "value_range": (value_range, VALUE_RANGE), "melted_metrics": (melted_metrics, MELTED_METRICS), "event_timeline": (event_timeline, EVENT_TIMELINE), "event_catalogue": (event_catalogue, EVENT_CATALOGUE),
    "trajectories": (trajectories, TRAJECTORIES), "active_tracks": (active_tracks, ACTIVE_TRACKS), "largest_family": (largest_family, LARGEST_FAMILY), "class_text": (class_text, CLASS_TEXT), "event_overview": (event_overview, EVENT_OVERVIEW),
}
