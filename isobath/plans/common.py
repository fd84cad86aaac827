"""What the query modules share: rounding for reports, and the SQL of common steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobath.functions.columns import tidy


def report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, small integers as long: what both engines print alike."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        out.append((tidy(col, digits) if kind == "double" else col.cast("long") if kind in ("int", "smallint", "tinyint") else col).alias(name))
    return df.select(*out)


def rounded(query: str, doubles: str, others: str = "", digits: int = 6) -> str:
    """SQL with the columns ``doubles`` (comma-separated) of ``query`` rounded; ``query`` may begin with WITH."""
    columns = [c.strip() for c in others.split(",") if c.strip()] + [f"CAST(round(CAST({c.strip()} AS DOUBLE), {digits}) AS DOUBLE) + 0.0 AS {c.strip()}" for c in doubles.split(",") if c.strip()]
    return f"SELECT {', '.join(columns)} FROM ({query}) AS q"


WEIGHTED = "weighted AS (SELECT *, cos(radians(lat)) AS w FROM cells)"

STABLE_DAY = "dayofyear(make_date(2000, month(date), day(date)))"

#: 366-day statistics of cells, pooled over 11 days and smoothed over 31.
CLIMATOLOGY = f"""
pooled AS (SELECT row, col, value AS v, ({STABLE_DAY} + b - 1 + 366) % 366 + 1 AS doy FROM cells, unnest(range(-5, 6)) AS t(b) WHERE value IS NOT NULL),
rawclim AS (SELECT row, col, doy, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS clim_std, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS clim_median, quantile_cont(v, 0.9) AS p90 FROM pooled GROUP BY ALL),
smoothclim AS (SELECT row, col, (doy + b - 1 + 366) % 366 + 1 AS doy, avg(mean) AS clim_mean, avg(p10) AS clim_p10, avg(p90) AS clim_p90 FROM rawclim, unnest(range(-15, 16)) AS t(b) GROUP BY ALL),
clim AS (SELECT row, col, doy, n, clim_std, clim_median, clim_mean, clim_p10, clim_p90 FROM rawclim JOIN smoothclim USING (row, col, doy))"""


def quantile_sql(source: str, by: str, value: str, weight: str, probabilities: dict[str, float]) -> str:
    """Weighted midpoint quantiles of ``source`` per ``by``."""
    parts = []
    for name, q in probabilities.items():
        low, high = f"max(CASE WHEN p <= {q} THEN v END)", f"min(CASE WHEN p > {q} THEN v END)"
        lp, hp = f"max(CASE WHEN p <= {q} THEN p END)", f"min(CASE WHEN p > {q} THEN p END)"
        parts.append(f"CASE WHEN {low} IS NULL THEN {high} WHEN {high} IS NULL THEN {low} ELSE {low} + ({high} - {low}) * ({q} - {lp}) / ({hp} - {lp}) END AS {name}")
    return f"""SELECT {by}, {', '.join(parts)} FROM (
  SELECT {by}, {value} AS v, (sum({weight}) OVER (PARTITION BY {by} ORDER BY {value}, row, col ROWS UNBOUNDED PRECEDING) - {weight} / 2) / sum({weight}) OVER (PARTITION BY {by}) AS p
  FROM {source} WHERE {value} IS NOT NULL AND {weight} > 0) GROUP BY {by}"""
