"""Column expressions: calendar, coordinates, geodesy, missing values, identifiers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
DAYS = 366


def finite(x: Column) -> Column:
    """``x`` without NaN and infinities, which become null: they would pass comparisons as large."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def stable_day(date: Column) -> Column:
    """Calendar day on a leap year, 1 to 366: February 29 is 60 and March 1 is 61 in every year."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(date), F.day(date))).cast("int")


def circular_day_distance(day: Column, target: Column, period: int = DAYS) -> Column:
    apart = F.abs(day - target)
    return F.least(apart, F.lit(period) - apart)


def wrap_day(day: Column) -> Column:
    """Calendar day of any integer, around the end of the year."""
    return (F.pmod(day - 1, F.lit(DAYS)) + 1).cast("int")


def canonical_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def latitude_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def unit_kind(unit: Column) -> Column:
    """``celsius``, ``kelvin`` or ``dimensionless`` for a known spelling of a unit, else null."""
    name = F.lower(F.trim(unit))
    # fixed values: the unit spellings that are accepted
    return (
        F.when(name.isin("c", "°c", "celsius", "degc", "deg_c", "degree_celsius", "degrees_celsius"), "celsius")
        .when(name.isin("k", "kelvin", "degk", "degree_kelvin", "degrees_kelvin"), "kelvin")
        .when(name.isin("1", "", "dimensionless", "none", "unitless"), "dimensionless")
    )


def nautical_miles_to_km(miles: Column) -> Column:
    return miles * 1.852


def km_to_nautical_miles(km: Column) -> Column:
    return km / 1.852


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance."""
    rise, run = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.sin(rise) * F.sin(rise) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(run) * F.sin(run)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def bearing_degrees(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Initial bearing in [0, 360); null between coincident points."""
    a, b, run = F.radians(lat_a), F.radians(lat_b), F.radians(lon_b - lon_a)
    y = F.sin(run) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(run)
    same = (F.abs(lat_a - lat_b) < 1e-12) & (F.abs(canonical_longitude(lon_b - lon_a)) < 1e-12)
    return F.when(~same, F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0)))


def cell_area_km2(lat: Column, lat_step: float, lon_step: float) -> Column:
    """Area of the cell around ``lat`` on the sphere, cut off at the poles."""
    north = F.least(lat + lat_step / 2, F.lit(90.0))
    south = F.greatest(lat - lat_step / 2, F.lit(-90.0))
    return F.lit(EARTH_RADIUS_KM**2) * F.abs(F.sin(F.radians(north)) - F.sin(F.radians(south))) * F.radians(F.lit(lon_step))


def within(value: Column, bounds: tuple[float, float]) -> Column:
    return value.between(*bounds)


def inside_box(lat: Column, lon: Column, lat_bounds: tuple[float, float], lon_bounds: tuple[float, float]) -> Column:
    """Cell centres in a closed rectangle; plain ranges, so they reach the scan."""
    return within(lat, lat_bounds) & within(lon, lon_bounds)


def exceeds(value: Column, threshold: Column, direction: str = "above", inclusive: bool = True) -> Column:
    if direction not in ("above", "below"):
        raise ValueError("direction is 'above' or 'below'")
    if direction == "above":
        return value >= threshold if inclusive else value > threshold
    return value <= threshold if inclusive else value < threshold


def intensity(value: Column, threshold: Column, direction: str = "above") -> Column:
    return value - threshold if direction == "above" else threshold - value


def severity(maximum: Column, bands: dict[str, float]) -> Column:
    return F.when(maximum >= bands["extreme"], "extreme").when(maximum >= bands["strong"], "strong").otherwise("moderate")


def thermal_flag(mean_anomaly: Column, threshold: float) -> Column:
    return F.when(mean_anomaly > threshold, "above_threshold").otherwise("below_threshold")


def slug(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("event"))


def node_id(date: Column, patch: Column) -> Column:
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("::P"), F.lpad(patch.cast("string"), 6, "0"))


def direction_of(value: Column, threshold: float) -> Column:
    """``stable`` within the threshold, else where the value goes."""
    return F.when(value.isNull(), "insufficient_data").when(F.abs(value) <= threshold, "stable").when(value > 0, "increasing").otherwise("decreasing")


def selected(col: Column, options: list[object]) -> Column:
    """The value if it is one of the options."""
    return F.when(col.isin(options), col)


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded for reports; no negative zero."""
    return F.round(x, digits) + 0.0
