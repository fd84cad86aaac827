"""Distance of grid points from a coast of great-circle arcs, and the corridor within a limit.

Points are unit vectors, so neither the poles nor the date line are special.  Arcs are cut into
pieces no longer than the limit; a piece is entered by its middle in the 27 cubes around it, whose edge is
the limit and half a piece, and meets the points of those cubes alone: an equi-join whose
rows follow the points near the coast.  The distance is to the arc itself, not to its vertices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import columns as C

#: 60 nautical miles.
LIMIT_KM = 111.12
Vector = tuple[Column, Column, Column]


def unit_vector(lat: Column, lon: Column) -> Vector:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def vector(name: str) -> Vector:
    return F.col(f"{name}x"), F.col(f"{name}y"), F.col(f"{name}z")


def named(v: Vector, name: str) -> list[Column]:
    return [c.alias(f"{name}{axis}") for c, axis in zip(v, "xyz", strict=True)]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def apart_km(a: Vector, b: Vector) -> Column:
    """Great-circle distance of unit vectors, by their chord: exact for near points too."""
    gap = [p - q for p, q in zip(a, b, strict=True)]
    return 2 * C.EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) / 2))


def arcs(vertices: DataFrame, order: str = "place", line: list[str] = ["line"]) -> DataFrame:
    """``line, lat_a, lon_a, lat_b, lon_b`` of neighbouring vertices (``line, place, lat, lon``)."""
    over = Window.partitionBy(*line).orderBy(order)
    ends = vertices.select(*line, F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.lead("lat").over(over).alias("lat_b"), F.lead("lon").over(over).alias("lon_b"))
    return ends.where("lat_b IS NOT NULL")


def pieces(arcs: DataFrame, longest_km: float) -> DataFrame:
    """``ax .. bz``: the ends of pieces of at most ``longest_km`` along each arc (less than half a circle)."""
    ends = arcs.select(*named(unit_vector(F.col("lat_a"), F.col("lon_a")), "p"), *named(unit_vector(F.col("lat_b"), F.col("lon_b")), "q"))
    p, q = vector("p"), vector("q")
    sized = ends.withColumn("angle", apart_km(p, q) / C.EARTH_RADIUS_KM)
    sized = sized.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("angle") * C.EARTH_RADIUS_KM / longest_km).cast("int")))
    cut = sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def at(place: Column) -> Vector:
        share = place / F.col("n")
        whole = F.nullif(F.sin("angle"), F.lit(0.0))
        left, right = F.sin((1 - share) * F.col("angle")) / whole, F.sin(share * F.col("angle")) / whole
        return tuple(F.coalesce(left * a + right * b, a) for a, b in zip(p, q, strict=True))

    return cut.select(*named(at(F.col("i")), "a"), *named(at(F.col("i") + 1), "b"))


def arc_distance_km(point: Vector, a: Vector, b: Vector) -> Column:
    """Distance of a point from the shorter arc between ``a`` and ``b``."""
    pole = cross(a, b)
    size = F.sqrt(dot(pole, pole))
    beside = (dot(cross(pole, a), point) >= 0) & (dot(cross(b, pole), point) >= 0) & (size > 1e-12)
    off = C.EARTH_RADIUS_KM * F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(pole, point) / F.nullif(size, F.lit(0.0))))))
    return F.when(beside, off).otherwise(F.least(apart_km(point, a), apart_km(point, b)))


def coast_distance(points: DataFrame, arcs: DataFrame, limit_km: float = LIMIT_KM) -> DataFrame:
    """``points`` (``lat``, ``lon`` and others) within ``limit_km`` of an arc, with ``coast_km``."""
    if not 0 < limit_km < 5000:
        raise ValueError("the limit is positive and well below half a circle")
    edge = 1.5 * limit_km / C.EARTH_RADIUS_KM  # no chord is longer than its arc
    cube = lambda v: F.struct(*[F.floor(c / edge).cast("int").alias(axis) for c, axis in zip(v, "xyz", strict=True)])
    placed = points.withColumn("__id", F.struct("lat", "lon"))
    sites = placed.select("__id").distinct().select("__id", *named(unit_vector(F.col("__id.lat"), F.col("__id.lon")), "p"))
    sites = sites.withColumn("cube", cube(vector("p")))
    found = pieces(arcs, limit_km).withColumns({f"m{axis}": (a + b) / 2 for axis, a, b in zip("xyz", vector("a"), vector("b"), strict=True)})
    size = F.sqrt(dot(vector("m"), vector("m")))
    found = found.select(*[f"{v}{axis}" for v in "ab" for axis in "xyz"], cube([c / size for c in vector("m")]).alias("at"))
    for axis in "xyz":  # the 27 cubes around
        found = found.withColumn(f"step_{axis}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    coast = found.withColumn("cube", F.struct(*[(F.col(f"at.{axis}") + F.col(f"step_{axis}")).alias(axis) for axis in "xyz"]))
    near = sites.join(coast, "cube").groupBy("__id").agg(F.min(arc_distance_km(vector("p"), vector("a"), vector("b"))).alias("coast_km"))
    return placed.join(near.where(F.col("coast_km") <= limit_km), "__id").drop("__id")
