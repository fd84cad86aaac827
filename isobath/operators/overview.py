"""Selections, segments, rankings and text over the event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_for_date(table: DataFrame, date: str, columns: list[str] | None = None) -> DataFrame:
    """A day's rows, with those of the wanted columns that exist."""
    day = table.where(F.to_date("date") == F.lit(date).cast("date"))
    return day if columns is None else day.select(*[c for c in columns if c in table.columns])


def active_ids(table: DataFrame, date: str, column: str) -> DataFrame:
    return rows_for_date(table, date).where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def temporal_segments(table: DataFrame, values: list[str] = [], *, keys: list[str] = [], maximum_gap: int = 1) -> DataFrame:
    """Rows with ``segment_id``, which grows at a gap, at a missing value and after one."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    gap = F.coalesce(F.datediff("date", F.lag("date").over(order)) > maximum_gap, F.lit(False))
    missing = F.lit(False)
    for v in values:
        missing = missing | F.col(v).isNull()
    rows = table.where(F.col("date").isNotNull()).withColumn("__missing", missing)
    cut = gap | F.col("__missing") | F.coalesce(F.lag("__missing").over(order), F.lit(False))
    return rows.withColumn("__cut", cut.cast("int")).withColumn("segment_id", F.sum("__cut").over(order)).drop("__missing", "__cut")


def padded_domain(table: DataFrame, column: str, *, fraction: float = 0.08, least: float = 0.1) -> DataFrame:
    """``low``, ``high`` with padding around the values."""
    out = table.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    pad = F.greatest((F.col("b") - F.col("a")) * fraction, F.lit(least))
    return out.where("a IS NOT NULL").select((F.col("a") - pad).alias("low"), (F.col("b") + pad).alias("high"))


def melted(table: DataFrame, columns: list[str], *, name: str = "series", value: str = "value") -> DataFrame:
    """Long form of several columns, without missing values."""
    return table.unpivot(["date"], columns, name, value).where(F.col(value).isNotNull())


def filter_catalogue(table: DataFrame, *, start: str | None = None, end: str | None = None, minimum_duration: float = 0, minimum_area: float = 0, minimum_severity: float = 0, split: bool = False, merge: bool = False, boundary: bool = False, search: str = "") -> DataFrame:
    """Entries that overlap the interval and pass the limits; ``search`` looks through all columns."""
    has = lambda *names: next((n for n in names if n in table.columns), None)
    out = table
    if start and has("end_date"):
        out = out.where(F.col("end_date") >= F.lit(start).cast("date"))
    if end and has("start_date"):
        out = out.where(F.col("start_date") <= F.lit(end).cast("date"))
    limits = ((("duration_calendar_days", "observed_days"), minimum_duration), (("maximum_area_km2", "maximum_total_daily_area_km2", "largest_patch_area_km2"), minimum_area), (("cumulative_severity", "cumulative_intensity"), minimum_severity))
    for names, limit in limits:
        if column := has(*names):
            out = out.where(F.col(column) >= limit)
    for wanted, column in ((split, "split_count"), (merge, "merge_count")):
        if wanted and has(column):
            out = out.where(F.col(column) > 0)
    if boundary and has("boundary_contact_day_count"):
        out = out.where(F.col("boundary_contact_day_count") > 0)
    elif boundary and (sides := [c for c in table.columns if c.startswith("touches_")]):
        any_side = F.lit(False)
        for c in sides:
            any_side = any_side | F.coalesce(c, F.lit(False))
        out = out.where(any_side)
    if search.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in table.columns])), F.lit(search.strip().lower())))
    return out


def first_records(table: DataFrame, column: str, value: object) -> DataFrame:
    return table.where(F.col(column) == F.lit(value)).limit(1)


def top_per_date(table: DataFrame, measure: str, ident: str, k: int) -> DataFrame:
    """The ``k`` largest of each date, ties by identifier."""
    order = Window.partitionBy("date").orderBy(F.desc(measure), ident)
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def event_timeline(flags: DataFrame, events: DataFrame, date: str) -> DataFrame:
    """Daily values up to a date with the event's peak beside its own day."""
    peaks = events.select(F.col("peak_date").alias("date"), F.col("event_id").alias("peak_event_id"))
    return flags.where(F.col("date") <= F.lit(date).cast("date")).join(peaks, "date", "left")


def family_tables(family: str, observations: DataFrame, edges: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A family's observations, the edges with both ends among them, and its tracks."""
    own = observations.where(F.col("event_family_id") == family)
    ends = own.select("node_id")
    inner = edges.join(ends, edges["predecessor_node_id"] == ends["node_id"], "left_semi").join(ends, edges["successor_node_id"] == ends["node_id"], "left_semi")
    return own, inner, tracks.where(F.col("event_family_id") == family)


def consistent_selection(tracks: DataFrame, track: str | None, family: str | None) -> DataFrame:
    """The track if it belongs to the family, else the family's first; the family decides."""
    rows = tracks.select("track_id", "event_family_id")
    if family is not None:
        rows = rows.where(F.col("event_family_id") == family)
    wanted = F.col("track_id") == F.lit(track)
    return rows.orderBy(F.desc_nulls_last(wanted), "track_id").limit(1)


def track_series(observations: DataFrame, edges: DataFrame, track: str) -> DataFrame:
    """A track day by day: distance (of the link, else of the centroids), speed and change of area."""
    from isobath.functions.columns import haversine_km

    order = Window.partitionBy("track_id").orderBy("date")
    was = {c: F.lag(c).over(order) for c in ("node_id", "date", "area_km2", "centroid_latitude", "centroid_longitude")}
    rows = observations.where(F.col("track_id") == track).select("track_id", "node_id", "date", "area_km2", was["node_id"].alias("before"), F.datediff("date", was["date"]).alias("days"), (F.col("area_km2") - was["area_km2"]).alias("grown"), haversine_km(was["centroid_latitude"], was["centroid_longitude"], F.col("centroid_latitude"), F.col("centroid_longitude")).alias("km"))
    link = edges.select(F.col("predecessor_node_id").alias("before"), F.col("successor_node_id").alias("node_id"), F.col("centroid_distance_km").alias("linked"))
    out = rows.join(link, ["before", "node_id"], "left").withColumn("distance_km", F.coalesce("linked", "km"))
    return out.select("track_id", "date", "area_km2", "distance_km", (F.col("distance_km") / F.col("days")).alias("speed_km_per_day"), (F.col("grown") / F.col("days")).alias("area_change_km2_per_day"))


def trajectory_segments(observations: DataFrame, *, maximum_gap: int = 1) -> DataFrame:
    """Consecutive points of each track, not across longer gaps."""
    order = Window.partitionBy("track_id").orderBy("date")
    nxt = [F.lead(c).over(order).alias(f"{c}_to") for c in ("date", "centroid_latitude", "centroid_longitude")]
    return observations.select("track_id", "date", "centroid_latitude", "centroid_longitude", *nxt).where(F.datediff("date_to", "date") <= maximum_gap)


def lineage_sample(observations: DataFrame, edges: DataFrame, date: str, track: str | None, most: int) -> tuple[DataFrame, DataFrame]:
    """At most ``most`` nodes for a drawing (the day's, the track's, the backbone, the first of each track), and their edges."""
    first = F.row_number().over(Window.partitionBy("track_id").orderBy("date", "node_id")) == 1
    backbone = edges.where("is_continuation_backbone")
    tails = backbone.select(F.col("predecessor_node_id").alias("node_id")).union(backbone.select("successor_node_id")).distinct().withColumn("tail", F.lit(True))
    rows = observations.withColumn("first", first).join(tails, "node_id", "left")
    place = F.when((F.col("date") == F.lit(date).cast("date")) | F.coalesce(F.col("track_id") == F.lit(track), F.lit(False)), 0).when(F.coalesce("tail", F.lit(False)), 1).when(F.col("first"), 2)
    nodes = rows.withColumn("place", place).where("place IS NOT NULL").orderBy("place", "date", "node_id").limit(most).drop("first", "tail", "place")
    ends = nodes.select("node_id")
    inner = edges.join(ends, edges["predecessor_node_id"] == ends["node_id"], "left_semi").join(ends, edges["successor_node_id"] == ends["node_id"], "left_semi")
    return nodes, inner


def event_overview(date: str, *, flags: DataFrame, patches: DataFrame, daily: DataFrame, observations: DataFrame, classes: DataFrame) -> DataFrame:
    """One row for a date out of the products: the current event, patches, tracks, families and class."""
    day = F.lit(date).cast("date")
    event = flags.where(F.col("date") == day).agg(F.max("event").alias("event"), F.max("event_day").alias("event_day"), F.max("intensity").alias("intensity"), F.max("status").alias("event_status"))
    spots = patches.where(F.col("date") == day).agg(F.count(F.lit(1)).alias("patches"), F.max("area_km2").alias("largest_patch_km2"))
    total = daily.where(F.col("date") == day).agg(F.max("total_patch_area_km2").alias("total_patch_area_km2"))
    moving = observations.where(F.col("date") == day).agg(F.countDistinct("track_id").alias("active_tracks"), F.countDistinct("event_family_id").alias("active_families"))
    kind = classes.where(F.col("date") == day).agg(F.max("class").alias("representativeness_class"))
    out = event
    for other in (spots, total, moving, kind):
        out = out.crossJoin(other)  # one row each
    return out.select(day.alias("date"), "*")


def sentence(template: str, *parts: str | Column) -> Column:
    """A template sentence of columns."""
    return F.format_string(template, *[F.col(p) if isinstance(p, str) else p for p in parts])


def interpretation(classes: DataFrame) -> DataFrame:
    """A plain sentence per date about how well the regional mean represents its cells."""
    say = {
        "strong_coherent": "The regional mean of %.2f is strong and shared by most of the area.",
        "strong_heterogeneous": "The regional mean of %.2f is strong but the area differs widely from it.",
        "compensated_mixed": "Opposite anomalies cancel in the regional mean of %.2f.",
        "patch_distributed": "The regional mean of %.2f comes from scattered patches.",
        "weak_homogeneous": "The regional mean of %.2f is weak and the area is alike.",
        "insufficient_coverage": "Too little of the area has data to interpret its mean.",
    }
    text = F.lit("No rule describes the regional mean.")
    for name, template in say.items():
        own = sentence(template, "weighted_mean_anomaly") if "%" in template else F.lit(template)
        text = F.when(F.col("class") == name, own).otherwise(text)
    return classes.select("date", "class", text.alias("text"))


#: Sentences about an event and what is in space beside it, per language.
EVENT_TEXT = {
    "en": ("On %s, event day %d of a regional event", "On %s, no regional event", " at an intensity of %.2f", ". Patches: %d, tracks: %d, families: %d", "; the largest patch has %.0f km2", "."),
    "es": ("El %s, día %d de un evento regional", "El %s, sin evento regional", " con una intensidad de %.2f", ". Parches: %d, trayectorias: %d, familias: %d", "; el parche mayor tiene %.0f km2", "."),
}


def event_text(overview: DataFrame, language: str = "en") -> DataFrame:
    """``date``, ``text``: the state of the event and the patches in rows of ``event_overview``, in one of two languages."""
    running, none, strength, counts, largest, end = EVENT_TEXT[language]
    day, active = F.date_format("date", "yyyy-MM-dd"), F.col("event").isNotNull()
    state = F.when(active, F.format_string(running, day, F.coalesce("event_day", F.lit(1)))).otherwise(F.format_string(none, day))
    parts = [
        state, F.when(active & F.col("intensity").isNotNull(), sentence(strength, "intensity")), sentence(counts, "patches", "active_tracks", "active_families"),
        F.when(F.col("patches") > 0, sentence(largest, "largest_patch_km2")), F.lit(end),
    ]
    return overview.select("date", F.concat_ws("", *parts).alias("text"))
