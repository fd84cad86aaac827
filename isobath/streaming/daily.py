"""Streams of daily observations: an addition to the batch engine, over the same functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from isobath.functions import columns as C
from isobath.functions import statistics as S


def daily_means(stream: DataFrame, *, late: str = "3 days") -> DataFrame:
    """Area-weighted mean and coverage per day of a stream of cells (``ts``, ``lat``, ``value``); later rows are dropped."""
    w = C.latitude_weight(F.col("lat"))
    rows = stream.withWatermark("ts", late).withColumn("w", w).withColumn("value", C.finite(F.col("value")))
    days = rows.groupBy(F.window("ts", "1 day").alias("day")).agg(S.weighted_mean(F.col("value"), F.col("w")).alias("mean"), S.coverage(F.col("value"), F.col("w")).alias("coverage"), F.count("value").alias("n"))
    return days.select(F.to_date("day.start").alias("date"), "mean", "coverage", "n")


RUNS = "series string, start date, end date, days long, maximum double, open boolean"


def exceedance_runs(stream: DataFrame, threshold: float) -> DataFrame:
    """Runs of consecutive days above a threshold per series (``series``, ``date``, ``value``), carried over batches.

    A run is reported when it ends, and while it is open after every batch that extends it.
    """

    def advance(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, days, top = state.get if state.exists else (None, None, 0, 0.0)
        out = []
        for date, value in pd.concat(list(frames)).sort_values("date")[["date", "value"]].itertuples(index=False):
            above = value is not None and value == value and value > threshold
            if days and (not above or (date - end).days != 1):
                out.append((key[0], start, end, days, top, False))
                days = 0
            if above:
                start, top = (date, value) if not days else (start, max(top, value))
                end, days = date, days + 1
        if days:
            out.append((key[0], start, end, days, top, True))
        state.update((start, end, days, float(top)))
        yield pd.DataFrame(out, columns=["series", "start", "end", "days", "maximum", "open"])

    return stream.groupBy("series").applyInPandasWithState(advance, RUNS, "start date, end date, days long, top double", "append", GroupStateTimeout.NoTimeout)


SETTLED = "series string, start date, end date, days long, maximum double"
DAY_MS = 86_400_000
EPOCH = pd.Timestamp("1970-01-01")


def settled_runs(stream: DataFrame, threshold: float, *, late: str = "2 days") -> DataFrame:
    """Runs of consecutive days whose mean is above a threshold, of a stream of observations (``series``, ``ts``, ``value``).

    Observations may come in any order within ``late``.  A day's sum and count are held until the
    watermark has passed its end; days then join runs in order, and a run is given out once, when the day
    after its end is over too.  Each series has one event-time timer, for the next end of a day that
    matters, and its state goes when no day or run is open.  State holds days, not observations: it
    is bounded by the days within ``late`` and those of one run's ends.  Null and NaN values don't count.
    """
    seen = stream.withWatermark("ts", late).select("series", "ts", F.unix_date(F.to_date("ts")).alias("day"), C.finite(F.col("value")).alias("value"))

    def advance(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, sums, counts, start, end, length, top = state.get if state.exists else ([], [], [], None, None, 0, 0.0)
        held = {d: [s, n] for d, s, n in zip(days, sums, counts, strict=True)}
        for frame in frames:
            known = frame.dropna(subset=["value"])
            for day, s, n in known.groupby("day")["value"].agg(["sum", "count"]).itertuples():
                own = held.setdefault(int(day), [0.0, 0])
                own[0] += float(s)
                own[1] += int(n)
        over = state.getCurrentWatermarkMs() // DAY_MS  # days before this one have ended
        out = []
        for day in sorted(d for d in held if d < over):
            total, n = held.pop(day)
            above = total / n > threshold
            if length and (not above or day != end + 1):
                out.append((key[0], start, end, length, top))
                length = 0
            if above:
                start, top = (day, total / n) if not length else (start, max(top, total / n))
                end, length = day, length + 1
        if length and end + 1 < over:
            out.append((key[0], start, end, length, top))
            length = 0
        if held or length:
            order = sorted(held)
            state.update((order, [held[d][0] for d in order], [held[d][1] for d in order], start if length else None, end if length else None, length, float(top)))
            # the end of the first day held, or of the day after the open run
            state.setTimeoutTimestamp((min([*order[:1], *([end + 1] if length else [])]) + 1) * DAY_MS)
        elif state.exists:
            state.remove()
        found = pd.DataFrame(out, columns=["series", "start", "end", "days", "maximum"])
        for name in ("start", "end"):
            found[name] = [(EPOCH + pd.Timedelta(days=int(d))).date() for d in found[name]]
        yield found

    held = "days array<long>, sums array<double>, counts array<long>, start long, end long, length long, top double"
    return seen.groupBy("series").applyInPandasWithState(advance, SETTLED, held, "append", GroupStateTimeout.EventTimeTimeout)


def runs_up_to(rows: DataFrame, threshold: float, watermark: Column) -> DataFrame:
    """The rows that ``settled_runs`` has given out when its watermark stands at ``watermark``, from all observations at once."""
    days = rows.where(C.finite(F.col("value")).isNotNull()).groupBy("series", F.to_date("ts").alias("date")).agg(F.avg("value").alias("mean"))
    over = F.to_date(watermark)  # days before this one have ended
    above = days.where((F.col("date") < over) & (F.col("mean") > threshold))
    island = F.datediff("date", F.lit("1970-01-01")) - F.row_number().over(Window.partitionBy("series").orderBy("date"))
    runs = above.withColumn("island", island).groupBy("series", "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days"), F.max("mean").alias("maximum"))
    return runs.where(F.date_add("end", 1) < over).drop("island")
