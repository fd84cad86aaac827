"""Temporal features of daily series over trailing windows, for every end date.

``feature_table`` reads a series in two ways.  Sums, moments, extremes and changes are aggregates over window
frames of its rows by day.  Order statistics, trends and spectra are answered from an index of the
series (``functions.windows``), which is one row of two arrays: ``BLOCKS`` tasks take their share of
the end dates each, so the rows exchanged follow the series and not its windows.  A series
has a row a day; it is the unit that a task holds.

``windowed`` sends each observation to the windows that hold it, for features that only rows express.
Calendar gaps are never bridged: changes, runs and correlations use pairs one day apart.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import windows as W

#: Shares of a series' end dates.
BLOCKS = 32
WINDOWS = (7, 15, 30, 90)
#: The window of all dates up to the end date; its days are counted from the series' first date.
ALL = "all"
#: The 48 features by family, fixed names.
FAMILIES = {
    "state": ("mean", "median", "minimum", "maximum", "p10", "p25", "p75", "p90"),
    "magnitude": ("mean_absolute_value", "rms", "positive_load", "negative_load", "positive_accumulation", "negative_accumulation"),
    "variability": ("variance", "standard_deviation", "mad", "iqr", "p90_minus_p10", "coefficient_of_variation"),
    "instability": ("mean_absolute_successive_change", "rmssd", "maximum_absolute_jump", "sign_change_count", "turning_point_count", "proportion_changes_over_threshold"),
    "trend": ("ols_slope", "ols_intercept", "ols_r_squared", "theil_sen_slope", "theil_sen_ci_lower", "theil_sen_ci_upper", "mann_kendall_tau", "mann_kendall_p_value", "initial_final_difference"),
    "persistence": ("lag1_autocorrelation", "decorrelation_time", "longest_run_above_threshold", "mean_run_length_above_threshold", "longest_run_below_threshold", "proportion_above_threshold", "proportion_below_threshold", "state_transition_count"),
    "complexity": ("shannon_entropy", "spectral_variance", "dominant_period", "low_frequency_power_fraction", "high_frequency_power_fraction"),
}


def windowed(series: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``metric, end, days, date, value``: the finite observations of every window that ends on a date of its series."""
    rows = series.where(F.col("value").isNotNull()).select("metric", "date", "value")
    ends = series.select("metric", F.col("date").alias("end")).distinct()
    spans = F.explode(F.array(*[F.struct(F.lit(w).alias("days")) for w in windows]))
    sent = rows.withColumn("s", spans).select("metric", "date", "value", F.col("s.days").alias("days"))
    sent = sent.select("metric", "date", "value", "days", F.explode(F.sequence("date", F.date_add("date", F.col("days") - 1))).alias("end"))
    return sent.join(ends, ["metric", "end"])


def simple_features(rows: DataFrame, *, change_threshold: float = 0.5, level: float = 0.0) -> DataFrame:
    """All features that aggregates and windows express, one wide row per (metric, end, days)."""
    key = ["metric", "end", "days"]
    order = Window.partitionBy(*key).orderBy("date")
    v = F.col("value")
    lag = lambda k: F.when(F.datediff("date", F.lag("date", k).over(order)) == k, F.lag("value", k).over(order))
    # two days before only if the day before is there too: then both pairs are one day apart
    rows = rows.withColumn("p", lag(1)).withColumn("pp", F.when(F.col("p").isNotNull(), lag(2)))
    above, was_above = v > level, F.col("p") > level
    step, step_before = v - F.col("p"), F.col("p") - F.col("pp")
    for name, state in (("a", above), ("b", v < level)):
        new = state & ~F.coalesce((F.col("p") > level) if name == "a" else (F.col("p") < level), F.lit(False))
        rows = rows.withColumn(f"run_{name}", F.when(state, F.sum(new.cast("int")).over(order)))
    sized = rows
    for name in ("a", "b"):
        sized = sized.withColumn(f"size_{name}", F.when(F.col(f"run_{name}").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(*key, f"run_{name}"))))
    low, high = F.min("value").over(Window.partitionBy(*key)), F.max("value").over(Window.partitionBy(*key))
    sized = sized.withColumn("t", F.datediff("date", F.min("date").over(Window.partitionBy(*key))).cast("double"))
    sized = sized.withColumn("bin", F.when(high > low, F.least(F.floor((v - low) / (high - low) * 10), F.lit(9))).otherwise(F.lit(5)))
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    pairs = F.count("p")
    wide = sized.groupBy(*key).agg(
        F.count("value").alias("n"), pairs.alias("pairs"), F.avg(v).alias("mean"), q.alias("q"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        F.avg(F.abs(v)).alias("mean_absolute_value"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg(F.greatest(v, F.lit(0.0))).alias("positive_load"), F.avg(F.greatest(-v, F.lit(0.0))).alias("negative_load"),
        F.sum(F.greatest(v, F.lit(0.0))).alias("positive_accumulation"), F.sum(F.greatest(-v, F.lit(0.0))).alias("negative_accumulation"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("standard_deviation"),
        F.avg(F.abs(step)).alias("mean_absolute_successive_change"), F.sqrt(F.avg(step * step)).alias("rmssd"), F.max(F.abs(step)).alias("maximum_absolute_jump"),
        F.when(pairs > 0, F.count_if((F.signum(v) * F.signum("p")) == -1)).cast("double").alias("sign_change_count"), F.when(pairs > 0, F.count_if(step * step_before < 0)).cast("double").alias("turning_point_count"),
        (F.count_if(F.abs(step) > change_threshold) / F.nullif(pairs, F.lit(0))).alias("proportion_changes_over_threshold"),
        F.regr_slope(v, F.col("t")).alias("ols_slope"), F.regr_intercept(v, F.col("t")).alias("ols_intercept"), F.regr_r2(v, F.col("t")).alias("ols_r_squared"), (F.max_by("value", "date") - F.min_by("value", "date")).alias("initial_final_difference"),
        F.when((pairs >= 2) & (F.stddev_pop(F.when(F.col("p").isNotNull(), v)) > 0) & (F.stddev_pop("p") > 0), F.corr("value", "p")).alias("lag1_autocorrelation"),
        F.coalesce(F.max("size_a"), F.lit(0)).cast("double").alias("longest_run_above_threshold"), F.coalesce(F.count("run_a") / F.nullif(F.countDistinct("run_a"), F.lit(0)), F.lit(0.0)).alias("mean_run_length_above_threshold"),
        F.coalesce(F.max("size_b"), F.lit(0)).cast("double").alias("longest_run_below_threshold"), F.avg(above.cast("double")).alias("proportion_above_threshold"), F.avg((v < level).cast("double")).alias("proportion_below_threshold"),
        F.count_if(above != was_above).cast("double").alias("state_transition_count"),
    )
    bins = sized.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("c")).withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(*key)))
    entropy = bins.groupBy(*key).agg((-F.sum(F.col("share") * F.log2("share")) + 0.0).alias("shannon_entropy"))
    wide = wide.select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p25", "median", "p75", "p90"))]).drop("q")
    mad = sized.join(wide.select(*key, "median"), key).groupBy(*key).agg(F.percentile(F.abs(v - F.col("median")), 0.5).alias("mad"))
    r = F.col("lag1_autocorrelation")  # two pairs correlate fully, but for rounding
    wide = wide.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("p90_minus_p10", F.col("p90") - F.col("p10")).withColumn("decorrelation_time", F.when((r > 0) & (r < 1 - 1e-9), -1.0 / F.ln(r)))
    return wide.join(entropy, key).join(mad, key)


def theil_sen(rows: DataFrame) -> DataFrame:
    """Median of the pairwise slopes and Kendall's tau-b of each window: pairs of one window's days."""
    key = ["metric", "end", "days"]
    a = rows.select(*key, F.col("date").alias("d1"), F.col("value").alias("v1"))
    b = rows.select(*key, F.col("date").alias("d2"), F.col("value").alias("v2"))
    pairs = a.join(b, key).where("d2 > d1")
    rise = F.col("v2") - F.col("v1")
    ties = F.count_if(rise == 0)
    total = F.count(F.lit(1))
    return pairs.groupBy(*key).agg(F.percentile(rise / F.datediff("d2", "d1"), 0.5).alias("theil_sen_slope"), (F.sum(F.signum(rise)) / F.nullif(F.sqrt((total - ties).cast("double") * total), F.lit(0.0))).alias("mann_kendall_tau"))


def spectrum(values: np.ndarray) -> tuple[float, float, float, float]:
    """Variance, dominant period, and shares of power up to and beyond 0.1 cycles a day."""
    n = len(values)
    power = np.abs(np.fft.rfft(values - values.mean())) ** 2
    power[1:] *= 2
    if n % 2 == 0:
        power[-1] /= 2
    frequency = np.fft.rfftfreq(n)
    total = power[1:].sum()
    slow = power[1:][frequency[1:] <= 0.1].sum()
    return power.sum() / n**2, 1 / frequency[1:][np.argmax(power[1:])], slow / total, (total - slow) / total


#: Days, ``ALL``, or a period of first and last date, which ends at the end date if that is earlier.
Span = int | str | tuple[datetime.date, datetime.date]


def framed(series: DataFrame, spans: tuple[Span, ...], *, change_threshold: float = 0.5, level: float = 0.0) -> DataFrame:
    """``metric, end, span`` and what aggregates over frames of a series' rows express, for every window at every date.

    All frames are one pass over the rows of a series in order; a period is a frame in which other days have no value.
    """
    own = Window.partitionBy("metric").orderBy("day")
    first = F.min("date").over(Window.partitionBy("metric"))
    rows = series.withColumns({"day": F.unix_date("date"), "first": first})
    parts: list[Column] = []
    entries: list[Column] = []
    for k, span in enumerate(spans):
        name = lambda c, k=k: f"{c}__{k}"
        value = F.when(F.col("date").between(*map(F.lit, span)), F.col("value")) if isinstance(span, tuple) else F.col("value")
        rows = rows.withColumn(name("v"), value)
        v = F.col(name("v"))
        lag = lambda back, v=v: F.when(F.col("day") - F.lag("day", back).over(own) == back, F.lag(v, back).over(own))
        rows = rows.withColumn(name("p"), F.when(v.isNotNull(), lag(1)))
        p = F.col(name("p"))
        rows = rows.withColumns({name("pp"): F.when(p.isNotNull(), lag(2)), name("t"): F.when(v.isNotNull(), F.datediff("date", "first").cast("double"))})
        t, step = F.col(name("t")), v - p
        # days of the window that can't end a change (1) or a turn (2) are left out of the frame
        whole, change, turn = (own.rangeBetween(min(lost + 1 - span, 0), 0) if isinstance(span, int) else own.rowsBetween(Window.unboundedPreceding, 0) for lost in range(3))
        room = lambda lost, c, span=span: c if not isinstance(span, int) or span > lost else F.lit(None)
        raw = {
            "n": F.count(v).over(whole), "mean": F.avg(v).over(whole), "minimum": F.min(v).over(whole), "maximum": F.max(v).over(whole), "mean_absolute_value": F.avg(F.abs(v)).over(whole), "square": F.avg(v * v).over(whole),
            "positive_load": F.avg(F.greatest(v, v * 0)).over(whole), "negative_load": F.avg(F.greatest(-v, v * 0)).over(whole), "positive_accumulation": F.sum(F.greatest(v, v * 0)).over(whole), "negative_accumulation": F.sum(F.greatest(-v, v * 0)).over(whole),
            "variance": F.var_pop(v).over(whole), "standard_deviation": F.stddev_pop(v).over(whole), "ols_slope": F.regr_slope(v, t).over(whole), "intercept": F.regr_intercept(v, t).over(whole), "ols_r_squared": F.regr_r2(v, t).over(whole), "t0": F.min(t).over(whole),
            "initial_final_difference": F.last(v, True).over(whole) - F.first(v, True).over(whole), "proportion_above_threshold": F.avg((v > level).cast("double")).over(whole), "proportion_below_threshold": F.avg((v < level).cast("double")).over(whole),
            "some_pairs": F.count(p).over(change), "mean_absolute_successive_change": F.avg(F.abs(step)).over(change), "square_change": F.avg(step * step).over(change), "maximum_absolute_jump": F.max(F.abs(step)).over(change),
            "changes_of_sign": F.count_if((F.signum(v) * F.signum(p)) == -1).over(change), "large": F.count_if(F.abs(step) > change_threshold).over(change), "transitions": F.count_if((v > level) != (p > level)).over(change),
            "turns": F.count_if(step * (p - F.col(name("pp"))) < 0).over(turn), "deviation": F.least(F.stddev_pop(F.when(p.isNotNull(), v)).over(change), F.stddev_pop(p).over(change)), "correlation": F.corr(v, p).over(change),
        }
        parts += [c.alias(name(n)) for n, c in raw.items()]
        at = lambda n, name=name: F.col(name(n))
        pairs = F.coalesce(room(1, at("some_pairs")), F.lit(0)).cast("long")
        paired = lambda c, pairs=pairs: F.when(pairs > 0, c.cast("double"))
        same = ("n", "mean", "minimum", "maximum", "mean_absolute_value", "positive_load", "negative_load", "positive_accumulation", "negative_accumulation", "variance", "standard_deviation", "ols_slope", "ols_r_squared", "initial_final_difference", "proportion_above_threshold", "proportion_below_threshold")
        entry = {n: at(n) for n in same} | {n: paired(at(n)) for n in ("mean_absolute_successive_change", "maximum_absolute_jump")}
        entry |= {
            "pairs": pairs, "rms": F.sqrt(at("square")), "ols_intercept": at("intercept") + at("ols_slope") * at("t0"), "rmssd": F.sqrt(paired(at("square_change"))), "sign_change_count": paired(at("changes_of_sign")),
            "turning_point_count": paired(F.coalesce(room(2, at("turns")), F.lit(0))), "proportion_changes_over_threshold": paired(at("large")) / pairs, "state_transition_count": F.coalesce(room(1, at("transitions")), F.lit(0)).cast("double"),
            "lag1_autocorrelation": F.when((pairs >= 2) & (at("deviation") > 0), at("correlation")),
        }
        start, stop = (F.lit(span[0]), F.least("date", F.lit(span[1]))) if isinstance(span, tuple) else (F.col("first") if span == ALL else F.date_sub("date", span - 1), F.col("date"))
        entry |= {"start": start, "stop": stop, "days": F.datediff(stop, start) + 1}
        entries.append(F.struct(F.lit(k).alias("span"), *[c.alias(n) for n, c in sorted(entry.items())]))
    kept = ["metric", "date", "first", *(c for c in ("wanted",) if c in series.columns)]
    wide = rows.select(*kept, *parts)
    if "wanted" in kept:
        wide = wide.where("wanted")
    out = wide.select("metric", F.col("date").alias("end"), F.inline(F.array(*entries)))
    r = F.col("lag1_autocorrelation")  # two pairs correlate fully, but for rounding
    return out.withColumn("decorrelation_time", F.when((r > 0) & (r < 1 - 1e-9), -1.0 / F.ln(r)))


#: What ``indexed`` gives beside the key.
INDEXED = ("p10", "p25", "median", "p75", "p90", "mad", "shannon_entropy", "theil_sen_slope", "theil_sen_ci_lower", "theil_sen_ci_upper", "mann_kendall_tau", "mann_kendall_p_value", "longest_run_above_threshold", "mean_run_length_above_threshold", "longest_run_below_threshold", *FAMILIES["complexity"][1:])


def indexed(series: DataFrame, spans: tuple[Span, ...], *, level: float = 0.0, spectral_minimum: int = 30) -> DataFrame:
    """``metric, end, span`` (its place in ``spans``) and order statistics, trend, runs and spectrum of each window with an observation."""
    wanted = F.col("wanted") if "wanted" in series.columns else F.lit(True)
    day = F.struct(F.unix_date("date").alias("day"), F.col("value").cast("double").alias("value"), wanted.alias("wanted"))
    arrays = series.groupBy("metric").agg(F.array_sort(F.collect_list(day)).alias("s")).select("metric", "s.day", "s.value", "s.wanted")
    dealt = arrays.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    dealt = dealt.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # in turn: blocks cost alike
    epoch = datetime.date(1970, 1, 1)
    limits = tuple(tuple((d - epoch).days for d in x) if isinstance(x, tuple) else x for x in spans)
    fields = "metric string, day int, span int, " + ", ".join(f"{n} double" for n in INDEXED)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for metric, days, values, asked, block in zip(batch["metric"], batch["day"], batch["value"], batch["wanted"], batch["block"], strict=True):
                found = _windows_of(np.asarray(days, np.int64), np.array([np.nan if x is None else x for x in values], float), np.asarray(asked, bool), int(block), limits, level, spectral_minimum)
                yield pd.DataFrame({"metric": metric, **found}, columns=["metric", "day", "span", *INDEXED])

    rows = dealt.mapInPandas(each, fields)
    return rows.select("metric", F.date_from_unix_date("day").alias("end"), "span", *[F.nanvl(n, F.lit(None)).alias(n) for n in INDEXED])


def _windows_of(days: np.ndarray, values: np.ndarray, asked: np.ndarray, block: int, spans: tuple, level: float, spectral_minimum: int) -> dict[str, np.ndarray]:
    """One block's end dates of one series."""
    ends = days[asked][block::BLOCKS]
    finite = np.isfinite(values)
    t, v = days[finite], values[finite]
    consecutive = np.diff(t, prepend=t[:1] - 2) == 1
    states = (v > level, v < level)
    starts = [s & ~(consecutive & np.concatenate([[False], s[:-1]])) for s in states]
    place = np.arange(len(v))
    lengths = [np.where(s, place - np.maximum.accumulate(np.where(begins, place, -1)) + 1, 0) for s, begins in zip(states, starts, strict=True)]
    ranks = W.Ranks(v) if len(v) else None
    columns: dict[str, list[np.ndarray]] = {n: [] for n in ("day", "span", *INDEXED)}
    for number, span in enumerate(spans):
        low = np.full(len(ends), span[0]) if isinstance(span, tuple) else np.full(len(ends), days[0]) if span == ALL else ends - span + 1
        high = np.minimum(ends, span[1]) if isinstance(span, tuple) else ends
        lo, hi = np.searchsorted(t, low), np.searchsorted(t, high, "right")
        some = hi > lo
        lo, hi, n = lo[some], hi[some], (hi - lo)[some]
        if not len(lo):
            continue
        own = {"day": ends[some], "span": np.full(len(lo), number), "mad": ranks.mad(lo, hi), "shannon_entropy": ranks.entropy(lo, hi)}
        own |= {name: ranks.quantile(lo, hi, q) for name, q in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))}
        rising = W.concordance(ranks, v, lo, hi)
        tied, terms = W.ties(v, lo, hi)
        pairs = n * (n - 1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            own["mann_kendall_tau"] = rising / np.sqrt((pairs - tied).astype(float) * pairs)
        own["mann_kendall_p_value"] = np.array([W.kendall_p(*x) for x in zip(rising.tolist(), n.tolist(), tied.tolist(), terms.tolist(), strict=True)])
        rest = np.full((10, len(lo)), np.nan)
        for k, (a, b, m, d) in enumerate(zip(lo.tolist(), hi.tolist(), n.tolist(), (high - low + 1)[some].tolist(), strict=True)):
            if m > 2:
                slopes = W.Slopes(t[a:b].astype(float), v[a:b])
                rest[0, k] = (slopes.at((slopes.pairs - 1) // 2) + slopes.at(slopes.pairs // 2)) / 2
                if places := W.slope_places(m, int(terms[k]), W.NORMAL_95):
                    rest[1:3, k] = slopes.at(places[0]), slopes.at(places[1])
            for row, kind in ((3, 0), (5, 1)):
                rest[row, k] = np.minimum(lengths[kind][a:b], place[: b - a] + 1).max()
            begun = int(starts[0][a + 1 : b].sum()) + int(states[0][a])
            rest[4, k] = states[0][a:b].sum() / begun if begun else 0.0
            if m == d and m >= spectral_minimum and v[a:b].min() < v[a:b].max():
                rest[6:, k] = spectrum(v[a:b])
        own |= dict(zip(("theil_sen_slope", "theil_sen_ci_lower", "theil_sen_ci_upper", "longest_run_above_threshold", "mean_run_length_above_threshold", "longest_run_below_threshold", *FAMILIES["complexity"][1:]), rest, strict=True))
        for name, column in own.items():
            columns[name].append(column)
    return {name: np.concatenate(c) if c else np.zeros(0) for name, c in columns.items()}


def wide_features(series: DataFrame, *, windows: tuple[Span, ...] = WINDOWS, change_threshold: float = 0.5, level: float = 0.0) -> DataFrame:
    """One row per metric, end date and window (``span``: its place in ``windows``) with all features but the coefficient of variation.

    ``series``: ``metric``, ``date`` (once per metric) and ``value``; with a boolean column ``wanted``, only its dates are end dates.
    """
    rows = framed(series, windows, change_threshold=change_threshold, level=level)
    wide = rows.join(indexed(series, windows, level=level), ["metric", "end", "span"], "left")
    return wide.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("p90_minus_p10", F.col("p90") - F.col("p10"))


def feature_table(series: DataFrame, *, windows: tuple[Span, ...] = WINDOWS, minimum: int = 5, unit: str = "1", change_threshold: float = 0.5, level: float = 0.0, coefficient_of_variation_valid: bool = False) -> DataFrame:
    """The long table of 48 features per metric, end date and window (days, ``ALL``, or a period), with status and reason.

    ``coefficient_of_variation_valid``: the values have a true zero, so the coefficient of variation is given.
    """
    return _long(wide_features(series, windows=windows, change_threshold=change_threshold, level=level), minimum, unit, coefficient_of_variation_valid)


def _long(wide: DataFrame, minimum: int, unit: str, with_variation: bool) -> DataFrame:
    n = F.coalesce("n", F.lit(0))
    # a mean of zero is one within 1e-8
    variation = F.when(F.lit(with_variation) & (F.abs("mean") > 1e-8), F.col("standard_deviation") / F.abs("mean"))
    entries = []
    for family, names in FAMILIES.items():
        for name in names:
            few = (n < minimum) | (F.lit(family == "trend") & (n < max(3, minimum)))
            value = F.when(~few, variation if name == "coefficient_of_variation" else F.col(name))
            cover = F.coalesce("pairs", F.lit(0)) / F.greatest(F.lit(1), F.col("days") - 1) if family == "instability" else n / F.greatest(F.lit(1), F.col("days"))
            reason = F.when(few, F.format_string(f"Only %d finite observations; minimum is {minimum}", n)).when(value.isNull(), _missing_reason(family, name))
            own = _unit(family, name, unit)
            entries.append(F.struct(F.lit(family).alias("family"), F.lit(name).alias("metric"), value.alias("value"), F.lit(own).alias("unit"), F.when(value.isNull(), "not_calculated").otherwise("valid").alias("status"), reason.alias("reason"), (F.coalesce("pairs", F.lit(0)) if family == "instability" else n).alias("n_observations"), cover.alias("valid_coverage")))
    long = wide.select(F.col("metric").alias("source_metric"), "end", "start", "stop", "days", F.explode(F.array(*entries)).alias("e"))
    return long.select(F.col("end").alias("analysis_end_date"), F.col("start").alias("window_start_date"), F.col("stop").alias("window_end_date"), F.col("days").alias("window_days"), "source_metric", "e.family", "e.metric", "e.value", "e.unit", "e.status", "e.reason", "e.n_observations", "e.valid_coverage")


def _missing_reason(family: str, name: str) -> str:
    special = {
        "coefficient_of_variation": "Coefficient of variation is invalid for this scale or a zero mean",
        "lag1_autocorrelation": "Lag-1 autocorrelation is invalid",
        "decorrelation_time": "Decorrelation time requires lag-1 autocorrelation strictly between 0 and 1",
    }
    general = {
        "instability": "No consecutive finite daily pairs; temporal gaps are not bridged",
        "trend": "Insufficient distinct temporal observations for trend",
        "complexity": "Spectral features require regular, finite, non-constant sampling with sufficient observations",
    }
    return special.get(name) or general.get(family, "The value is undefined")


def _unit(family: str, name: str, unit: str) -> str:
    if name.endswith("_count"):
        return "count"
    if name in ("ols_slope", "theil_sen_slope", "theil_sen_ci_lower", "theil_sen_ci_upper"):
        return f"{unit} per day"
    if name in ("variance", "spectral_variance"):
        return f"{unit} squared"
    if name in ("decorrelation_time", "dominant_period") or "run" in name:
        return "days"
    if name == "shannon_entropy":
        return "bits"
    dimensionless = name.startswith("proportion") or name.endswith("_fraction") or name in ("ols_r_squared", "mann_kendall_tau", "mann_kendall_p_value", "coefficient_of_variation", "lag1_autocorrelation")
    return "1" if dimensionless else unit


def runs(series: DataFrame, condition: Column, keys: list[str] = []) -> DataFrame:
    """Lengths of the runs of consecutive days on which the condition holds."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    rows = series.withColumn("on", F.coalesce(condition, F.lit(False))).withColumn("gap", F.coalesce(F.datediff("date", F.lag("date").over(order)) != 1, F.lit(True)))
    start = F.col("on") & (F.col("gap") | ~F.coalesce(F.lag("on").over(order), F.lit(False)))
    rows = rows.withColumn("start", start).withColumn("run", F.sum(F.col("start").cast("int")).over(order)).where("on")
    return rows.groupBy(*keys, "run").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("length"))
