"""Operators on daily series of charts: gap filling, alignment, denormalising, and what a chart of a cycle shows.

Series are long: (id, series, day, value, present); all windows of one operator share one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clip, half_up
from tidemark.sources.readings import DAYS

#: Longest gap that is filled, axis ranges by scale and of LH, presence threshold.
MAX_GAP = 3
SCALES = (("celsius", 35.6, 37.4), ("fahrenheit", 95.0, 99.5))
LH_RANGE = (0.1, 1.9)
PRESENCE = 0.5


def interpolate(series: DataFrame, keys: tuple[str, ...] = ("id", "series"), max_gap: int = MAX_GAP) -> DataFrame:
    """Fills gaps of up to max_gap days between two measured days along a line. `value` is overwritten and `interpolated`
    marks filled days; `present` stays as it is, and nothing is filled before the first or after the last measured day."""
    w = Window.partitionBy(*keys).orderBy("day")
    here = F.when(F.col("present") > PRESENCE, F.struct("day", "value"))
    before = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(here, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = series.withColumn("_b", before).withColumn("_a", after)
    gap = F.col("_a.day") - F.col("_b.day") - 1
    fill = F.coalesce((F.col("present") <= PRESENCE) & gap.between(1, max_gap), F.lit(False))
    t = (F.col("day") - F.col("_b.day")) / (F.col("_a.day") - F.col("_b.day"))
    line = F.col("_b.value") * (1.0 - t) + F.col("_a.value") * t
    return out.withColumn("value", F.when(fill, line).otherwise(F.col("value"))).withColumn("interpolated", fill.cast("int")).drop("_a", "_b")


def left_pack(series: DataFrame, key: str = "id") -> DataFrame:
    """Shifts both series of a chart so that its first present day becomes day 0."""
    first = F.min(F.when(F.col("present") > PRESENCE, F.col("day"))).over(Window.partitionBy(key))
    return series.withColumn("day", F.col("day") - F.coalesce(first, F.lit(0)))


def denormalise(series: DataFrame, low: Column, high: Column) -> DataFrame:
    """Values between 0 and 1 to axis units, temperatures to 0.01 and LH to 0.1, null where not present."""
    real = low + F.col("value") * (high - low)
    rounded = F.when(F.col("series") == "temp", half_up(real, 2)).otherwise(half_up(real, 1))
    return series.withColumn("value", F.when(F.col("present") > PRESENCE, rounded))


def collapse(series: DataFrame, keys: tuple[str, ...] = ("id", "series")) -> DataFrame:
    """Present days moved to consecutive days from 1, in order."""
    w = Window.partitionBy(*keys).orderBy("day")
    return series.where(F.col("present") > PRESENCE).withColumn("day", F.row_number().over(w))


def normalise(value: Column, low: Column, high: Column) -> Column:
    """Axis units to a place between 0 and 1."""
    return clip((value - low) / F.greatest(F.lit(1e-6), high - low), 0.0, 1.0)


def chart_range(days: DataFrame, unit: float = 1.0) -> DataFrame:
    """The temperature axis of a cycle's chart: a tenth of a degree beyond the data, on tenths, half a degree at least.
    In whole hundredths (unit 100) the tenths are exact."""
    tenth = 0.1 * unit
    lo = F.floor((F.min("temp") - F.lit(tenth)) / tenth) * tenth
    hi = F.ceil((F.max("temp") + F.lit(tenth)) / tenth) * tenth
    g = days.groupBy("cycle_id").agg(lo.alias("lo"), hi.alias("hi"))
    lo, hi = F.coalesce(F.col("lo"), F.lit(36.0 * unit)), F.coalesce(F.col("hi"), F.lit(37.2 * unit))
    return g.select("cycle_id", lo.cast("double").alias("y_low"), F.when(hi - lo < 0.5 * unit, lo + 0.5 * unit).otherwise(hi).cast("double").alias("y_high"))


def chart_segments(days: DataFrame) -> DataFrame:
    """Line segments of a chart: between consecutive measured days only, with the phase of the later one."""
    w = Window.partitionBy("cycle_id").orderBy("day")
    phase = F.when(F.col("day") > F.col("ov"), "luteal").otherwise("follicular")
    out = days.withColumn("from_temp", F.lag("temp").over(w)).where(F.col("temp").isNotNull() & F.col("from_temp").isNotNull())
    return out.select("cycle_id", (F.col("day") - 1).alias("from_day"), "day", "from_temp", "temp", phase.alias("phase"))


def ovulation_band(ov: Column) -> Column:
    """First and last day of the band around ovulation."""
    return F.when(ov >= 1, F.struct(F.greatest(F.lit(1), ov - 1).alias("low"), F.least(F.lit(DAYS), ov + 1).alias("high")))


def lh_bars(days: DataFrame, unit: float = 1.0) -> DataFrame:
    """Bars of LH: height as a share of the plot and whether the bar is strong."""
    top = F.greatest(F.lit(1.0 * unit), F.max("lh").over(Window.partitionBy("cycle_id")))
    out = days.withColumn("_top", top).where(F.col("lh").isNotNull())
    strong = F.col("lh") >= F.greatest(F.lit(1.3 * unit), F.col("_top") * 0.8)
    return out.select("cycle_id", "day", "lh", (F.col("lh") / F.col("_top") * 0.32).alias("height"), strong.alias("strong"))
