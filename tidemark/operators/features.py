"""The thirty features of a cycle, from its 35 days, with windows and one aggregation.

All windows share the partitioning by cycle that the spine has, so a corpus of cycles is shuffled once. Units
are a parameter: `unit` is 1.0 for degrees and relative LH, 100.0 for whole hundredths, in which all
comparisons are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_float32
from tidemark.sources.readings import DAYS, spine

#: The features in their order.
FEATURES = (
    "n_temp_observed n_lh_observed missing_rate_temp missing_rate_lh temp_mean_overall temp_std_overall temp_min temp_max "
    "temp_range estimated_ovulation_day follicular_mean follicular_std luteal_mean luteal_std thermal_rise_amplitude "
    "rise_steepness_max plateau_days_above_baseline n_consecutive_high_days post_rise_dip_count lh_peak_day lh_peak_value "
    "lh_peak_count days_lh_peak_to_thermal_rise follicular_length luteal_length spline_slope_pre_ovulation "
    "spline_slope_post_ovulation fraction_days_below_mean longest_run_above_mean longest_run_below_mean"
).split()
#: The rise of the third day over the six days before, and what counts as a high day or an LH peak.
RISE, HIGH, PEAK, PEAK_OVER_MEDIAN = 0.20, 0.15, 1.3, 1.5


def _days():
    return Window.partitionBy("cycle_id").orderBy("day")


def _cycle():
    return Window.partitionBy("cycle_id")


def run_length(flag: Column) -> Column:
    """How many days in a row, up to this one, flag has held; a missing day ends a run."""
    holds = F.coalesce(flag, F.lit(False))
    return F.when(holds, F.col("day") - F.coalesce(F.last(F.when(~holds, F.col("day")), ignorenulls=True).over(_days().rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))).otherwise(0)


def with_ovulation(days: DataFrame, unit: float = 1.0) -> DataFrame:
    """days plus `ov`, the last day before the thermal rise by the three-over-six rule, null without one.

    The rise starts at the first day after the sixth that, with the two days after it, lies strictly above all of the
    six days before (four of them measured), the third day by at least 0.2 degrees."""
    before = _days().rowsBetween(-6, -1)
    top = F.max("temp").over(before)
    third = F.lead("temp", 2).over(_days())
    starts = (F.count("temp").over(before) >= 4) & (F.col("temp") > top) & (F.lead("temp", 1).over(_days()) > top) & (third > top) & (third - top >= F.lit(RISE * unit)) & (F.col("day") >= 7)
    return days.withColumn("_first", F.when(starts, F.col("day") - 1)).withColumn("ov", F.min("_first").over(_cycle())).drop("_first")


def with_phases(days: DataFrame, unit: float = 1.0) -> DataFrame:
    """days with ovulation plus the phase of each day and the values that days are compared with."""
    end = F.coalesce("ov", F.lit(DAYS))
    low = F.when(F.col("day") <= end, F.col("temp"))
    out = with_ovulation(days, unit)
    out = out.withColumn("luteal", F.coalesce(F.col("day") > F.col("ov"), F.lit(False)))
    out = out.withColumn("base", as_float32(F.coalesce(F.avg(low).over(_cycle()), F.lit(0.0))))
    out = out.withColumn("mean", as_float32(F.coalesce(F.avg("temp").over(_cycle()), F.lit(0.0))))
    out = out.withColumn("low_max", F.coalesce(F.max(F.when(F.col("day") <= F.col("ov"), F.col("temp"))).over(_cycle()), F.lit(0.0)))
    out = out.withColumn("high", F.col("luteal") & (F.col("temp") > F.col("base") + F.lit(HIGH * unit)))
    minus = F.lit(float("-inf"))
    over = F.greatest(F.lit(PEAK * unit), F.col("lh_median") * PEAK_OVER_MEDIAN)
    peak = (F.col("lh") > over) & (F.col("lh") >= F.coalesce(F.lag("lh").over(_days()), minus)) & (F.col("lh") >= F.coalesce(F.lead("lh").over(_days()), minus))
    out = out.withColumn("peak", F.coalesce(peak, F.lit(False)))
    out = out.withColumn("jump", F.lead("temp").over(_days()) - F.col("temp"))
    out = out.withColumn("high_run", run_length(F.col("high")))
    out = out.withColumn("above_run", run_length(F.col("temp") >= F.col("mean")))
    return out.withColumn("below_run", run_length(F.col("temp") < F.col("mean")))


def _zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def features(readings: DataFrame, unit: float = 1.0) -> DataFrame:
    """One row a cycle: cycle_id and the thirty features, 0 where a feature doesn't apply."""
    days = with_phases(spine(readings), unit)
    temp, lh, day, ov = F.col("temp"), F.col("lh"), F.col("day"), F.col("ov")
    low, after = F.when(day <= F.coalesce(ov, F.lit(DAYS)), temp), F.when(F.col("luteal"), temp)
    when_ = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    best = F.max(F.when(F.col("peak"), F.struct(lh.alias("lh"), (-day).alias("d"), day.alias("day"))))
    pre = F.when(F.when(ov.isNull(), day <= 10).otherwise(day.between(ov - 4, ov)), temp)
    post = F.when(F.when(ov.isNull(), day.between(11, 20)).otherwise(day.between(ov + 1, ov + 4)), temp)
    g = days.groupBy("cycle_id").agg(
        F.count(temp).alias("n"), F.count(lh).alias("m"), F.avg(temp).alias("mean"), F.stddev_pop(temp).alias("std"),
        F.min(temp).alias("lo"), F.max(temp).alias("hi"), F.max(ov).alias("ov"),
        F.avg(low).alias("low_mean"), F.stddev_pop(low).alias("low_std"), F.avg(after).alias("after_mean"), F.stddev_pop(after).alias("after_std"),
        F.max(F.when(day.between(F.greatest(F.lit(1), ov - 1), F.least(F.lit(DAYS - 1), ov + 2)), F.col("jump"))).alias("jump"),
        when_(F.col("high")).alias("plateau"), F.max("high_run").alias("high_run"),
        when_(F.col("luteal") & (temp < F.col("low_max"))).alias("dips"),
        best.alias("best"), when_(F.col("peak")).alias("peaks"), F.max(lh).alias("lh_max"), F.count(after).alias("after_n"),
        F.regr_slope(pre, day.cast("double")).alias("pre"), F.regr_slope(post, day.cast("double")).alias("post"),
        when_(temp < F.col("mean")).alias("below"), F.max("above_run").alias("above_run"), F.max("below_run").alias("below_run"),
    )
    ov = F.col("ov")
    if_rise = lambda c: F.when(ov.isNotNull(), _zero(c)).otherwise(0.0)
    values = [
        F.col("n"), F.col("m"), 1 - F.col("n") / DAYS, 1 - F.col("m") / DAYS,
        F.col("mean"), F.col("std"), F.col("lo"), F.col("hi"), F.col("hi") - F.col("lo"),
        ov, F.col("low_mean"), F.col("low_std"), if_rise(F.col("after_mean")), if_rise(F.col("after_std")),
        if_rise(F.greatest(F.lit(0.0), _zero(F.col("after_mean")) - _zero(F.col("low_mean")))),
        if_rise(F.greatest(F.lit(0.0), F.col("jump"))), if_rise(F.col("plateau")), if_rise(F.col("high_run")), if_rise(F.col("dips")),
        F.col("best.day"), F.coalesce(F.col("best.lh"), F.col("lh_max")), F.col("peaks"),
        F.when(ov.isNotNull() & F.col("best").isNotNull(), ov - F.col("best.day")),
        ov, if_rise(F.col("after_n")), F.col("pre"), F.col("post"),
        F.col("below") / F.greatest(F.lit(1), F.col("n")), F.col("above_run"), F.col("below_run"),
    ]
    return g.select("cycle_id", *[_zero(v).alias(name) for v, name in zip(values, FEATURES)])


def to_celsius(temp: Column, scale: Column) -> Column:
    """Degrees Celsius from a reading and its scale name; features are defined in Celsius."""
    return F.when(F.lower(scale) == "fahrenheit", (temp - 32) * 5 / 9).otherwise(temp)
