"""Readings: one row (cycle_id, day 1..35, temp, lh) for a day of a cycle; null where nothing was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import clean, parse_number

DAYS = 35
#: First day of the events that stand in for cycles.
EPOCH = "2024-01-01"


def from_events(events: DataFrame) -> DataFrame:
    """Readings in whole hundredths from an event log: one cycle a user, the day's latest event of a kind is its reading.

    One shuffle with partial aggregation by user and day."""
    v = F.round(F.col("value") * 100).cast("long")
    day = (F.datediff(F.col("ts"), F.lit(EPOCH)) + 1).cast("int")
    keyed = events.select(
        F.col("user_id").alias("cycle_id"),
        day.alias("day"),
        F.when(F.col("event_type").isin("view", "click", "signup"), F.col("event_id") * 1000 + v % 100).alias("tk"),
        F.when(F.col("event_type").isin("purchase", "error"), F.col("event_id") * 1000 + v % 300).alias("lk"),
    ).where(F.col("day").between(1, DAYS))
    daily = keyed.groupBy("cycle_id", "day").agg(F.max("tk").alias("tk"), F.max("lk").alias("lk"))
    rise = F.when((F.col("cycle_id") % 5 != 4) & (F.col("day") > 11 + F.col("cycle_id") % 7), 22 + (F.col("cycle_id") % 4) * 6).otherwise(0)
    temp = 3620 + (F.col("tk") % 1000) % 18 + rise
    lh = (F.col("lk") % 1000) % 300
    return daily.select("cycle_id", "day", temp.cast("double").alias("temp"), lh.cast("double").alias("lh"))


def from_arrays(cycles: DataFrame, temps: str = "temps", lh: str = "lh", key: str = "cycle_id") -> DataFrame:
    """Readings from one row a cycle with two arrays; longer arrays are cut at 35 days, NaN counts as missing."""
    days = F.sequence(F.lit(1), F.lit(DAYS))
    out = cycles.select(key, F.explode(days).alias("day"), F.col(temps).alias("_t"), F.col(lh).alias("_l"))
    return out.select(key, "day", clean(F.get("_t", F.col("day") - 1)).alias("temp"), clean(F.get("_l", F.col("day") - 1)).alias("lh"))


def from_form(fields: DataFrame) -> DataFrame:
    """Readings from form fields (cycle_id, day, temp_text, lh_text)."""
    return fields.select("cycle_id", "day", parse_number(F.col("temp_text")).alias("temp"), parse_number(F.col("lh_text")).alias("lh"))


def demo(spark) -> DataFrame:
    """The demonstration cycle."""
    # 28 temperatures from day 1, LH on days 13 to 15.
    temps = [
        36.4, 36.35, 36.42, 36.38, 36.41, 36.37, 36.4, 36.36, 36.39, 36.35, 36.41, 36.34, 36.3, 36.28,
        36.55, 36.72, 36.78, 36.8, 36.79, 36.82, 36.81, 36.83, 36.8, 36.79, 36.81, 36.78, 36.77, 36.62,
    ]
    lh = {13: 1.1, 14: 2.6, 15: 1.4}
    rows = [(0, d, float(temps[d - 1]) if d <= len(temps) else None, lh.get(d)) for d in range(1, DAYS + 1)]
    return spark.createDataFrame(rows, "cycle_id long, day int, temp double, lh double")


def spine(readings: DataFrame) -> DataFrame:
    """All 35 days of every cycle, with the cycle's median LH beside: one shuffle by cycle, which all windows and
    aggregates over a cycle then share. A cycle has at most 35 readings, so the collected list is small;
    of several readings for a day the largest counts."""
    packed = readings.where(F.col("day").between(1, DAYS)).groupBy("cycle_id").agg(
        F.collect_list(F.struct("day", "temp", "lh")).alias("_r"), F.median("lh").alias("lh_median")
    )
    days = packed.select("cycle_id", "lh_median", F.explode(F.sequence(F.lit(1), F.lit(DAYS))).alias("day"), "_r")
    own = F.filter("_r", lambda r: r["day"] == F.col("day"))
    return days.select(
        "cycle_id",
        "day",
        F.array_max(F.transform(own, lambda r: r["temp"])).alias("temp"),
        F.array_max(F.transform(own, lambda r: r["lh"])).alias("lh"),
        "lh_median",
    )
