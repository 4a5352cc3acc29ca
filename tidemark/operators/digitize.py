"""Manual chart digitising on a pixel table (image_id, x, y, r, g, b, a) with two reference points an axis.

Pixels are filtered to the curve's colour before anything is joined or grouped; what is left is one point a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import half_up
from tidemark.sources.readings import DAYS

#: Opacity that counts, and the colour used where none stands out.
OPAQUE = 32
DEFAULT_COLOUR = (214, 68, 127)


def distance(r: Column, g: Column, b: Column, target: Column) -> Column:
    """Euclidean distance of a colour from target.r, .g, .b."""
    dr, dg, db = r - target["r"], g - target["g"], b - target["b"]
    return F.sqrt((dr * dr + dg * dg + db * db).cast("double"))


def axis_value(pixel: Column, p1: Column, v1: Column, p2: Column, v2: Column) -> Column:
    return F.when(p1 == p2, v1).otherwise(v1 + (pixel - p1) / F.nullif(p2 - p1, F.lit(0.0)) * (v2 - v1))


def axis_pixel(value: Column, p1: Column, v1: Column, p2: Column, v2: Column) -> Column:
    return F.when(v1 == v2, p1).otherwise(p1 + (value - v1) / F.nullif(v2 - v1, F.lit(0.0)) * (p2 - p1))


def scan_columns(pixels: DataFrame, calibration: DataFrame, x_low: Column, x_high: Column, y_low: Column, y_high: Column) -> DataFrame:
    """(image_id, series, x, y): the mean height of the curve's pixels in each column of the region."""
    inside = F.col("x").between(F.greatest(F.lit(0), F.floor(x_low)), F.ceil(x_high)) & F.col("y").between(F.greatest(F.lit(0), F.floor(y_low)), F.ceil(y_high))
    hit = (F.col("a") >= OPAQUE) & inside & (distance(F.col("r"), F.col("g"), F.col("b"), F.col("target")) <= F.col("tolerance"))
    return pixels.where(F.col("a") >= OPAQUE).join(calibration, "image_id").where(hit).groupBy("image_id", "series", "x").agg(F.avg("y").alias("y"))


def _half_window(day_axis: list[Column]) -> Column:
    """Half a day in pixels, one pixel at least."""
    per_day = F.abs(axis_pixel(F.lit(2.0), *day_axis) - axis_pixel(F.lit(1.0), *day_axis))
    return F.greatest(F.lit(1.0), per_day / 2)


def resample(points: DataFrame, calibration: DataFrame, days: int = DAYS) -> DataFrame:
    """(image_id, series, day, value): for each day the upper median height of the points within half a day of its place,
    on the value axis; null where no point is near. A point can serve two days.

    The range join is an equi-join: a point goes to the few days whose window can hold it."""
    day_axis = [F.col(c) for c in ("day_px1", "day_v1", "day_px2", "day_v2")]
    value_axis = [F.col(c) for c in ("val_px1", "val_v1", "val_px2", "val_v2")]
    at = axis_value(F.col("x").cast("double"), *day_axis)
    reach = F.greatest(F.lit(1.0), F.ceil(F.abs(axis_value(F.col("x") + _half_window(day_axis), *day_axis) - at))).cast("int")
    near = points.join(calibration, ["image_id", "series"])
    near = near.withColumn("day", F.explode(F.sequence(F.greatest(F.lit(1), (F.floor(at) - reach).cast("int")), F.least(F.lit(days), (F.ceil(at) + reach).cast("int")))))
    near = near.where(F.abs(F.col("x") - axis_pixel(F.col("day").cast("double"), *day_axis)) <= _half_window(day_axis))
    found = near.groupBy("image_id", "series", "day").agg(F.sort_array(F.collect_list("y")).alias("ys"))
    median = F.get("ys", F.floor(F.size("ys") / 2).cast("int"))
    spine = calibration.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    value = axis_value(median, *value_axis)
    value = F.when(F.col("series") == "temp", half_up(value, 2)).otherwise(half_up(value, 1))
    return spine.join(found, ["image_id", "series", "day"], "left").select("image_id", "series", "day", value.alias("value"))


def plot_guess(width: Column, height: Column) -> Column:
    """A first guess of the plot: a tenth of the width and 8 % of the height are margin."""
    mx, my = half_up(width * F.lit(0.1)).cast("int"), half_up(height * F.lit(0.08)).cast("int")
    return F.struct(mx.alias("x0"), my.alias("y0"), (width - mx).alias("x1"), (height - my).alias("y1"))


def suggest_colour(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """(image_id, r, g, b): the first colour of the group that is frequent and saturated, among every second pixel of the
    region; white, black and grey are left out. Images without one get the default."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    sat = F.when(top == 0, 0.0).otherwise((top - low) / F.greatest(top, F.lit(1)))
    seen = pixels.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1) & ((F.col("x") - x0) % 2 == 0) & ((F.col("y") - y0) % 2 == 0))
    seen = seen.where((F.col("a") >= OPAQUE) & ~((top > 235) & (low > 215)) & (top >= 40) & (sat >= 0.18)).withColumn("sat", sat)
    first = F.min(F.struct("y", "x", "r", "g", "b", "sat"))
    groups = seen.groupBy("image_id", F.shiftright("r", 5).alias("qr"), F.shiftright("g", 5).alias("qg"), F.shiftright("b", 5).alias("qb")).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    score = F.col("n") * (0.5 + F.col("first.sat"))
    best = groups.groupBy("image_id").agg(F.max_by("first", F.struct(score, -F.col("first.y"), -F.col("first.x"))).alias("c"))
    images = pixels.select("image_id").distinct().join(best, "image_id", "left")
    return images.select("image_id", *[F.coalesce(F.col(f"c.{k}"), F.lit(v)).cast("int").alias(k) for k, v in zip("rgb", DEFAULT_COLOUR)])
