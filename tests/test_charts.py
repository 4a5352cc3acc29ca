import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import axes, charts, digitize, series, vision

PITCH, LEFT, TOP, BOTTOM = 24, 120, 80, 380
BLUE, ORANGE = (0x95, 0xAE, 0xFF), (0xFF, 0x9E, 0x8D)


def y_of(t):
    return round(TOP + (37.4 - t) / (37.4 - 35.6) * (BOTTOM - TOP))


def chart():
    """A chart with rings of radius 6 for 20 days of temperature and 6 of LH, on a grey background. No line joins them: a line over
    the whole plot would be sampled instead."""
    px = {(x, y): (200, 200, 200) for x in range(0, 700, 1) for y in range(60, 400)}
    temps = [36.3 + 0.02 * (d % 3) + (0.4 if d >= 12 else 0) for d in range(20)]
    lh = {d: (0.3, 0.4, 0.6, 1.6, 0.8, 0.4)[d - 8] for d in range(8, 14)}

    def ring(cx, cy, color):
        for dx in range(-7, 8):
            for dy in range(-7, 8):
                r = math.hypot(dx, dy)
                if r <= 7.5:
                    px[cx + dx, cy + dy] = color if r >= 4.5 else (255, 255, 255)

    for d, t in enumerate(temps):
        ring(LEFT + PITCH * d, y_of(t), BLUE)
    for d, v in lh.items():
        ring(LEFT + PITCH * d, round(TOP + (1.9 - v) / 1.8 * (BOTTOM - TOP)) , ORANGE)
    ticks = [(1, "right", 680.0, float(y_of(37.4 - 0.2 * k)), f"{37.4 - 0.2 * k:.1f}") for k in range(10)]
    ticks += [(1, "left", 20.0, TOP + (BOTTOM - TOP) * k / 9, f"{1.9 - 0.2 * k:.1f}") for k in range(10)]
    ticks[3] = (*ticks[3][:4], "5")
    return [(1, x, y, *c) for (x, y), c in px.items()], ticks, temps, lh


def test_a_drawn_chart_is_read_back(spark):
    raster, ticks, temps, lh = chart()
    days, heads = charts.extract(
        spark.createDataFrame(raster, "image_id long, x int, y int, r int, g int, b int"),
        spark.createDataFrame([(1, 700, 460)], "image_id long, width int, height int"),
        spark.createDataFrame(ticks, "image_id long, side string, cx double, cy double, text string"),
    )
    head = heads.first()
    assert (head.status, head.scale_idx, head.truncated) == ("extracted", 0, False) and head.confidence > 0.6
    got = {(r.series, r.day): 35.6 + r.value * 1.8 if r.series == "temp" else 0.1 + r.value * 1.8 for r in days.where("present = 1").collect()}
    assert len([k for k in got if k[0] == "temp"]) >= 19
    assert all(abs(got["temp", d] - t) <= 0.05 for d, t in enumerate(temps) if ("temp", d) in got)
    assert sum(abs(got.get(("lh", d), 9) - v) <= 0.15 for d, v in lh.items()) >= 5


def test_a_line_without_markers_and_a_neighbour_are_read(spark):
    """A smooth line of 28 days, thicker at the grid lines of each day; a much wider second image doesn't change the first one's result."""
    day = lambda x: (x - LEFT) / PITCH
    temp = lambda d: 36.4 + 0.3 * math.sin(d / 4)
    px = {(x, y): (200, 200, 200) for x in range(60, 900) for y in range(60, 400)}
    for k in range(29):
        for y in range(TOP, BOTTOM):
            px[LEFT + PITCH * k, y] = (239, 239, 240)
    for x in range(LEFT, LEFT + PITCH * 28 + 1):
        thick = 6 if (x - LEFT) % PITCH in (0, 1, PITCH - 1) else 2
        for dy in range(-thick, thick + 1):
            px[x, y_of(temp(day(x))) + dy] = BLUE
    ticks = [(1, "right", 880.0, float(y_of(37.4 - 0.2 * k)), f"{37.4 - 0.2 * k:.1f}") for k in range(10)]
    other = [(2, x, 10, 239, 239, 240) for x in range(3000)]
    days, heads = charts.extract(
        spark.createDataFrame([(1, x, y, *c) for (x, y), c in px.items()] + other, "image_id long, x int, y int, r int, g int, b int"),
        spark.createDataFrame([(1, 900, 460), (2, 3000, 100)], "image_id long, width int, height int"),
        spark.createDataFrame(ticks, "image_id long, side string, cx double, cy double, text string"),
    )
    got = {r.day: 35.6 + r.value * 1.8 for r in days.where("image_id = 1 and series = 'temp' and present = 1").collect()}
    assert len(got) >= 27 and all(abs(v - temp(d + 0.5)) <= 0.05 for d, v in got.items())
    assert {r.image_id: r.status for r in heads.collect()}[2] == "not_a_chart"


def test_nothing_to_see(spark):
    blank = spark.createDataFrame([(1, x, y, 200, 200, 200) for x in range(30) for y in range(30)], "image_id long, x int, y int, r int, g int, b int")
    days, heads = charts.extract(blank, spark.createDataFrame([(1, 30, 30)], "image_id long, width int, height int"), spark.createDataFrame([], "image_id long, side string, cx double, cy double, text string"))
    assert heads.first().status == "not_a_chart" and days.where("present = 1").count() == 0


def test_labels_are_repaired(spark):
    rows = [("a", 40.0 * k, t) for k, t in enumerate(["37", "5", "36", ".5", "35", ""])] + [("b", 1.0, "x")]
    got = {(r.column_id, r.cy): r.value for r in charts.repair_labels(spark.createDataFrame(rows, "column_id string, cy double, text string")).collect()}
    assert [got["a", 40.0 * k] for k in range(6)] == [37.0, 36.5, 36.0, 35.5, 35.0, 34.5] and got["b", 1.0] is None


def test_even_ticks_drop_strays(spark):
    rows = [("a", 100.0 + 40 * k, float(k)) for k in range(6)] + [("a", 417.0, 9.0)]
    got = sorted(r.cy for r in charts.even_ticks(spark.createDataFrame(rows, "column_id string, cy double, value double")).collect())
    assert got == [100.0 + 40 * k for k in range(6)]


def test_manual_digitizer_tolerance(spark):
    """A straight curve on a 400 x 300 raster, read through two reference points an axis."""
    value = lambda d: 36.2 + 0.8 * ((d - 1) / 28)
    px = []
    for x in range(40, 361):
        y = 260 - (value(1 + (x - 40) / 320 * 28) - 36.2) / 0.8 * 220
        px += [(1, x, round(y) + k, 214, 68, 127, 255) for k in (-1, 0, 1)] + [(1, x, 20, 230, 230, 235, 255)]
    raster = spark.createDataFrame(px, "image_id long, x int, y int, r int, g int, b int, a int")
    cal = spark.createDataFrame([(1, "temp", 40.0, 1.0, 360.0, 29.0, 260.0, 36.2, 40.0, 37.0, (214, 68, 127), 60.0)], "image_id long, series string, day_px1 double, day_v1 double, day_px2 double, day_v2 double, val_px1 double, val_v1 double, val_px2 double, val_v2 double, target struct<r:int,g:int,b:int>, tolerance double")
    points = digitize.scan_columns(raster, cal, F.lit(35), F.lit(365), F.lit(30), F.lit(280))
    got = {r.day: r.value for r in digitize.resample(points, cal).collect()}
    assert len(got) == 35 and all(abs(got[d] - value(d)) <= 0.05 for d in range(1, 30)) and got[31] is None
    c = digitize.suggest_colour(raster, 0, 0, 400, 300).first()
    assert (c.r, c.g, c.b) == (214, 68, 127)
    g = spark.range(1).select(digitize.plot_guess(F.lit(400), F.lit(300)).alias("g")).first().g
    assert tuple(g) == (40, 24, 360, 276)


def test_autocorrelation_and_lines(spark):
    p = spark.createDataFrame([(1, x, 10.0 if x % 40 < 4 else 0.0) for x in range(800)], "image_id long, x int, v double")
    assert axes.pitch(p).first().lag == 40
    line = axes.robust_line(spark.createDataFrame([("a", float(y), 99.5 - 0.0125 * y + (5 if y == 120 else 0)) for y in range(0, 400, 40)], "column_id string, cy double, value double")).first()
    assert abs(line.b + 0.0125) < 1e-9 and line.n_fit == 9


def test_predictions_and_losses(spark):
    raw = spark.createDataFrame([(1, "temp", 0, 1.5, 2.0), (1, "temp", 1, 0.5, -2.0)], "id long, series string, day int, value double, logit double")
    d = {r.day: (r.present, r.value) for r in vision.decode(raw).collect()}
    assert d == {0: (1, 1.0), 1: (0, None)}
    heat = spark.createDataFrame([(1, "temp", 0, 0.0, 0.0), (1, "temp", 0, 1.0, 0.0), (1, "temp", 1, 0.25, 50.0), (1, "temp", 1, 1.0, -50.0)], "id long, series string, day int, y double, logit double")
    assert {r.day: round(r.value, 6) for r in vision.soft_argmax(heat).collect()} == {0: 0.5, 1: 0.25}
    rows = spark.createDataFrame([(0.5, 1, 0.9, 0.5, 1), (0.2, 1, 0.6, 0.9, 0), (0.0, 0, 0.2, 0.3, 1)], "value double, present int, probability double, true_value double, true_present int")
    e = vision.evaluate_predictions(rows).first()
    assert (round(e.mae, 6), e.precision, e.recall, e.f1) == (0.15, 0.5, 0.5, 0.5)
    l = vision.losses(rows).first()
    assert abs(l.value_loss - (0.3 - 0.025) / 2) < 1e-9 and abs(l.presence_loss + (math.log(0.9) + math.log(0.4) + math.log(0.2)) / 3) < 1e-9
    s = spark.createDataFrame([([0.0, 0.0], 1), ([0.0, 0.0], -1)], "l array<double>, t int").select(vision.scale_loss(F.col("l"), F.col("t")).alias("x"), vision.scale_of(F.col("l")).alias("i")).collect()
    assert abs(s[0].x - math.log(2)) < 1e-12 and s[1].x is None and s[0].i == 0


def test_series_helpers(spark):
    pts = spark.createDataFrame([(1, "temp", d, 0.5, int(d < 3)) for d in range(5)] + [(1, "lh", 0, 0.5, 1)], "id long, series string, day int, value double, present int")
    assert {r.series: r.enabled for r in vision.usable(pts).collect()} == {"temp": True, "lh": False}
    assert vision.measured(pts).where("value is not null").count() == 4
    c = spark.createDataFrame([(True, True, 0.5), (False, True, 0.5)], "c boolean, e boolean, s double").select(vision.consent_config(F.col("c"), F.col("e"), F.col("s")).alias("x")).collect()
    assert [tuple(r.x) for r in c] == [(True, 0.5, True), (False, 0.0, False)]
    strip = charts.value_strip(pts, F.lit(35.6), F.lit(37.4)).where("series = 'temp'").orderBy("day").collect()
    assert [r.text for r in strip] == ["36.50"] * 3 + [""] * 2
    n = spark.range(1).select(series.normalise(F.lit(36.5), F.lit(35.6), F.lit(37.4)).alias("n")).first().n
    assert n == pytest.approx(0.5)
