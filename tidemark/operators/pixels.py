"""Classical vision on tables of pixels: colour bands, components, plot regions, markers, lines, day grids, table cells.

Pixels are rows (image_id, x, y, r, g, b) and masks rows (image_id, color, x, y). Everything that filters, counts or measures
runs of pixels is relational, so it spreads over images and rows of images alike; what has an order inside one image
(component labelling, snapping markers to cells) runs once an image in Arrow batches, on masks only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import axes
from tidemark.sources.readings import DAYS

#: Hue from, hue to, least saturation, least value of each series' ink (hue 0..179).
BANDS = {"blue": (95, 124, 12, 100), "orange": (0, 18, 30, 120), "purple": (128, 162, 35, 100)}
HEART = ((0, 25, 90, 80), (170, 179, 90, 80))
CIRCLE = (125, 160, 50, 90)
#: White blobs, rings around them, line samples.
BRIGHT, AREA, SIDE, ASPECT = 225, (4, 360), (3, 26), (0.35, 2.6)
RADII, ANGLES, COVERAGE, FILLED = (3, 4, 5, 6, 7, 8, 9, 11, 14), 32, 0.30, 60
SAMPLE, COLUMN_INK = 0.30, 4
#: Height of the strip of dates below a plot, as a share of the plot's.
DATE_ROW = 0.18
FALLBACK = (0.10, 0.10, 0.92, 0.72)
#: Rows of the table below a chart, and the words that name them.
ROWS = ("calendar", "CD", "DPO", "Sex", "CM", "Symptoms", "hCG")
ROW_WORDS = (("cd", "CD"), ("dpo", "DPO"), ("sex", "Sex"), ("cm", "CM"), ("symptoms", "Symptoms"), ("symptom", "Symptoms"), ("hcg", "hCG"))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DARK = 200
#: Dates in colour-independent ink (window, contrast, white from, saturation of pills, reach of a pill), and the
#: least ink, width, pitch and number of columns of a lattice of them.
GLYPHS = (7, 6, 225, 60, 4)
LATTICE = (20, 60, 8, 8)
#: Area, sides and gap of the letters of a row's label.
LETTERS = {"area": 6, "width": (2, 90), "height": (4, 40), "gap": 10}


# --- colour ------------------------------------------------------------------


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue 0..179, saturation and value 0..255."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    turn = F.when(v == r, (g - b) / F.nullif(d, F.lit(0))).when(v == g, 2.0 + (b - r) / F.nullif(d, F.lit(0))).otherwise(4.0 + (r - g) / F.nullif(d, F.lit(0)))
    hue = F.floor(F.when(turn < 0, turn + 6).otherwise(turn) * 30 + 0.5) % 180
    return F.struct(F.coalesce(hue, F.lit(0)).cast("int").alias("h"), F.coalesce(F.floor(255.0 * d / F.nullif(v, F.lit(0)) + 0.5), F.lit(0)).cast("int").alias("s"), v.cast("int").alias("v"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")


def in_band(c: Column, band: tuple[int, int, int, int]) -> Column:
    return c["h"].between(band[0], band[1]) & (c["s"] >= band[2]) & (c["v"] >= band[3])


def blur(pixels: DataFrame) -> DataFrame:
    """pixels (image_id, x, y, r, g, b) smoothed by the weights 1 2 1 along each axis. At an edge the neighbour inside counts twice; a
    pixel without neighbours stays. One pass along rows and one along columns, each over one image's row or column."""
    out = pixels.select("image_id", "x", "y", *[F.col(c).cast("double").alias(c) for c in "rgb"])
    for along, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("image_id", across).orderBy(along)
        side = lambda c, far, step: F.when(far(along).over(w) == F.col(along) + step, far(c).over(w))
        mixed = []
        for c in "rgb":
            before, after = side(c, F.lag, -1), side(c, F.lead, 1)
            mixed.append(((F.coalesce(before, after, c) + 2 * F.col(c) + F.coalesce(after, before, c)) / 4).alias(c))
        out = out.select("image_id", "x", "y", *mixed)
    return out.select("image_id", "x", "y", *[F.floor(F.col(c) + 0.5).cast("int").alias(c) for c in "rgb"])


def segment(pixels: DataFrame, smooth: bool = True) -> DataFrame:
    """(image_id, color, x, y): the ink of each series; the bands of hue don't overlap. Smoothing brings the edges of thin lines into
    the bands."""
    pixels = blur(pixels) if smooth else pixels
    c = hsv(F.col("r"), F.col("g"), F.col("b"))
    color = F.lit(None).cast("string")
    for name, band in BANDS.items():
        color = F.when(in_band(F.col("_c"), band), F.lit(name)).otherwise(color)
    return pixels.withColumn("_c", c).withColumn("color", color).where("color is not null").select("image_id", "color", "x", "y")


# --- morphology ----------------------------------------------------------------


def dilate(mask: DataFrame, rx: int, ry: int, by: tuple[str, ...] = ("image_id", "color")) -> DataFrame:
    """Every pixel within rx and ry of the mask: each pixel makes its (2 rx + 1)(2 ry + 1) neighbours, once."""
    out = mask.withColumn("_dx", F.explode(F.sequence(F.lit(-rx), F.lit(rx)))).withColumn("_dy", F.explode(F.sequence(F.lit(-ry), F.lit(ry))))
    return out.select(*by, (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y")).distinct()


def erode(mask: DataFrame, rx: int, ry: int, by: tuple[str, ...] = ("image_id", "color")) -> DataFrame:
    """Pixels whose whole neighbourhood lies in the mask: each pixel votes for those it supports."""
    votes = mask.withColumn("_dx", F.explode(F.sequence(F.lit(-rx), F.lit(rx)))).withColumn("_dy", F.explode(F.sequence(F.lit(-ry), F.lit(ry))))
    votes = votes.select(*by, (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"))
    return votes.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == (2 * rx + 1) * (2 * ry + 1)).drop("_n")


def close(mask: DataFrame, r: int = 1, by: tuple[str, ...] = ("image_id", "color")) -> DataFrame:
    """Fills gaps of up to 2 r pixels."""
    return erode(dilate(mask, r, r, by), r, r, by)


def runs(mask: DataFrame, along: str = "x", by: tuple[str, ...] = ("image_id", "color")) -> DataFrame:
    """(…, the other axis, start, end): maximal runs of neighbouring pixels along an axis, by gaps and islands."""
    across = "y" if along == "x" else "x"
    w = Window.partitionBy(*by, across).orderBy(along)
    islands = mask.withColumn("_i", F.col(along) - F.row_number().over(w))
    return islands.groupBy(*by, across, "_i").agg(F.min(along).alias("start"), F.max(along).alias("end")).drop("_i")


def open_long(mask: DataFrame, least: Column, along: str = "x", by: tuple[str, ...] = ("image_id", "color")) -> DataFrame:
    """Runs of at least `least` pixels: what a morphological opening with a line of that length leaves."""
    return runs(mask, along, by).where(F.col("end") - F.col("start") + 1 >= least)


# --- components ----------------------------------------------------------------


def _label(diagonal: bool):
    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        order = np.lexsort((x, y))
        x, y = x[order], y[order]
        # Runs of each row are joined with the runs they touch in the row above.
        new = np.ones(len(x), bool)
        new[1:] = (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(x)) - 1
        parent = np.arange(len(start))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        reach, above = int(diagonal), 0
        for i in range(len(start)):
            while above < i and y[start[above]] < y[start[i]] - 1:
                above += 1
            k = above
            while k < i and y[start[k]] == y[start[i]] - 1:
                if x[start[k]] <= x[end[i]] + reach and x[end[k]] >= x[start[i]] - reach:
                    a, b = root(k), root(i)
                    parent[max(a, b)] = min(a, b)
                k += 1
        label = np.array([root(i) for i in range(len(start))], np.int64)[np.cumsum(new) - 1]
        return pa.table({"image_id": table.column("image_id").take(pa.array(order)), "color": table.column("color").take(pa.array(order)), "x": pa.array(x.astype(np.int32)), "y": pa.array(y.astype(np.int32)), "label": pa.array(label)})

    return run


def components(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """(image_id, color, label, area, x0, y0, x1, y1, cx, cy) of connected pixels; rows don't wrap around."""
    cast = mask.select(F.col("image_id").cast("long").alias("image_id"), F.col("color").cast("string").alias("color"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    labelled = cast.distinct().groupBy("image_id", "color").applyInArrow(_label(diagonal), "image_id long, color string, x int, y int, label long")
    return labelled.groupBy("image_id", "color", "label").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def ink_box(parts: DataFrame) -> DataFrame:
    """(image_id, x0, y0, x1, y1) of a chart's lines: blue and orange components, without long flat ones, of at least a quarter
    of the largest one's area. Components are those of both colours together (color 'ink')."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    real = parts.where(~((w > 200) & (h < F.greatest(F.lit(6), F.floor(w / 18)))))
    most = F.max("area").over(Window.partitionBy("image_id"))
    kept = real.withColumn("_m", most).where(F.col("area") >= F.greatest(F.lit(80), F.floor(F.col("_m") * 0.25)))
    return kept.groupBy("image_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def pale(pixels: DataFrame) -> DataFrame:
    """Grid ink: pale and without colour."""
    c = pixels.withColumn("_g", gray(F.col("r"), F.col("g"), F.col("b"))).withColumn("_s", hsv(F.col("r"), F.col("g"), F.col("b"))["s"])
    return c.where(F.col("_g").between(228, 247) & (F.col("_s") <= 18)).select("image_id", F.lit("grid").alias("color"), "x", "y")


def grid_band(grid: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, y0, y1): the rows that hold pale runs of an eighth of their own image's width, at least 40 % of the fullest row."""
    wide = runs(grid).join(images.select("image_id", "width"), "image_id")
    long_ = wide.where(F.col("end") - F.col("start") + 1 >= F.greatest(F.lit(40), F.floor(F.col("width") / 8)))
    rows = long_.groupBy("image_id", "y").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"))
    strong = rows.withColumn("m", F.max("n").over(Window.partitionBy("image_id"))).where("n >= 0.4 * m")
    return strong.groupBy("image_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("rows")).where("rows >= 2").drop("rows")


def plot_region(images: DataFrame, ink: DataFrame, grid: DataFrame) -> DataFrame:
    """(image_id, x0, y0, x1, y1, method) from the ink's box and the grid's band, either, or fixed shares of the image.

    images: (image_id, width, height)."""
    i = ink.select("image_id", F.struct("x0", "y0", "x1", "y1").alias("i"))
    g = grid.select("image_id", F.struct("y0", "y1").alias("g"))
    j = images.join(i, "image_id", "left").join(g, "image_id", "left")
    whole = lambda x: F.floor(x).cast("int")
    ih = F.greatest(F.lit(40), F.col("i.y1") - F.col("i.y0"))
    thin = F.col("g.y1") - F.col("g.y0") < 0.4 * ih
    gy0 = F.when(thin, F.col("i.y0")).otherwise(F.greatest(F.col("g.y0"), F.col("i.y0") - ih))
    gy1 = F.when(thin, F.col("i.y1")).otherwise(F.least(F.col("g.y1"), F.col("i.y1") + ih))
    mx, my = F.greatest(F.lit(2), whole((F.col("i.x1") - F.col("i.x0")) / 60)), F.greatest(F.lit(2), whole((gy1 - gy0) / 60))
    pad = F.greatest(F.lit(3), whole((F.col("i.y1") - F.col("i.y0")) / 30))
    has_i, has_g = F.col("i").isNotNull(), F.col("g").isNotNull()
    edge = lambda v, size: F.greatest(F.lit(0), F.least(v, size - 1))
    share = lambda k, size: whole(F.lit(FALLBACK[k]) * size)
    x0 = F.when(has_i & has_g, F.greatest(F.lit(0), F.col("i.x0") - mx)).when(has_i, F.greatest(F.lit(0), F.col("i.x0") - pad)).otherwise(share(0, F.col("width")))
    x1 = F.when(has_i & has_g, edge(F.col("i.x1") + mx, F.col("width"))).when(has_i, edge(F.col("i.x1") + pad, F.col("width"))).otherwise(share(2, F.col("width")))
    y0 = F.when(has_i & has_g, F.greatest(F.lit(0), gy0 - my)).when(has_i, F.greatest(F.lit(0), F.col("i.y0") - pad)).when(has_g, F.col("g.y0")).otherwise(share(1, F.col("height")))
    y1 = F.when(has_i & has_g, edge(gy1 + my, F.col("height"))).when(has_i, edge(F.col("i.y1") + pad, F.col("height"))).when(has_g, F.col("g.y1")).otherwise(share(3, F.col("height")))
    method = F.when(has_i & has_g, "ink+grid").when(has_i, "ink").when(has_g, "grid").otherwise("fallback")
    return j.select("image_id", x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), method.alias("method"))


# --- markers ---------------------------------------------------------------------


def blobs(parts: DataFrame) -> DataFrame:
    """White components of a marker's size and shape: (image_id, blob, cx, cy, area)."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    fit = F.col("area").between(*AREA) & w.between(*SIDE) & h.between(*SIDE) & (w / h).between(*ASPECT)
    return parts.where(fit).select("image_id", F.col("label").alias("blob"), "cx", "cy", "area")


def centres(found: DataFrame, mask: DataFrame) -> DataFrame:
    """(image_id, blob, color, cx, cy, score, radius, kind): each blob goes to the colour that rings it best, by 30 % or more.

    A blob makes 32 points on each of nine circles; points meet the mask by equality."""
    circle = F.explode(F.array(*[F.lit(r) for r in RADII]))
    p = found.withColumn("radius", circle).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ANGLES - 1))))
    angle = F.col("k") * F.lit(2 * np.pi / ANGLES)
    p = p.withColumn("x", F.bround(F.col("cx") + F.col("radius") * F.cos(angle)).cast("int")).withColumn("y", F.bround(F.col("cy") + F.col("radius") * F.sin(angle)).cast("int"))
    hits = p.join(mask.select("image_id", "color", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct(), ["image_id", "x", "y"])
    share = hits.groupBy("image_id", "blob", "cx", "cy", "area", "color", "radius").agg((F.count(F.lit(1)) / ANGLES).alias("score"))
    names = F.array(*[F.lit(c) for c in BANDS])
    best = share.groupBy("image_id", "blob", "cx", "cy", "area").agg(F.max(F.struct("score", (-F.array_position(names, F.col("color"))).alias("c"), (-F.col("radius")).alias("r"), "color")).alias("m"))
    return best.where(F.col("m.score") >= COVERAGE).select("image_id", "blob", "m.color", "cx", "cy", "m.score", (-F.col("m.r")).alias("radius"), F.when(F.col("area") > FILLED, "filled").otherwise("ring").alias("kind"))


def ink_span(mask: DataFrame, region: DataFrame) -> DataFrame:
    """(image_id, color, span): the share of the plot's columns that hold ink."""
    inside = mask.join(region, "image_id").where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return inside.groupBy("image_id", "color").agg((F.countDistinct("x") / (F.max("x1") - F.max("x0") + 1)).alias("span"))


def lh_colour(marks: DataFrame, spans: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, lh_color): purple where it has clearly more markers or a clearly longer line, else orange."""
    n = lambda c: F.count_if(F.col("color") == c)
    m = marks.groupBy("image_id").agg(n("orange").alias("o"), n("purple").alias("p"))
    s = spans.groupBy("image_id").agg(F.max(F.when(F.col("color") == "orange", F.col("span"))).alias("so"), F.max(F.when(F.col("color") == "purple", F.col("span"))).alias("sp"))
    j = images.select("image_id").distinct().join(m, "image_id", "left").join(s, "image_id", "left").na.fill(0)
    purple = ((F.col("p") >= 4) & (F.col("p") > F.col("o") + 2)) | ((F.col("sp") >= 0.70) & (F.col("sp") > F.col("so") + 0.25))
    return j.select("image_id", F.when(purple, "purple").otherwise("orange").alias("lh_color"))


def _snap(marks: pa.Table, cells: pa.Table) -> pa.Table:
    at, idx = cells.column("cell_x").to_numpy(), cells.column("cell_idx").to_numpy()
    order = np.argsort(idx)
    at, idx = at[order], idx[order]
    pitch = cells.column("cell_px")[0].as_py() if cells.num_rows else 0.0
    rows = sorted(zip(*(marks.column(c).to_pylist() for c in ("cx", "cy", "image_id", "series"))))
    out, last = [], -1
    for cx, cy, image, name in rows:
        if last + 1 >= len(at):
            break
        ahead = np.abs(at[last + 1 :] - cx)
        k = last + 1 + int(np.argmin(ahead))
        if abs(at[k] - cx) > 1.4 * pitch:
            continue
        out.append((image, name, int(idx[k]), cx, cy))
        last = k
    names = ("image_id", "series", "cell_idx", "cx", "cy")
    return pa.table(dict(zip(names, map(list, zip(*out)) if out else [[]] * 5)), schema=pa.schema([("image_id", pa.int64()), ("series", pa.string()), ("cell_idx", pa.int32()), ("cx", pa.float64()), ("cy", pa.float64())]))


def snap(marks: DataFrame, cells: DataFrame) -> DataFrame:
    """Markers (image_id, series, cx, cy) to cells (image_id, cell_idx, cell_x, cell_px), from left to right: each to the nearest cell
    after the one before, unless that is farther than 1.4 pitches. The order is within one series of one chart."""
    own = cells.join(marks.select("image_id", "series").distinct(), "image_id").select(F.col("image_id").alias("_i"), F.col("series").alias("_s"), "cell_idx", "cell_x", "cell_px")
    m = marks.select(F.col("image_id").cast("long").alias("image_id"), "series", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    return m.groupBy("image_id", "series").cogroup(own.groupBy("_i", "_s")).applyInArrow(_snap, "image_id long, series string, cell_idx int, cx double, cy double")


def cover_line(mask: DataFrame, region: DataFrame) -> DataFrame:
    """(image_id, color, y): the height of a flat line over 40 % of the plot's width: the mean of the rows with at least half
    the ink of the fullest."""
    width = F.col("x1") - F.col("x0") + 1
    inside = mask.join(region, "image_id").where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    long_ = open_long(inside.select("image_id", "color", "x", "y"), F.lit(20)).join(region, "image_id").where(F.col("end") - F.col("start") + 1 >= F.floor(width * 0.40))
    rows = long_.groupBy("image_id", "color", "y").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"))
    strong = rows.withColumn("m", F.max("n").over(Window.partitionBy("image_id", "color"))).where("n >= 0.5 * m")
    return strong.groupBy("image_id", "color").agg(F.avg("y").alias("y"))


def sample_line(mask: DataFrame, region: DataFrame, cells: DataFrame, cover: DataFrame | None = None, around: float = 6.0) -> DataFrame:
    """(image_id, color, cell_idx, cx, cy, score): the height of a continuous line in each cell: the mean of the ink within
    0.3 pitches, near its median, without a cover line. A cell's window is a few columns, joined by equality."""
    half = F.greatest(F.lit(2), F.bround(F.col("cell_px") * SAMPLE).cast("int"))
    columns = cells.withColumn("x", F.explode(F.sequence(F.bround(F.col("cell_x") - half).cast("int"), F.bround(F.col("cell_x") + half).cast("int"))))
    ink = mask.join(region, "image_id").where(F.col("y").between(F.col("y0"), F.col("y1"))).select("image_id", "color", F.col("x").cast("int").alias("x"), "y")
    if cover is not None:
        ink = ink.join(cover.withColumnRenamed("y", "_c"), ["image_id", "color"], "left").where(F.col("_c").isNull() | (F.abs(F.col("y") - F.col("_c")) > around)).drop("_c")
    seen = columns.join(ink, ["image_id", "x"])
    keys = ["image_id", "color", "cell_idx", "cell_x", "cell_px"]
    middle = seen.groupBy(*keys).agg(F.median("y").alias("med"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= COLUMN_INK)
    near = seen.join(middle.drop("n"), keys).where(F.abs(F.col("y") - F.col("med")) <= F.greatest(F.lit(12.0), F.col("cell_px") * 1.2) / 2)
    out = near.groupBy(*keys).agg(F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= COLUMN_INK)
    return out.select("image_id", "color", "cell_idx", F.col("cell_x").alias("cx"), "cy", F.least(F.lit(1.0), F.col("n") / 20).alias("score"))


def line_or_markers(span: Column, markers: Column, cells: Column, sampled: Column) -> Column:
    """'line' for a line over 88 % of the plot, or over 70 % with too few markers, if sampling it finds more days."""
    tried = (span >= 0.88) | ((span >= 0.70) & (markers < 0.70 * span * cells))
    return F.when(tried & (sampled > markers), "line").otherwise("markers")


def _beside(rows: DataFrame) -> DataFrame:
    """rows for a join with pixels, by image, that sorts both sides. The planner knows how many images there are, not how many pixels
    each was exploded to, and would send the pixels through the driver for a broadcast."""
    return rows.hint("merge")


# --- day grid ---------------------------------------------------------------------


def vertical_lines(grid: DataFrame, region: DataFrame) -> DataFrame:
    """(image_id, x): the middles of neighbouring columns that hold pale runs over a third of their own plot's height."""
    region = _beside(region)
    inside = grid.join(region, "image_id").where(F.col("x").between(F.col("x0"), F.col("x1") - 1) & F.col("y").between(F.col("y0"), F.col("y1") - 1))
    high = runs(inside.select("image_id", "color", "x", "y"), "y").join(region, "image_id")
    long_ = high.where(F.col("end") - F.col("start") + 1 >= F.greatest(F.lit(20), F.floor((F.col("y1") - F.col("y0")) / 3)))
    cols = long_.groupBy("image_id", "x").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"))
    strong = cols.withColumn("m", F.max("n").over(Window.partitionBy("image_id"))).where("n >= 0.4 * m and m >= 5")
    w = Window.partitionBy("image_id").orderBy("x")
    g = strong.withColumn("_i", F.col("x") - F.row_number().over(w)).groupBy("image_id", "_i").agg(((F.min("x") + F.max("x")) / 2).alias("x"))
    gaps = g.withColumn("gap", F.col("x") - F.lag("x").over(w))
    med = gaps.groupBy("image_id").agg(F.median("gap").alias("med"), F.count(F.lit(1)).alias("n"))
    ok = gaps.join(_beside(med), "image_id").groupBy("image_id").agg(F.max("n").alias("n"), F.max("med").alias("med"), F.count_if(F.col("gap").between(F.col("med") * 0.6, F.col("med") * 1.4)).alias("kept"))
    return g.join(_beside(ok.where("n >= 5 and med >= 8 and kept >= 0.5 * (n - 1)").select("image_id")), "image_id").select("image_id", "x")


def sessions(points: DataFrame, value: str, gap: Column, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """points plus `session`: a new one starts where the distance from the point before reaches `gap`."""
    w = Window.partitionBy(*by).orderBy(value)
    starts = F.coalesce(F.col(value) - F.lag(value).over(w) >= gap, F.lit(True))
    return points.withColumn("_new", starts.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def date_centres(digits: DataFrame) -> DataFrame:
    """(image_id, x): digit blobs (image_id, x) merged to one centre a date; merging distance is 30 % of the median gap."""
    w = Window.partitionBy("image_id").orderBy("x")
    gaps = digits.withColumn("_g", F.col("x") - F.lag("x").over(w)).groupBy("image_id").agg(F.greatest(F.lit(4.0), F.median("_g") * 0.30).alias("gap"), F.count(F.lit(1)).alias("n"))
    marked = sessions(digits.join(gaps.where("n >= 5"), "image_id"), "x", F.col("gap"))
    return marked.groupBy("image_id", "session").agg(F.avg("x").alias("x")).select("image_id", "x")


def split_level(grays: DataFrame) -> DataFrame:
    """(image_id, level): the grey level that parts an image's pixels (image_id, g) into two classes farthest apart (largest variance
    between them); the lower class holds the level. 256 rows an image at most."""
    counts = grays.groupBy("image_id", "g").agg(F.count(F.lit(1)).alias("n"))
    whole, up = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("g")
    c = counts.withColumn("n0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("g")).over(up))
    c = c.withColumn("n1", F.sum("n").over(whole) - F.col("n0")).withColumn("s1", F.sum(F.col("n") * F.col("g")).over(whole) - F.col("s0")).where("n1 > 0")
    between = F.col("n0").cast("double") * F.col("n1") * F.pow(F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1"), 2)
    return c.groupBy("image_id").agg(F.max(F.struct(between.alias("v"), (-F.col("g")).alias("g")))["g"].alias("g")).select("image_id", (-F.col("g")).alias("level"))


def date_digits(pixels: DataFrame, region: DataFrame) -> DataFrame:
    """(image_id, x): middles of dark components of a digit's size in the strip below the plot."""
    low = F.col("y1") + F.greatest(F.lit(40), F.floor((F.col("y1") - F.col("y0")) * DATE_ROW))
    strip = pixels.join(region, "image_id").where((F.col("y") >= F.col("y1") + 4) & (F.col("y") < low) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    grays = strip.select("image_id", F.lit("date").alias("color"), "x", "y", gray(F.col("r"), F.col("g"), F.col("b")).alias("g"))
    dark = grays.join(split_level(grays), "image_id").where("g <= level")
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return components(dark).where(F.col("area").between(12, 600) & w.between(3, 40) & h.between(6, 36)).select("image_id", F.col("cx").alias("x"))


def calendar_columns(boxes: DataFrame) -> DataFrame:
    """(image_id, x, cell_px): the days of a table's calendar row, by its digits' boxes (image_id, cx, x0, x1), x1 being past the
    last pixel. Gaps between digits are of two kinds, within a number and between numbers: the border lies halfway between the
    mean of those up to the median gap and the mean of the others, at eight pixels at least. The pitch is the median distance."""
    w = Window.partitionBy("image_id").orderBy("cx")
    gaps = boxes.withColumn("_g", F.col("x0") - F.lag("x1").over(w))
    middle = gaps.groupBy("image_id").agg(F.get(F.array_sort(F.collect_list("_g")), F.floor(F.count("_g") / 2).cast("int")).alias("m"))
    j = gaps.join(middle, "image_id")
    means = j.groupBy("image_id", "m").agg(F.avg(F.when(F.col("_g") <= F.col("m"), F.col("_g"))).alias("small"), F.avg(F.when(F.col("_g") > F.col("m"), F.col("_g"))).alias("large"))
    border = means.select("image_id", F.greatest(F.lit(8.0), F.coalesce((F.col("small") + F.col("large")) / 2, F.col("m").cast("double"))).alias("_border"))
    starts = gaps.join(border, "image_id").withColumn("_new", F.coalesce(F.col("_g") > F.col("_border"), F.lit(True)).cast("int"))
    numbers = starts.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("image_id", "_k").agg(F.avg("cx").alias("x"))
    step = numbers.withColumn("_d", F.col("x") - F.lag("x").over(Window.partitionBy("image_id").orderBy("x"))).groupBy("image_id").agg(F.median("_d").alias("cell_px"))
    return numbers.join(step, "image_id").select("image_id", "x", "cell_px")


def modal_pitch(marks: DataFrame, width: Column) -> DataFrame:
    """(image_id, cell_px): the most frequent distance of neighbouring markers in bins of two pixels, within a day's plausible
    width. marks: (image_id, cx, and what `width` names)."""
    w = Window.partitionBy("image_id").orderBy("cx")
    d = marks.withColumn("d", F.col("cx") - F.lag("cx").over(w)).where("d >= 8").withColumn("_w", width)
    bins = d.groupBy("image_id", F.floor(F.col("d") / 2).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("_w").alias("w"))
    best = bins.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("k")).alias("nk"))).alias("m"), F.max("w").alias("w"))
    low = F.greatest(F.lit(15.0), F.col("w") / 80)
    return best.select("image_id", F.greatest(low, F.least(F.greatest(low + 1, F.col("w") / 6), -F.col("m.nk") * 2.0 + 1)).alias("cell_px"))


def tile(marks: DataFrame, pitches: DataFrame, days: int = DAYS) -> DataFrame:
    """(image_id, cell_idx, cell_x, cell_px): cells from the first marker on, at the phase that brings all markers nearest to cell
    edges' grid: 61 phases of one pitch are tried, the first of the best wins."""
    m = marks.join(pitches, "image_id").withColumn("_first", F.min("cx").over(Window.partitionBy("image_id")) - F.col("cell_px") / 2)
    tried = m.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(60)))).withColumn("off", F.col("cell_px") * (F.col("k") / 60 - 0.5))
    rel = F.pmod(F.col("cx") - F.col("_first") - F.col("off"), F.col("cell_px"))
    errors = tried.groupBy("image_id", "cell_px", "_first", "k", "off").agg(F.sum(F.round(F.least(rel, F.col("cell_px") - rel), 6)).alias("err"))
    best = errors.groupBy("image_id", "cell_px", "_first").agg(F.min(F.struct("err", "k", "off")).alias("b"))
    cells = best.withColumn("cell_idx", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    return cells.select("image_id", "cell_idx", (F.col("_first") + F.col("b.off") + (F.col("cell_idx") + 0.5) * F.col("cell_px")).alias("cell_x"), "cell_px")


def choose_grid(dates: DataFrame, lines: DataFrame, hints: DataFrame, region: DataFrame) -> DataFrame:
    """(image_id, source, cell_px): dates before grid lines, each if their pitch is plausible, they cover 60 % of the plot and agree
    with the autocorrelation within 30 %; else the autocorrelation, unless marker spacing differs by more than 25 %.

    dates, lines: (image_id, x); hints: (image_id, autocorr, spacing)."""
    w = Window.partitionBy("image_id").orderBy("x")

    def pitch(points: DataFrame, name: str) -> DataFrame:
        g = points.withColumn("_g", F.col("x") - F.lag("x").over(w)).groupBy("image_id").agg(F.median("_g").alias("p"), F.count(F.lit(1)).alias("n"))
        return g.select("image_id", F.struct("p", "n").alias(name))

    j = region.join(hints, "image_id", "left").join(pitch(dates, "d"), "image_id", "left").join(pitch(lines, "l"), "image_id", "left")
    width = F.col("x1") - F.col("x0")

    def good(c: str, least: int) -> Column:
        p, n = F.col(f"{c}.p"), F.col(f"{c}.n")
        agrees = F.col("autocorr").isNull() | p.between(F.col("autocorr") * 0.7, F.col("autocorr") * 1.3)
        return F.coalesce((n >= least) & p.between(width / 80, width / 8) & (n / (width / p) >= 0.6) & agrees, F.lit(False))

    off = F.abs(F.col("autocorr") - F.col("spacing")) / F.greatest("autocorr", "spacing") > 0.25
    use_spacing = F.col("autocorr").isNull() | F.coalesce(off, F.lit(False))
    source = F.when(good("d", 8), "date-row").when(good("l", 5), "gridlines").when(use_spacing & F.col("spacing").isNotNull(), "marker-spacing").when(F.col("autocorr").isNotNull(), "autocorr").otherwise("uniform")
    cell = F.when(good("d", 8), F.col("d.p")).when(good("l", 5), F.col("l.p")).when(use_spacing & F.col("spacing").isNotNull(), F.col("spacing")).when(F.col("autocorr").isNotNull(), F.col("autocorr")).otherwise(width / DAYS)
    return j.select("image_id", source.alias("source"), cell.cast("double").alias("cell_px"))


def visible_days(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(image_id, visible_days, truncated): days that the chart shows, by its points or its ink's width; 35 are kept.

    points: (image_id, n); spans: (image_id, ink_width, cell_px)."""
    j = points.join(spans, "image_id")
    days = F.greatest(F.col("n"), F.floor(F.col("ink_width") / F.col("cell_px")).cast("int") + 1)
    return j.select("image_id", days.cast("int").alias("visible_days"), (days > DAYS).alias("truncated"))


# --- the table below the chart -------------------------------------------------------


def row_centres(glyphs: DataFrame) -> DataFrame:
    """(image_id, row, cy, x0, y0, x1, y1): label glyphs (image_id, cy, x0, y0, x1, y1) gathered to rows. A new row starts at a gap
    of 0.7 of the usual large one."""
    w = Window.partitionBy("image_id").orderBy("cy")
    gaps = glyphs.withColumn("_g", F.col("cy") - F.lag("cy").over(w))
    middle = gaps.where("_g is not null").groupBy("image_id").agg(F.sort_array(F.collect_list("_g")).alias("l"))
    middle = middle.withColumn("m", F.get("l", F.floor(F.size("l") / 2).cast("int")))
    large = F.filter("l", lambda x: x > F.col("m"))
    n = F.size(large)
    typical = F.when(n > 0, (F.get(large, F.floor((n - 1) / 2).cast("int")) + F.get(large, F.floor(n / 2).cast("int"))) / 2).otherwise(F.col("m") * 2)
    marked = sessions(glyphs.join(middle.select("image_id", F.greatest(F.lit(8.0), typical * 0.7).alias("gap")), "image_id"), "cy", F.col("gap"))
    return marked.groupBy("image_id", F.col("session").alias("row")).agg(F.avg("cy").alias("cy"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _near(word: str, text: Column, most: int = 1) -> Column:
    """Whether a window of the text differs from the word in at most `most` letters, a length difference counting as one each."""
    n = len(word)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))

    def off(window: Column) -> Column:
        d = F.abs(F.length(window) - n)
        for k, c in enumerate(word):
            d = d + F.when((F.length(window) > k) & (F.substring(window, F.lit(k + 1), F.lit(1)) != c), 1).otherwise(0)
        return d

    tries = lambda i: [off(F.substring(text, i, F.lit(size))) <= most for size in range(max(1, n - most), n + most + 1)]
    hit = F.exists(starts, lambda i: F.greatest(*[t.cast("int") for t in tries(i)]) == 1)
    return hit & (F.length(text) >= n - most)


def row_name(text: Column, idx: Column) -> Column:
    """A table row's name by its label: a known word in it, else a nearly known long word, else a month for the calendar, else its place."""
    t = F.lower(F.translate(F.trim(F.coalesce(text, F.lit(""))), ". ", ""))
    place = F.coalesce(F.get(F.array(*[F.lit(r) for r in ROWS]), idx), F.concat(F.lit("row"), idx.cast("string")))
    out = F.when(t == "", place)
    for word, name in ROW_WORDS:
        out = out.when(F.contains(t, F.lit(word)), F.lit(name))
    for word, name in ROW_WORDS:
        if len(word) >= 5:
            out = out.when(_near(word, t), F.lit(name))
    for m in MONTHS:
        out = out.when(t.startswith(m), F.lit("calendar"))
    return out.otherwise(place)


def regular(centres_: DataFrame, pitches: DataFrame) -> DataFrame:
    """(image_id, regular): whether 70 % of the gaps of at least eight columns are whole numbers of pitches, within a quarter."""
    w = Window.partitionBy("image_id").orderBy("x")
    j = centres_.withColumn("g", F.col("x") - F.lag("x").over(w)).join(pitches, "image_id")
    steps = F.bround(F.col("g") / F.col("cell_px"))
    ok = (steps >= 1) & (F.abs(F.col("g") - steps * F.col("cell_px")) <= 0.25 * F.col("cell_px"))
    g = j.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("ok"), F.max("cell_px").alias("p"))
    return g.select("image_id", ((F.col("n") >= 8) & (F.col("p") > 0) & (F.col("ok") >= 0.7 * (F.col("n") - 1))).alias("regular"))


def extend_columns(centres_: DataFrame, pitches: DataFrame, region: DataFrame, days: int = DAYS) -> DataFrame:
    """(image_id, cell_idx, cell_x): a regular grid from the first column on, up to a pitch past the plot."""
    first = centres_.groupBy("image_id").agg(F.min("x").alias("x"))
    cells = first.join(pitches, "image_id").join(region, "image_id").withColumn("cell_idx", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    at = F.col("x") + F.col("cell_idx") * F.col("cell_px")
    return cells.withColumn("cell_x", at).where(F.col("cell_x") <= F.col("x1") + F.col("cell_px")).select("image_id", "cell_idx", "cell_x")


def calendar_glyphs(strip: DataFrame) -> DataFrame:
    """(image_id, x, y): ink of dates in the strip of pixels below a plot, darker than its surroundings or white on a coloured pill,
    without specks under two by two pixels. Surroundings are the 15 by 15 pixels around, as far as the strip has them."""
    reach, contrast, white, colour, pill = GLYPHS
    c = hsv(F.col("r"), F.col("g"), F.col("b"))
    p = strip.select("image_id", "x", "y", gray(F.col("r"), F.col("g"), F.col("b")).alias("g"), c["s"].alias("s"), c["v"].alias("v"))
    across, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    p = p.withColumn("sum", F.sum("g").over(across.rangeBetween(-reach, reach))).withColumn("n", F.count("g").over(across.rangeBetween(-reach, reach)))
    p = p.withColumn("pill", F.max((F.col("s") >= colour).cast("int")).over(across.rangeBetween(-pill, pill)))
    p = p.withColumn("mean", F.bround(F.sum("sum").over(down.rangeBetween(-reach, reach)) / F.sum("n").over(down.rangeBetween(-reach, reach))))
    p = p.withColumn("pill", F.max("pill").over(down.rangeBetween(-pill, pill)))
    ink = p.where((F.col("g") <= F.col("mean") - contrast) | ((F.col("v") >= white) & (F.col("s") <= colour) & (F.col("pill") == 1)))
    square = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    corners = ink.select("image_id", "x", "y", square.alias("d")).groupBy("image_id", (F.col("x") - F.col("d.i")).alias("x"), (F.col("y") - F.col("d.j")).alias("y"))
    full = corners.agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    return full.select("image_id", "x", "y", square.alias("d")).select("image_id", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y")).distinct()


def lattice(glyphs: DataFrame, strips: DataFrame, days: int = DAYS) -> DataFrame:
    """(image_id, cell_idx, cell_x, cell_px): the columns of a table as a regular grid, from the ink of its dates. The pitch is the lag at
    which the ink of columns repeats, a 12th to a 60th of the width; the phase is the first of those a fortieth of a pitch
    apart at which teeth a quarter of a pitch wide hold most ink.

    strips: (image_id, x0, x1), x1 exclusive; strips that are narrow, nearly empty, or of fewer than eight columns have no grid."""
    ink, width, least, columns = LATTICE
    n = glyphs.groupBy("image_id", "x").agg(F.count(F.lit(1)).alias("n"))
    wide = strips.where(F.col("x1") - F.col("x0") >= width).withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1)))
    own = Window.partitionBy("image_id")
    profile = wide.join(n, ["image_id", "x"], "left").select("image_id", "x0", (F.col("x1") - F.col("x0")).alias("w"), (F.col("x") - F.col("x0")).alias("x"), F.coalesce("n", F.lit(0)).cast("double").alias("v"))
    profile = profile.withColumn("all", F.sum("v").over(own)).withColumn("flat", F.max("v").over(own) == F.min("v").over(own)).where((F.col("all") >= ink) & ~F.col("flat")).drop("all", "flat")
    found = axes.pitch(profile.select("image_id", "x", "v"), low=2, shares=(60, 12), until=1).select("image_id", F.col("lag").cast("double").alias("lag")).where(F.col("lag") >= least)
    step = F.greatest(F.lit(0.5), F.col("lag") / 40)
    tried = profile.join(found, "image_id").withColumn("k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("lag") / step) - 1).cast("int")))).withColumn("phase", F.col("k") * step)
    off = F.pmod(F.col("x") - F.col("phase"), F.col("lag"))
    tooth = F.greatest(F.lit(0.0), 1 - F.least(off, F.col("lag") - off) / (F.col("lag") * 0.25))
    scores = tried.groupBy("image_id", "x0", "w", "lag", "k", "phase").agg(F.round(F.sum(F.col("v") * tooth), 6).alias("score"))
    best = scores.groupBy("image_id", "x0", "w", "lag").agg(F.max(F.struct("score", (-F.col("k")).alias("k"), "phase")).alias("b"))
    cells = best.withColumn("cells", F.floor((F.col("w") - F.col("b.phase")) / F.col("lag")) + 1).where(F.col("cells") >= columns)
    each = cells.withColumn("cell_idx", F.explode(F.sequence(F.lit(0), (F.least(F.col("cells"), F.lit(days + 5)) - 1).cast("int"))))
    return each.select("image_id", "cell_idx", (F.col("x0") + F.col("b.phase") + F.col("cell_idx") * F.col("lag")).alias("cell_x"), F.col("lag").alias("cell_px"))


def row_label_boxes(dark: DataFrame, bands: DataFrame, region: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, row, x0, y0, x1, y1), ends exclusive: the box of the label that names a table's row, the leftmost letters without a wide
    gap, in the image's outer 15 % or up to 5 % into the plot; a box without width where there are none.

    dark: (image_id, x, y) of dark pixels; bands: (image_id, row, y_top, y_bot); images: (image_id, width, height)."""
    reach = bands.join(region.select("image_id", F.col("x0").alias("plot")), "image_id").join(images.select("image_id", "width", "height"), "image_id")
    end = F.least(F.col("width"), F.greatest(F.floor(F.col("width") * 0.15), F.col("plot") + F.floor(F.col("width") * 0.05)))
    reach = reach.withColumn("end", end).where("end >= 20").select("image_id", F.col("row").cast("string").alias("color"), "end", F.greatest(F.lit(0), F.col("y_top") - 2).alias("from"), F.least(F.col("height"), F.col("y_bot") + 2).alias("to"))
    inside = dark.join(_beside(reach), "image_id").where((F.col("x") < F.col("end")) & (F.col("y") >= F.col("from")) & (F.col("y") < F.col("to")))
    parts = components(inside.select("image_id", "color", "x", "y"))
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    letters = parts.where((F.col("area") >= LETTERS["area"]) & w.between(*LETTERS["width"]) & h.between(*LETTERS["height"]))
    order = Window.partitionBy("image_id", "color").orderBy("x0", "label")
    gap = F.coalesce(F.col("x0") - F.lag("x1").over(order) - 1 > LETTERS["gap"], F.lit(False))
    first = letters.withColumn("gap", gap.cast("int")).withColumn("gaps", F.sum("gap").over(order)).where("gaps = 0")
    box = first.groupBy("image_id", "color").agg(F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y1") + 1).alias("y1")).alias("b"))
    named = bands.withColumn("color", F.col("row").cast("string")).join(box, ["image_id", "color"], "left")
    side = lambda c, other: F.coalesce(f"b.{c}", other).cast("int").alias(c)
    return named.select("image_id", "row", side("x0", F.lit(0)), side("y0", F.col("y_top")), side("x1", F.lit(0)), side("y1", F.col("y_bot")))


def cells_content(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """(image_id, row_name, day, text, kind): what a table cell holds, by its row: text where OCR read some, a heart or a circle by the
    share of warm or purple pixels, a dot for anything else.

    cells: (image_id, row_name, day, x0, y0, x1, y1, ocr); a cell's rows are joined by equality, its columns by range."""
    grown = cells.where("x1 - x0 >= 3 and y1 - y0 >= 3").withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    c = hsv(F.col("r"), F.col("g"), F.col("b"))
    p = pixels.withColumn("_c", c).withColumn("_g", gray(F.col("r"), F.col("g"), F.col("b"))).select("image_id", "x", "y", "_c", "_g")
    j = grown.join(p, ["image_id", "y"], "left").where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    warm = in_band(F.col("_c"), HEART[0]) | in_band(F.col("_c"), HEART[1])
    g = j.groupBy("image_id", "row_name", "day", "ocr", "x0", "y0", "x1", "y1").agg(F.count_if(warm).alias("warm"), F.count_if(in_band(F.col("_c"), CIRCLE)).alias("purple"), F.count_if(F.col("_g") < DARK).alias("dark"), F.count_if((F.col("_g") <= DARK) | (F.col("_c.s") >= 60)).alias("any"))
    enough = F.greatest(F.lit(6), F.floor((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / 60))
    read = F.nullif(F.trim(F.coalesce("ocr", F.lit(""))), F.lit(""))
    textual = F.col("row_name").isin("calendar", "CD", "DPO")
    text = F.when(textual, F.when(F.col("dark") >= 5, read)).when(F.col("row_name") == "Sex", F.when(F.col("warm") >= enough, "♥")).when(F.col("row_name") == "CM", F.when(F.col("purple") >= enough, "●")).otherwise(F.when(F.col("any") >= 5, F.coalesce(read, F.lit("•"))))
    kind = F.when(textual, "text").when(F.col("row_name") == "Sex", "heart").when(F.col("row_name") == "CM", "circle").otherwise("icon")
    return g.select("image_id", "row_name", "day", text.alias("text"), kind.alias("kind"))


def best_rows(content: DataFrame, most: int = 7) -> DataFrame:
    """One row a name: of several with a name the fullest, then the upper; rows (image_id, idx, row_name, populated)."""
    w = Window.partitionBy("image_id", "row_name").orderBy(F.desc("populated"), "idx")
    return content.where(F.col("idx") < most).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def row_bands(pixels: DataFrame, region: DataFrame) -> DataFrame:
    """(image_id, y0, y1): bands of rows that hold something, dark or coloured: at least 8 % of the fullest row and three pixels, smoothed
    over three rows, five rows high; bands up to five rows apart are one. region: (image_id, x0, y0, x1, y1)."""
    c = pixels.join(region, "image_id").where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    ink = c.where((gray(F.col("r"), F.col("g"), F.col("b")) <= DARK) | (hsv(F.col("r"), F.col("g"), F.col("b"))["s"] >= 60))
    counts = ink.groupBy("image_id", "y").agg(F.count(F.lit(1)).alias("n"))
    rows = region.withColumn("y", F.explode(F.sequence("y0", "y1"))).select("image_id", "y").join(counts, ["image_id", "y"], "left").na.fill(0)
    w = Window.partitionBy("image_id").orderBy("y")
    smooth = F.avg("n").over(w.rowsBetween(-1, 1))
    active = rows.withColumn("s", smooth).withColumn("m", F.max("s").over(Window.partitionBy("image_id"))).where((F.col("s") >= 3.0) & (F.col("s") >= 0.08 * F.col("m")))
    bands = active.withColumn("_i", F.col("y") - F.row_number().over(w)).groupBy("image_id", "_i").agg(F.min("y").alias("y0"), F.max("y").alias("y1")).where("y1 - y0 >= 4")
    by_start = Window.partitionBy("image_id").orderBy("y0")
    starts = F.coalesce(F.col("y0") - F.lag("y1").over(by_start) > 5, F.lit(True)).cast("int")
    grouped = bands.withColumn("_new", starts).withColumn("_g", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("image_id", "_g").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("_g")
