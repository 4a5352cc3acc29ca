import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pixels as px


def table(spark, rows, schema="image_id long, color string, x int, y int"):
    return spark.createDataFrame(rows, schema)


def square(x, y, w, h, color="blue", image=1):
    return [(image, color, x + i, y + j) for i in range(w) for j in range(h)]


@pytest.mark.parametrize("rgb, want", [((0x95, 0xAE, 0xFF), "blue"), ((0xFF, 0x9E, 0x8D), "orange"), ((0x9E, 0x6F, 0xE3), "purple"), ((255, 255, 255), None), ((239, 239, 244), None)])
def test_palette(spark, rgb, want):
    got = px.segment(spark.createDataFrame([(1, 0, 0, *rgb)], "image_id long, x int, y int, r int, g int, b int")).collect()
    assert [r.color for r in got] == ([want] if want else [])


def flood(points, diagonal):
    left, out = set(points), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            x, y = stack.pop()
            part.add((x, y))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    q = (x + dx, y + dy)
                    if (diagonal or 0 in (dx, dy)) and q in left:
                        left.remove(q)
                        stack.append(q)
        xs, ys = [p[0] for p in part], [p[1] for p in part]
        out.append((len(part), min(xs), min(ys), max(xs), max(ys)))
    return sorted(out)


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_equal_flood_fill(spark, diagonal):
    rng = np.random.default_rng(4)
    points = {(int(x), int(y)) for x, y in zip(*np.nonzero(rng.random((30, 40)) < 0.45))}
    got = px.components(table(spark, [(1, "blue", x, y) for x, y in points]), diagonal).collect()
    assert sorted((r.area, r.x0, r.y0, r.x1, r.y1) for r in got) == flood(points, diagonal)


def test_squares_and_row_edges(spark):
    rows = square(0, 0, 4, 4) + square(10, 10, 5, 5) + [(2, "blue", 9, 0), (2, "blue", 0, 1)]
    got = sorted((r.image_id, r.area, r.cx, r.cy) for r in px.components(table(spark, rows)).collect())
    assert got == [(1, 16, 1.5, 1.5), (1, 25, 12.0, 12.0), (2, 1, 0.0, 1.0), (2, 1, 9.0, 0.0)]


def test_close_fills_a_gap_and_opening_keeps_long_runs(spark):
    rows = [(1, "blue", x, 5) for x in range(20) if x != 10] + [(1, "blue", 40, 5)]
    closed = {(r.x, r.y) for r in px.close(table(spark, rows)).collect()}
    assert (10, 5) in closed and (40, 5) in closed and (30, 5) not in closed
    long_ = px.open_long(table(spark, rows), F.lit(10)).collect()
    assert [(r.start, r.end) for r in long_] == [(0, 9)]


def test_plot_region_methods(spark):
    images = spark.createDataFrame([(i, 1000, 800) for i in range(4)], "image_id long, width int, height int")
    ink = spark.createDataFrame([(0, 100, 200, 700, 400), (1, 100, 200, 700, 400)], "image_id long, x0 int, y0 int, x1 int, y1 int")
    grid = spark.createDataFrame([(0, 150, 500), (2, 100, 600)], "image_id long, y0 int, y1 int")
    got = {r.image_id: (r.x0, r.y0, r.x1, r.y1, r.method) for r in px.plot_region(images, ink, grid).collect()}
    assert got == {0: (90, 145, 710, 505, "ink+grid"), 1: (94, 194, 706, 406, "ink"), 2: (100, 100, 920, 600, "grid"), 3: (100, 80, 920, 576, "fallback")}


def test_rings_go_to_their_colour(spark):
    ring = [(1, "orange", round(50 + 6 * np.cos(a)), round(50 + 6 * np.sin(a))) for a in np.linspace(0, 2 * np.pi, 400)]
    faint = [(1, "blue", 50, y) for y in range(40, 60)]
    found = spark.createDataFrame([(1, 7, 50.0, 50.0, 30), (1, 8, 200.0, 200.0, 90)], "image_id long, blob long, cx double, cy double, area long")
    got = px.centres(found, table(spark, ring + faint).distinct()).collect()
    assert [(r.blob, r.color, r.radius, r.kind) for r in got] == [(7, "orange", 6, "ring")]


def test_markers_snap_in_order(spark):
    cells = spark.createDataFrame([(1, i, 100.0 + 40 * i, 40.0) for i in range(6)], "image_id long, cell_idx int, cell_x double, cell_px double")
    marks = spark.createDataFrame([(1, "temp", x, 1.0) for x in (100.0, 118.0, 121.0, 126.0, 260.0, 400.0)], "image_id long, series string, cx double, cy double")
    got = sorted((r.cell_idx, r.cx) for r in px.snap(marks, cells).collect())
    assert got == [(0, 100.0), (1, 118.0), (2, 126.0), (4, 260.0)]


def test_line_sampling_skips_the_cover_line(spark):
    region = spark.createDataFrame([(1, 0, 0, 399, 199)], "image_id long, x0 int, y0 int, x1 int, y1 int")
    mask = table(spark, [(1, "blue", x, 100) for x in range(400)] + [(1, "blue", x, 50 + x // 10 + d) for x in range(200) for d in (0, 1)]).distinct()
    cells = spark.createDataFrame([(1, i, 20.0 + 40 * i, 40.0) for i in range(10)], "image_id long, cell_idx int, cell_x double, cell_px double")
    cover = px.cover_line(mask, region)
    assert [r.y for r in cover.collect()] == [100.0]
    got = {r.cell_idx: r.cy for r in px.sample_line(mask, region, cells, cover).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and abs(got[2] - 60.5) < 1
    assert abs(px.ink_span(mask, region).first().span - 1.0) < 1e-9


def test_grid_lines_pitch_and_tiling(spark):
    grid = table(spark, [(1, "grid", x + d, y) for x in range(0, 800, 40) for d in (0, 1) for y in range(200)])
    lines = sorted(r.x for r in px.vertical_lines(grid, spark.createDataFrame([(1, 0, 0, 800, 200)], "image_id long, x0 int, y0 int, x1 int, y1 int")).collect())
    assert lines[:3] == [0.5, 40.5, 80.5] and len(lines) == 20
    marks = spark.createDataFrame([(1, float(x), 800) for x in range(100, 261, 40)], "image_id long, cx double, w int")
    pitches = px.modal_pitch(marks, F.col("w"))
    assert abs(pitches.first().cell_px - 41.0) <= 1
    cells = {r.cell_idx: r.cell_x for r in px.tile(marks.select("image_id", "cx"), spark.createDataFrame([(1, 40.0)], "image_id long, cell_px double")).collect()}
    assert len(cells) == 35 and all(abs(cells[i] - (100 + 40 * i)) < 21 for i in range(5))


def test_grid_source(spark):
    region = spark.createDataFrame([(i, 0, 800) for i in range(5)], "image_id long, x0 int, x1 int")
    dates = spark.createDataFrame([(0, 40.0 * k) for k in range(20)], "image_id long, x double")
    lines = spark.createDataFrame([(i, 40.0 * k) for i in (0, 1) for k in range(20)], "image_id long, x double")
    hints = spark.createDataFrame([(0, 40.0, 40.0), (1, 40.0, None), (2, 40.0, 42.0), (3, 20.0, 40.0)], "image_id long, autocorr double, spacing double")
    got = {r.image_id: (r.source, r.cell_px) for r in px.choose_grid(dates, lines, hints, region).collect()}
    assert got == {0: ("date-row", 40.0), 1: ("gridlines", 40.0), 2: ("autocorr", 40.0), 3: ("marker-spacing", 40.0), 4: ("uniform", 800 / 35)}


def test_lh_colour_and_choice(spark):
    marks = spark.createDataFrame([(1, "purple")] * 5 + [(1, "orange")] + [(2, "purple")] * 2, "image_id long, color string")
    spans = spark.createDataFrame([(2, "purple", 0.9), (2, "orange", 0.3), (3, "purple", 0.9), (3, "orange", 0.8)], "image_id long, color string, span double")
    images = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "image_id long")
    assert {r.image_id: r.lh_color for r in px.lh_colour(marks, spans, images).collect()} == {1: "purple", 2: "purple", 3: "orange", 4: "orange"}
    c = spark.createDataFrame([(0.9, 10, 30, 20), (0.75, 10, 30, 20), (0.75, 20, 30, 25), (0.9, 25, 30, 20)], "s double, m int, c int, n int")
    assert [r.x for r in c.select(px.line_or_markers(F.col("s"), F.col("m"), F.col("c"), F.col("n")).alias("x")).collect()] == ["line", "line", "markers", "markers"]


@pytest.mark.parametrize("text, idx, want", [("C.D", 0, "CD"), ("SYMPTONS", 5, "Symptoms"), ("ym", 9, "row9"), ("March", 3, "calendar"), (None, 2, "DPO"), ("", 12, "row12"), ("xDPOx", 0, "DPO"), ("zzz", 6, "hCG"), ("symtoms", 0, "calendar")])
def test_row_names(spark, text, idx, want):
    assert spark.createDataFrame([(text, idx)], "t string, i int").select(px.row_name(F.col("t"), F.col("i")).alias("n")).first().n == want


def test_table_rows_and_cells(spark):
    glyphs = spark.createDataFrame([(1, cy + d, 5, int(cy) - 4, 20, int(cy) + 4) for cy in (100.0, 140.0, 180.0) for d in (0.0, 2.0, 3.0)], "image_id long, cy double, x0 int, y0 int, x1 int, y1 int")
    rows = sorted((r.row, round(r.cy, 2)) for r in px.row_centres(glyphs).collect())
    assert rows == [(1, 101.67), (2, 141.67), (3, 181.67)]
    ink = [(1, x, y, 232, 130, 95) for x in range(2, 10) for y in range(2, 10)] + [(1, x, y, 120, 120, 120) for x in range(22, 28) for y in range(2, 6)]
    cells = [(1, "Sex", 1, 0, 0, 12, 12, None), (1, "Sex", 2, 20, 0, 32, 12, None), (1, "CD", 2, 20, 0, 32, 12, " 7 "), (1, "hCG", 2, 20, 0, 32, 12, ""), (1, "CM", 1, 0, 0, 12, 12, None)]
    got = {(r.row_name, r.day): (r.text, r.kind) for r in px.cells_content(spark.createDataFrame(ink, "image_id long, x int, y int, r int, g int, b int"), spark.createDataFrame(cells, "image_id long, row_name string, day int, x0 int, y0 int, x1 int, y1 int, ocr string")).collect()}
    assert got == {("Sex", 1): ("♥", "heart"), ("Sex", 2): (None, "heart"), ("CD", 2): ("7", "text"), ("hCG", 2): ("•", "icon"), ("CM", 1): (None, "circle")}
    best = px.best_rows(spark.createDataFrame([(1, 0, "CD", 3), (1, 1, "CD", 9), (1, 2, "Sex", 0), (1, 8, "CM", 4)], "image_id long, idx int, row_name string, populated int"))
    assert sorted((r.idx, r.row_name) for r in best.collect()) == [(1, "CD"), (2, "Sex")]


def test_regular_columns(spark):
    pitches = spark.createDataFrame([(1, 20.0), (2, 20.0)], "image_id long, cell_px double")
    xs = spark.createDataFrame([(1, 20.0 * k + k % 3) for k in range(12)] + [(2, 33.0 * k) for k in range(12)], "image_id long, x double")
    assert {r.image_id: r.regular for r in px.regular(xs, pitches).collect()} == {1: True, 2: False}
    region = spark.createDataFrame([(1, 0, 200)], "image_id long, x0 int, x1 int")
    assert px.extend_columns(xs.where("image_id = 1"), pitches, region).count() == 12


def test_bounds_of_ink_and_white_blobs(spark):
    parts = spark.createDataFrame([(1, "ink", 1, 900, 10, 10, 200, 60, 0.0, 0.0), (1, "ink", 2, 100, 300, 300, 310, 310, 0.0, 0.0), (1, "ink", 3, 3000, 0, 400, 500, 402, 0.0, 0.0)], "image_id long, color string, label long, area long, x0 int, y0 int, x1 int, y1 int, cx double, cy double")
    r = px.ink_box(parts).first()
    assert (r.x0, r.y0, r.x1, r.y1) == (10, 10, 200, 60)
    assert [b.blob for b in px.blobs(parts.withColumn("area", F.col("area") / 10)).collect()] == [2]
    grid = table(spark, [(1, "grid", x, y) for y in (10, 60, 110) for x in range(100)])
    assert [(r.y0, r.y1) for r in px.grid_band(grid, spark.createDataFrame([(1, 400, 300)], "image_id long, width int, height int")).collect()] == [(10, 110)]


def test_visible_days(spark):
    p = spark.createDataFrame([(1, 20), (2, 35)], "image_id long, n int")
    s = spark.createDataFrame([(1, 300.0, 10.0), (2, 420.0, 10.0)], "image_id long, ink_width double, cell_px double")
    assert sorted(tuple(r) for r in px.visible_days(p, s).collect()) == [(1, 31, False), (2, 43, True)]


def test_smoothing_keeps_flat_colour_and_single_pixels(spark):
    flat = spark.createDataFrame([(1, x, y, 40 * (x // 3), 7, 9) for x in range(6) for y in range(4)] + [(2, 5, 5, 1, 2, 3)], "image_id long, x int, y int, r int, g int, b int")
    got = {(r.image_id, r.x, r.y): (r.r, r.g, r.b) for r in px.blur(flat).collect()}
    assert got[2, 5, 5] == (1, 2, 3) and len(got) == 25
    assert [got[1, x, 2] for x in range(6)] == [(0, 7, 9), (0, 7, 9), (10, 7, 9), (30, 7, 9), (40, 7, 9), (40, 7, 9)]


def test_calendar_columns_by_two_kinds_of_gaps(spark):
    digits = [(1, 20.0 + 40 * k + 9 * d, 17 + 40 * k + 9 * d, 23 + 40 * k + 9 * d) for k in range(12) for d in range(1 + (k >= 4))]
    got = sorted((r.x, r.cell_px) for r in px.calendar_columns(spark.createDataFrame(digits, "image_id long, cx double, x0 int, x1 int")).collect())
    assert [x for x, _ in got] == [20.0 + 40 * k + 4.5 * (k >= 4) for k in range(12)] and got[0][1] == 40.0


def test_level_that_parts_two_classes(spark):
    g = spark.createDataFrame([(1, v) for v in [20] * 30 + [25] * 10 + [200] * 50 + [210] * 9] + [(2, 5)], "image_id long, g int")
    assert {r.image_id: r.level for r in px.split_level(g).collect()} == {1: 25}


def strip(spark, seed, w=60, h=14):
    rng = np.random.default_rng(seed)
    rgb = np.full((h, w, 3), 255)
    rgb[2:12, 30:56] = (230, 90, 200)
    rgb[rng.random((h, w)) < 0.25] = 255
    rgb[rng.random((h, w)) < 0.2] = (60, 60, 60)
    df = spark.createDataFrame([(1, x, y, *map(int, rgb[y, x])) for y in range(h) for x in range(w)], "image_id long, x int, y int, r int, g int, b int")
    return rgb, df


def test_calendar_glyphs_equal_the_plain_definition(spark):
    rgb, df = strip(spark, 3)
    got = {(r.x, r.y) for r in px.calendar_glyphs(df).collect()}
    c = {(r.x, r.y): (r.g, r.c.s, r.c.v) for r in df.select("x", "y", px.gray(F.col("r"), F.col("g"), F.col("b")).alias("g"), px.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect()}
    ink = set()
    for (x, y), (g, s, v) in c.items():
        around = [q[0] for (a, b), q in c.items() if abs(a - x) <= 7 and abs(b - y) <= 7]
        pill = any(q[1] >= 60 for (a, b), q in c.items() if abs(a - x) <= 4 and abs(b - y) <= 4)
        if g <= round(sum(around) / len(around)) - 6 or (v >= 225 and s <= 60 and pill):
            ink.add((x, y))
    square = lambda x, y: {(x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1)}
    want = set().union(*(square(x, y) for x, y in ink if square(x, y) <= ink))
    assert got == want and got


def test_lattice_finds_dates_with_gaps_and_leaves_empty_strips_out(spark):
    rows = [(1, 40 + 23 * k + d, y) for k in range(15) if k not in (3, 4, 9) for d in range(6) for y in range(8 - abs(d - 2))]
    rows += [(2, 50, 1)] + [(3, x, 1) for x in range(400)]
    found = px.lattice(spark.createDataFrame(rows, "image_id long, x int, y int"), spark.createDataFrame([(1, 20, 420), (2, 20, 420), (3, 0, 400), (4, 0, 30)], "image_id long, x0 int, x1 int")).collect()
    cells = sorted((r.cell_x, r.cell_px) for r in found)
    assert {r.image_id for r in found} == {1} and {p for _, p in cells} == {23.0}
    assert all(min(abs(42.2 + 23 * k - x) for x, _ in cells) < 1.5 for k in range(15))


def test_row_label_boxes_stop_at_a_wide_gap(spark):
    dark = [(1, x + i, 52 + j) for x in (10, 20, 30, 60) for i in range(5) for j in range(8)] + [(1, 5, 90)]
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    bands, region, images = t([(1, 0, 50, 62), (1, 1, 85, 95)], "image_id long, row int, y_top int, y_bot int"), t([(1, 90)], "image_id long, x0 int"), t([(1, 600, 400)], "image_id long, width int, height int")
    got = {r.row: (r.x0, r.y0, r.x1, r.y1) for r in px.row_label_boxes(t(dark, "image_id long, x int, y int"), bands, region, images).collect()}
    assert got == {0: (10, 52, 35, 60), 1: (0, 85, 0, 95)}


def test_network_input_of_a_flat_image_is_flat(spark):
    from tidemark.operators import vision

    p = spark.createDataFrame([(1, x, y, 10, 20, 30, 0 if x == 0 else 255) for x in range(6) for y in range(5)], "image_id long, x int, y int, r int, g int, b int, a int")
    out = vision.network_input(p.where("x > 0").withColumn("x", F.col("x") - 1), spark.createDataFrame([(1, 5, 5)], "image_id long, width int, height int")).collect()
    assert len(out) == 3 * 384 * 224
    for k, v in enumerate((10, 20, 30)):
        assert {round(r.value, 9) for r in out if r.channel == k} == {round((v / 255 - vision.MEAN[k]) / vision.DEVIATION[k], 9)}
    clear = vision.network_input(p.where("x = 0"), spark.createDataFrame([(1, 1, 5)], "image_id long, width int, height int"), 2, 2).collect()
    assert {round(r.value, 9) for r in clear if r.channel == 0} == {round((1 - vision.MEAN[0]) / vision.DEVIATION[0], 9)}


def test_pixels_exploded_from_few_images_are_not_broadcast(spark):
    ids = lambda: spark.range(300).select(F.col("id").alias("image_id")).distinct()
    pixels = ids().selectExpr("image_id", "'grid' as color", "explode(sequence(0, 199, 20)) as x").selectExpr("*", "explode(sequence(0, 99)) as y")
    table = lambda *columns: ids().selectExpr("image_id", *columns)
    lines = px.vertical_lines(pixels, table("0 as x0", "0 as y0", "200 as x1", "100 as y1"))
    boxes = px.row_label_boxes(pixels.where("y < 10").select("image_id", "x", "y"), table("0 as row", "0 as y_top", "20 as y_bot"), table("60 as x0"), table("600 as width", "400 as height"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan by the estimates alone
    try:
        assert "Broadcast" not in plan(lines)
        assert "SortMergeJoin" in plan(boxes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert lines.count() == 300 * 10 and boxes.count() == 300
