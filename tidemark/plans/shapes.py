"""Queries of shapes on charts (lines, markers, cells, labels), of drawn series and of single runs, over inputs that follow from
the ids in `events` by integer rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import axes
from tidemark.operators import charts as chart
from tidemark.operators import pixels as px
from tidemark.operators import stores, vision
from tidemark.plans import charts, cycles
from tidemark.plans.marks import _I, _K, _each, _images
from tidemark.sources import files, synthetic

_REGION = ("20 as x0", "10 as y0", "419 as x1", "110 as y1")


def chart_ink_box(spark, sf_dir):
    x0, y0 = "40 + 30 * k + image_id % 5", "50 + 20 * k"
    parts = _each(spark, sf_dir, 8).selectExpr(
        "image_id", "'ink' as color", "k as label", "if(k = 7, 900, 60 + (image_id + 3) * k * 37 % 500) as area", f"cast({x0} as int) as x0", f"cast({y0} as int) as y0",
        f"cast({x0} + if(k = 7, 300, 20 + image_id * k % 60) as int) as x1", f"cast({y0} + if(k = 7, 3, 10 + (image_id + k) % 40) as int) as y1",
    )
    return px.ink_box(parts)


def pale_band(spark, sf_dir):
    rows = _each(spark, sf_dir, 6).selectExpr("image_id", "cast(30 + 12 * k + image_id % 4 as int) as y", "explode(sequence(10, 9 + if(k = 5, 30, 60 + 10 * k))) as x", "'grid' as color")
    return px.grid_band(rows, _images(spark, sf_dir, "cast(400 + 40 * (image_id % 10) as int) as width"))


def marker_blobs(spark, sf_dir):
    box = "40 * k as x0", "50 as y0", "cast(40 * k + (image_id + k) % 30 as int) as x1", "cast(50 + (image_id * 3 + k) % 28 as int) as y1"
    parts = _each(spark, sf_dir, 7).selectExpr("image_id", "cast(k as long) as label", "cast((image_id * 13 + k * 29) % 400 as long) as area", *box, "cast(40 * k as double) as cx", "50.0d as cy")
    return px.blobs(parts)


def marker_centres(spark, sf_dir):
    found = _each(spark, sf_dir, 3).selectExpr("image_id", "cast(k as long) as blob", "cast(40 + 60 * k as double) as cx", "cast(50 + image_id % 20 as double) as cy", "cast(30 + 20 * k + image_id % 25 as long) as area")
    at = found.selectExpr("*", "get(array(4, 6, 9), cast(blob as int)) as r", "get(array('blue', 'orange', 'purple'), cast((image_id + blob) % 3 as int)) as color")
    ring = at.selectExpr("*", "explode(sequence(0, 31 - cast(image_id % 24 as int))) as j")
    mask = ring.selectExpr("image_id", "color", "cast(bround(cx + r * cos(j * pi() / 16)) as int) as x", "cast(bround(cy + r * sin(j * pi() / 16)) as int) as y")
    return px.centres(found, mask)


def snapped_markers(spark, sf_dir):
    cells = _each(spark, sf_dir, 12).selectExpr("image_id", "k as cell_idx", "cast(30 + 20 * k as double) as cell_x", "20.0d as cell_px")
    marks = _each(spark, sf_dir, 12).where("(k + image_id) % 4 <> 0").selectExpr("image_id", "'temp' as series", "cast(30 + 20 * k + image_id * k % 13 - 6 as double) as cx", "cast(100 + k as double) as cy")
    return px.snap(marks, cells)


def cover_height(spark, sf_dir):
    lines = _each(spark, sf_dir, 3).selectExpr("image_id", "'blue' as color", "cast(if(k = 2, 40, 60 + image_id % 10 + k) as int) as y", "explode(sequence(50, cast(if(k = 2, 74, 89 + 60 * (image_id % 5)) as int))) as x")
    return px.cover_line(lines, _images(spark, sf_dir, *_REGION))


def upright_lines(spark, sf_dir):
    tall = "explode(sequence(10, if(k = 3 and image_id % 3 = 0, 30, 109))) as y"
    lines = _each(spark, sf_dir, 8).selectExpr("image_id", "k", "'grid' as color", tall).selectExpr("image_id", "color", "y", "explode(sequence(0, k % 2)) as d", "cast(40 + (12 + image_id % 9) * k as int) as x0")
    return px.vertical_lines(lines.selectExpr("image_id", "color", "x0 + d as x", "y"), _images(spark, sf_dir, *_REGION))


def tiled_cells(spark, sf_dir):
    marks = _each(spark, sf_dir, 9).selectExpr("image_id", "cast(50 + 60 * k + (image_id + k * k) % 7 as double) as cx")
    return px.tile(marks, _images(spark, sf_dir, "60.0d as cell_px")).select("image_id", "cell_idx", F.round("cell_x", 4).alias("cell_x"))


def extended_columns(spark, sf_dir):
    first = _each(spark, sf_dir, 3).selectExpr("image_id", "cast(25 + image_id % 7 + k * 15 as double) as x")
    cells = px.extend_columns(first, _images(spark, sf_dir, "cast(10 + image_id % 13 as double) as cell_px"), _images(spark, sf_dir, *_REGION))
    return cells.select("image_id", "cell_idx", "cell_x")


def repaired_labels(spark, sf_dir):
    e = _each(spark, sf_dir, 10).selectExpr("cast(image_id as string) as column_id", "cast(100 + 20 * k as double) as cy", "case when (k + image_id) % 5 = 0 then '' when (k + image_id) % 7 = 0 then '999' else cast(cast(37.5 - 0.1 * k as decimal(4,1)) as string) end as text")
    return chart.repair_labels(e).select("column_id", "cy", F.round("value", 3).alias("value"))


def table_row_centres(spark, sf_dir):
    cy = "200 + 30 * (k div 3) + image_id % 5 + k % 3"
    glyphs = _each(spark, sf_dir, 15).selectExpr("image_id", f"cast({cy} as double) as cy", "cast(10 + 8 * (k % 3) as int) as x0", f"cast({cy} - 4 as int) as y0", "cast(16 + 8 * (k % 3) as int) as x1", f"cast({cy} + 4 as int) as y1")
    return px.row_centres(glyphs).select("image_id", "cy", "x0", "y0", "x1", "y1")


def table_cells(spark, sf_dir):
    names = ", ".join(f"'{r}'" for r in px.ROWS)
    cells = _each(spark, sf_dir, 7).selectExpr("image_id", f"get(array({names}), k) as row_name", "k as day", "10 + 20 * k as x0", "10 as y0", "20 + 20 * k as x1", "20 as y1", "if(image_id % 4 = 0, ' ', concat('x', k)) as ocr")
    dots = _each(spark, sf_dir, 7).selectExpr("image_id", "k", "explode(sequence(0, 99)) as i").selectExpr("image_id", "10 + 20 * k + i % 10 as x", "10 + i div 10 as y", "if(i < image_id % 12, cast((image_id + k) % 3 as int), 3) as c")
    rgb = [f"get(array({v}), c) as {n}" for n, v in (("r", "10, 230, 150, 255"), ("g", "10, 60, 90, 255"), ("b", "10, 60, 220, 255"))]
    return px.cells_content(dots.selectExpr("image_id", "x", "cast(y as int) as y", *rgb), cells)


def table_documents(spark, sf_dir):
    cells = _each(spark, sf_dir, 6).where("(image_id + k) % 3 <> 0").selectExpr("image_id", "if(k < 3, 'CD', 'Sex') as row_name", "k as day", "concat('t', image_id % 10) as text", "'text' as kind")
    return files.table_json(cells, ("calendar", "CD", "Sex"))


def resized_pixels(spark, sf_dir):
    p = _each(spark, sf_dir, 48).selectExpr("image_id", "k % 8 as x", "cast(k div 8 as int) as y", *[f"cast((image_id * 31 + k * {m}) % 256 as int) as {c}" for c, m in (("r", 17), ("g", 29), ("b", 41))])
    small, large = (files.resize(p, s).select("image_id", F.lit(s).alias("scale"), "x", "y", "r", "g", "b") for s in (0.5, 2.0))
    return small.unionAll(large)


def work_sizes(spark, sf_dir):
    s = _images(spark, sf_dir, "cast(300 + image_id * 97 % 4000 as int) as w", "cast(200 + image_id * 53 % 3000 as int) as h")
    return s.select("image_id", files.work_size(F.col("w"), F.col("h")).alias("s")).select("image_id", "s.width", "s.height", F.round("s.scale", 6).alias("scale"))


def measured_days(spark, sf_dir):
    days = charts.truth(spark, sf_dir).selectExpr("id", "series", "day", "cast((id + day) % 9 as double) as value", "cast((id * 3 + day) % 5 as double) / 4 as present")
    return vision.measured(days).select("id", "series", "day", "value")


def drawn_lh(spark, sf_dir):
    r = cycles.readings(spark, sf_dir)
    both = [shape(r).select("cycle_id", "day", F.lit(name).alias("shape"), F.round("lh", 6).alias("lh")) for name, shape in (("ratio", synthetic.ratio_shape), ("level", synthetic.level_shape))]
    return both[0].unionAll(both[1])


def drawn_places(spark, sf_dir):
    p = _each(spark, sf_dir, 3).selectExpr("image_id", "k", "cast((image_id * 7 + k * 31) % 73 as double) / 72 as place", "cast(350 + (image_id + k) % 40 as double) / 10 as celsius")
    return p.select("image_id", "k", F.round(synthetic.snap_to_grid(F.col("place")), 6).alias("place"), F.round(synthetic.to_fahrenheit(F.col("celsius")), 6).alias("fahrenheit"))


def calendar_glyphs(spark, sf_dir):
    p = _each(spark, sf_dir, 480).selectExpr("image_id", "k % 40 as x", "cast(k div 40 as int) as y")
    p = p.withColumn("c", F.expr("case when x >= 20 and (x + image_id) % 5 < 2 and y between 3 and 8 then 2 when x >= 20 then 1 when (x + image_id) % 7 < 1 + image_id % 3 and y % 6 < 4 then 0 else 2 end"))
    rgb = [f"get(array({v}), c) as {n}" for n, v in (("r", "40, 230, 255"), ("g", "40, 90, 255"), ("b", "40, 200, 255"))]
    return px.calendar_glyphs(p.selectExpr("image_id", "x", "y", *rgb)).select("image_id", "x", "y")


def date_lattice(spark, sf_dir):
    glyphs = _each(spark, sf_dir, 14).selectExpr("image_id", "k", "explode(sequence(0, 4)) as d").selectExpr("image_id", "cast(30 + image_id % 6 + (20 + image_id % 5) * k + d as int) as x", "explode(sequence(0, 5 - d)) as y")
    return px.lattice(glyphs, _images(spark, sf_dir, "20 as x0", "420 as x1")).select("image_id", "cell_idx", F.round("cell_x", 6).alias("cell_x"), "cell_px")


def row_label_boxes(spark, sf_dir):
    k = _each(spark, sf_dir, 8).where("image_id % 5 <> 0 or k >= 4")
    dots = k.selectExpr("image_id", "k", "explode(sequence(0, 34)) as i").selectExpr("image_id", "cast(30 + 9 * (k % 4) + if(k % 4 >= 2, image_id % 12, 0) + i % 5 as int) as x", "cast(200 + 40 * (k div 4) + i div 5 as int) as y")
    bands = _each(spark, sf_dir, 2).selectExpr("image_id", "k as row", "198 + 40 * k as y_top", "210 + 40 * k as y_bot")
    return px.row_label_boxes(dots, bands, _images(spark, sf_dir, "60 as x0"), _images(spark, sf_dir, "600 as width", "400 as height"))


def network_input(spark, sf_dir):
    p = _each(spark, sf_dir, 180).selectExpr("image_id", "k % 20 as x", "cast(k div 20 as int) as y", *[f"cast((image_id * 31 + k * {m}) % 256 as int) as {c}" for c, m in (("r", 17), ("g", 29), ("b", 41))], "if(k % 9 = 0, 100, 255) as a")
    planes = vision.network_input(p, _images(spark, sf_dir, "20 as width", "9 as height"), 12, 14)
    return planes.select("image_id", "channel", "y", "x", F.round("value", 6).alias("value"))


def reader_choice(spark, sf_dir):
    i = _images(spark, sf_dir, "get(array('none', 'template', 'paddle'), cast(image_id % 3 as int)) as prefer", "case when image_id % 4 < 3 then image_id % 4 = 0 end as has_model")
    return i.select("image_id", axes.reader(F.col("prefer"), F.col("has_model")).alias("reader"))


def run_history_get(spark, sf_dir):
    r = charts.runs(spark, sf_dir)
    newest = r.groupBy("owner").agg(F.max("id").alias("id"))
    return stores.chosen(r, newest).select("id", "owner", "created_at", "title")


def run_history_count(spark, sf_dir):
    return stores.counted(charts.runs(spark, sf_dir), "owner")


def run_history_clear(spark, sf_dir):
    return stores.counted(stores.cleared(charts.runs(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        chart_ink_box, pale_band, marker_blobs, marker_centres, snapped_markers, cover_height, upright_lines, tiled_cells, extended_columns, repaired_labels, table_row_centres,
        table_cells, table_documents, resized_pixels, work_sizes, measured_days, drawn_lh, drawn_places, calendar_glyphs, date_lattice, row_label_boxes, network_input, reader_choice, run_history_get, run_history_count, run_history_clear,
    )
}

_TOP = "first_value(day) over (partition by cycle_id order by lh desc nulls last, day)"
ORACLE_SQL = {
    "chart_ink_box": f"""with {_K.format(_I, 7)}, p as (select image_id, k, 60 + (image_id + 3) * k * 37 % 500 as area, 40 + 30 * k + image_id % 5 as x0, 50 + 20 * k as y0 from e), m as (select *, max(area) over (partition by image_id) as m from p)
        select image_id, min(x0)::int as x0, min(y0)::int as y0, max(x0 + 20 + image_id * k % 60)::int as x1, max(y0 + 10 + (image_id + k) % 40)::int as y1 from m where area >= greatest(80, m // 4) group by 1""",
    "pale_band": f"""with {_K.format(_I, 5)} select image_id, min(30 + 12 * k + image_id % 4)::int as y0, max(30 + 12 * k + image_id % 4)::int as y1 from e
        where 60 + 10 * k >= (400 + 40 * (image_id % 10)) // 8 group by 1 having count(*) >= 2""",
    "marker_blobs": f"""with {_K.format(_I, 7)}, p as (select *, (image_id + k) % 30 + 1 as w, (image_id * 3 + k) % 28 + 1 as h, (image_id * 13 + k * 29) % 400 as area from e)
        select image_id, k::bigint as blob, (40 * k)::double as cx, 50::double as cy, area::bigint as area from p where area between 4 and 360 and w between 3 and 26 and h between 3 and 26 and 100 * w between 35 * h and 260 * h""",
    "marker_centres": f"""with {_K.format(_I, 3)}, f as (select image_id, k, (40 + 60 * k)::double as cx, (50 + image_id % 20)::double as cy, 30 + 20 * k + image_id % 25 as area, [4, 6, 9][k + 1] as r, ((image_id + k) % 3)::int as c from e),
        m as (select distinct image_id, c, round_even(cx + r * cos(j * pi() / 16), 0)::int as x, round_even(cy + r * sin(j * pi() / 16), 0)::int as y from f cross join range(0, 32) t(j) where j <= 31 - image_id % 24),
        p as (select image_id, k, cx, cy, area, q.r as radius, round_even(cx + q.r * cos(j * pi() / 16), 0)::int as x, round_even(cy + q.r * sin(j * pi() / 16), 0)::int as y from f cross join range(0, 32) t(j) cross join (select unnest([3, 4, 5, 6, 7, 8, 9, 11, 14]) as r) q),
        s as (select image_id, k, cx, cy, area, c, radius, count(*) as n from p join m using (image_id, x, y) group by all)
        select image_id, k::bigint as blob, ['blue', 'orange', 'purple'][c + 1] as color, cx, cy, n / 32::double as score, radius::int as radius, case when area > 60 then 'filled' else 'ring' end as kind from s
        qualify row_number() over (partition by image_id, k order by n desc, c, radius) = 1 and n / 32::double >= 0.3""",
    "snapped_markers": f"with {_K.format(_I, 12)} select image_id, 'temp' as series, k as cell_idx, (30 + 20 * k + image_id * k % 13 - 6)::double as cx, (100 + k)::double as cy from e where (k + image_id) % 4 <> 0",
    "cover_height": f"with {_I} select image_id, 'blue' as color, 60 + image_id % 10 + 0.5::double as y from i where 40 + 60 * (image_id % 5) >= 160",
    "upright_lines": f"with {_K.format(_I, 8)} select image_id, 40 + (12 + image_id % 9) * k + (k % 2) / 2::double as x from e where k <> 3 or image_id % 3 <> 0",
    "tiled_cells": f"""with {_K.format(_I, 9)}, m as (select image_id, 50 + 60 * k + (image_id + k * k) % 7 as cx from e), s as (select *, min(cx) over (partition by image_id) - 30 as f from m),
        t as (select image_id, f, o, sum(least((cx - f - o + 600) % 60, 60 - (cx - f - o + 600) % 60)) as err from s cross join range(-30, 31) r(o) group by 1, 2, 3),
        b as (select * from t qualify row_number() over (partition by image_id order by err, o) = 1)
        select image_id, d::int as cell_idx, (f + o + 60 * d + 30)::double as cell_x from b cross join range(0, 35) r(d)""",
    "extended_columns": f"""with {_K.format(_I, 35)}, c as (select image_id, k, (25 + image_id % 7 + k * (10 + image_id % 13))::double as x from e) select image_id, k as cell_idx, x as cell_x from c where x <= 429 + image_id % 13""",
    "repaired_labels": f"with {_K.format(_I, 10)} select image_id::varchar as column_id, (100 + 20 * k)::double as cy, round(37.5::double - k / 10::double, 3) as value from e",
    "table_row_centres": f"with {_K.format(_I, 5)}, c as (select image_id, (200 + 30 * k + image_id % 5)::int as y from e) select image_id, (y + 1)::double as cy, 10 as x0, y - 4 as y0, 32 as x1, y + 6 as y1 from c",
    "table_cells": f"""with {_K.format(_I, 7)}, c as (select image_id, k, image_id % 12 as n, (image_id + k) % 3 as c, case when image_id % 4 <> 0 then 'x' || k end as ocr from e)
        select image_id, [{", ".join(f"'{r}'" for r in px.ROWS)}][k + 1] as row_name, k as day,
          case when k < 3 then case when n >= 5 then ocr end when k = 3 then case when n >= 6 and c = 1 then '♥' end when k = 4 then case when n >= 6 and c = 2 then '●' end when n >= 5 then coalesce(ocr, '•') end as text,
          case when k < 3 then 'text' when k = 3 then 'heart' when k = 4 then 'circle' else 'icon' end as kind from c""",
    "table_documents": f"""with {_K.format(_I, 6)}, c as (select image_id, k < 3 as cd, string_agg('{{"day":' || k || ',"text":"t' || image_id % 10 || '","kind":"text"}}', ',' order by k) as s from e where (image_id + k) % 3 <> 0 group by 1, 2)
        select image_id, '{{"rows":[{{"name":"calendar","cells":[]}},{{"name":"CD","cells":[' || max(s) filter (cd) || ']}},{{"name":"Sex","cells":[' || max(s) filter (not cd) || ']}}]}}' as json from c group by 1""",
    "resized_pixels": f"""with {_K.format(_I, 48)}, p as (select image_id, k % 8 as x, k // 8 as y, (image_id * 31 + k * 17) % 256 as r, (image_id * 31 + k * 29) % 256 as g, (image_id * 31 + k * 41) % 256 as b from e)
        select image_id, 0.5::double as scale, (x // 2)::int as x, (y // 2)::int as y, round_even(avg(r), 0)::int as r, round_even(avg(g), 0)::int as g, round_even(avg(b), 0)::int as b from p group by image_id, x // 2, y // 2
        union all select image_id, 2::double, (2 * x + dx)::int, (2 * y + dy)::int, r::int, g::int, b::int from p cross join range(0, 2) u(dx) cross join range(0, 2) v(dy)""",
    "work_sizes": f"""with {_I}, s as (select image_id, 300 + image_id * 97 % 4000 as w, 200 + image_id * 53 % 3000 as h from i), t as (select *, case when w < 1200 then 1200::double / w when w > 2400 then 2400::double / w else 1::double end as s from s)
        select image_id, round_even(w * s, 0)::int as width, round_even(h * s, 0)::int as height, round(s, 6) as scale from t""",
    "measured_days": f"with {cycles.CHARTS} select id, series, day, case when (id * 3 + day) % 5 >= 3 then ((id + day) % 9)::double end as value from ch",
    "drawn_lh": f"""with {cycles.READINGS}, t as (select cycle_id, day, lh, max(lh) over (partition by cycle_id) as top, (day - {_TOP})::double as d from r)
        select cycle_id, day, 'ratio' as shape, case when lh is not null then round(0.25::double + (top - 0.25::double) * exp(-pow(abs(d), 1.6::double)), 6) end as lh from t
        union all select cycle_id, day, 'level', case when lh is not null then round(5::double + 90::double * exp(-pow(d / 2.5::double, 2) / 2), 6) end from t""",
    "drawn_places": f"""with {_K.format(_I, 3)} select image_id, k, round(round_even((image_id * 7 + k * 31) % 73 / 4::double, 0) / 18, 6) as place, round((350 + (image_id + k) % 40) * 9 / 50::double + 32, 6) as fahrenheit from e""",
    "calendar_glyphs": f"""with {_I}, p as (select image_id, (k % 40)::int as x, (k // 40)::int as y from i cross join range(0, 480) t(k)),
        q as (select *, case when x >= 20 and (x + image_id) % 5 < 2 and y between 3 and 8 then 2 when x >= 20 then 1 when (x + image_id) % 7 < 1 + image_id % 3 and y % 6 < 4 then 0 else 2 end as c from p),
        g as (select image_id, x, y, c, [40, 144, 255][c + 1] as g from q),
        n as (select a.image_id, a.x, a.y, a.c, a.g, avg(b.g) as mean, max((b.c = 1 and abs(a.x - b.x) <= 4 and abs(a.y - b.y) <= 4)::int) as pill from g a join g b on a.image_id = b.image_id and abs(a.x - b.x) <= 7 and abs(a.y - b.y) <= 7 group by all),
        ink as (select image_id, x, y from n where g <= round_even(mean, 0) - 6 or (c = 2 and pill = 1)),
        f as (select image_id, x - i as x, y - j as y from ink cross join range(0, 2) u(i) cross join range(0, 2) v(j) group by all having count(*) = 4)
        select distinct image_id, (x + i)::int as x, (y + j)::int as y from f cross join range(0, 2) u(i) cross join range(0, 2) v(j)""",
    "date_lattice": f"""with {_I}, s as (select image_id, 10 + image_id % 6 as x, 20 + image_id % 5 as p from i), v as (select image_id, p, x + p * k + d as x, 6 - d as v from s cross join range(0, 14) t(k) cross join range(0, 5) u(d)),
        f as (select image_id, p, x, v, f, f * (p / 40::double) as phase from v cross join range(0, 40) r(f)), o as (select *, (x - phase + 600 * p) % p as o from f),
        t as (select image_id, p, f, phase, round(sum(v * greatest(0::double, 1 - least(o, p - o) / (p * 0.25::double))), 6) as score from o group by 1, 2, 3, 4),
        b as (select * from t qualify row_number() over (partition by image_id order by score desc, f) = 1)
        select image_id, c::int as cell_idx, round(20 + phase + c * p, 6) as cell_x, p::double as cell_px from b cross join range(0, 40) r(c) where phase + c * p <= 400""",
    "row_label_boxes": f"""with {_K.format(_I, 2)}, b as (select *, image_id % 5 <> 0 or k = 1 as named from e)
        select image_id, k as row, case when named then 30 else 0 end as x0, (case when named then 200 else 198 end + 40 * k)::int as y0,
          (case when not named then 0 when image_id % 12 <= 6 then 30 + 27 + image_id % 12 + 5 else 44 end)::int as x1, (case when named then 207 else 210 end + 40 * k)::int as y1 from b""",
    "network_input": f"""with {_K.format(_I, 180)}, c as (select image_id, k % 20 as x, k // 20 as y, k, unnest([0, 1, 2]) as channel, unnest([17, 29, 41]) as m from e),
        p as (select image_id, x, y, channel, case when k % 9 = 0 then floor(((image_id * 31 + k * m) % 256 * 100 + 255 * 155) / 255::double + 0.5::double) else (image_id * 31 + k * m) % 256 end as v from c),
        h as (select image_id, channel, i as x, y, floor(round(sum(v * w) / sum(w), 6) + 0.5::double) as v from (select p.*, t.i, 1 - abs(x + 0.5::double - (t.i + 0.5::double) * 20 / 12) / (20 / 12::double) as w from p cross join range(0, 12) t(i)) where w > 0 group by 1, 2, 3, 4),
        d as (select image_id, channel, x, i as y, floor(round(sum(v * w) / sum(w), 6) + 0.5::double) as v from (select h.*, t.i, 1 - abs(y + 0.5::double - (t.i + 0.5::double) * 9 / 14) as w from h cross join range(0, 14) t(i)) where w > 0 group by 1, 2, 3, 4)
        select image_id, channel, y::int as y, x::int as x, round((v / 255::double - [0.485, 0.456, 0.406][channel + 1]::double) / [0.229, 0.224, 0.225][channel + 1]::double, 6) as value from d""",
    "reader_choice": f"with {_I} select image_id, case image_id % 3 when 0 then 'noop' when 1 then 'template' else case when image_id % 4 = 0 then 'paddle' else 'template' end end as reader from i",
    "run_history_get": f"with {charts._RUNS} select id, owner, created_at, title from ru qualify row_number() over (partition by owner order by id desc) = 1",
    "run_history_count": f"with {charts._RUNS} select owner, count(*) as runs from ru group by 1",
    "run_history_clear": "select 0::bigint as runs",
}
