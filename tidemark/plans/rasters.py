"""Queries of the vision operators over masks, labels and predictions that follow from `events` by integer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import pixels as px
from tidemark.operators import series, vision
from tidemark.plans import charts, cycles


def _ids(spark, sf_dir) -> DataFrame:
    return charts._ids(spark, sf_dir)


def mask(spark, sf_dir) -> DataFrame:
    """The dots of charts.pixels without every fifth pixel's column inside, as a mask."""
    p = charts.pixels(spark, sf_dir).where("a >= 32 and r = 214")
    return p.where("(x + y) % 5 <> 0").select("image_id", F.lit("blue").alias("color"), "x", "y").distinct()


def segment_ink(spark, sf_dir):
    k = F.col("cycle_id") % 5
    pick = lambda v: F.get(F.array(*[F.lit(x) for x in v]), k.cast("int"))
    p = _ids(spark, sf_dir).select(F.col("cycle_id").alias("image_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), pick([0x95, 0xFF, 0x9E, 255, 239]).alias("r"), pick([0xAE, 0x9E, 0x6F, 255, 239]).alias("g"), pick([0xFF, 0x8D, 0xE3, 255, 244]).alias("b"))
    return px.segment(p).select("image_id", "color")


def mask_runs(spark, sf_dir):
    return px.runs(mask(spark, sf_dir)).select("image_id", "y", F.col("start").alias("x0"), F.col("end").alias("x1"))


def mask_dilated(spark, sf_dir):
    return px.dilate(mask(spark, sf_dir), 2, 1).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 7 + F.col("y")).alias("s"))


def mask_closed(spark, sf_dir):
    return px.close(mask(spark, sf_dir)).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 7 + F.col("y")).alias("s"))


def component_boxes(spark, sf_dir):
    p = charts.pixels(spark, sf_dir).where("a >= 32 and r = 214").select("image_id", F.lit("blue").alias("color"), "x", "y").distinct()
    return px.components(p).select("image_id", "area", "x0", "y0", "x1", "y1")


def _region(spark, sf_dir) -> DataFrame:
    return _ids(spark, sf_dir).select(F.col("cycle_id").alias("image_id"), F.lit(40).alias("x0"), F.lit(0).alias("y0"), F.lit(339).alias("x1"), F.lit(400).alias("y1"))


def ink_span(spark, sf_dir):
    return px.ink_span(mask(spark, sf_dir), _region(spark, sf_dir)).select("image_id", F.round("span", 6).alias("span"))


def line_samples(spark, sf_dir):
    cells = _ids(spark, sf_dir).select(F.col("cycle_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(26))).alias("cell_idx")).withColumn("cell_x", 40.0 + F.col("cell_idx") * 11).withColumn("cell_px", F.lit(11.0))
    return px.sample_line(mask(spark, sf_dir), _region(spark, sf_dir), cells).select("image_id", "cell_idx", F.round("cy", 6).alias("cy"), F.round("score", 6).alias("score"))


def date_centres(spark, sf_dir):
    d = _ids(spark, sf_dir).select(F.col("cycle_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    d = d.select("image_id", (F.floor(F.col("k") / 2) * (20 + F.col("image_id") % 9) + (F.col("k") % 2) * 3).cast("double").alias("x"))
    return px.date_centres(d).select("image_id", F.round("x", 6).alias("x"))


_TEXTS = ["CD", " d.p.o ", "SEX", "symptons", "Mar", "", "zzz", "hCG+", "cm", "April", "?"]
_NAMES = {"CD": "CD", " d.p.o ": "DPO", "SEX": "Sex", "symptons": "Symptoms", "Mar": "calendar", "hCG+": "hCG", "cm": "CM", "April": "calendar"}


def row_names(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, _TEXTS)), (F.col("cycle_id") % len(_TEXTS)).cast("int"))
    return _ids(spark, sf_dir).select("cycle_id", px.row_name(text, (F.col("cycle_id") % 9).cast("int")).alias("name"))


def plot_region(spark, sf_dir):
    i = _ids(spark, sf_dir).withColumnRenamed("cycle_id", "image_id")
    images = i.select("image_id", F.lit(1000).alias("width"), F.lit(800).alias("height"))
    ink = i.where("image_id % 3 <> 0").selectExpr("image_id", "cast(100 + image_id % 50 as int) as x0", "cast(200 + image_id % 40 as int) as y0", "cast(700 + image_id % 90 as int) as x1", "cast(400 + image_id % 200 as int) as y1")
    grid = i.where("image_id % 4 <> 0").selectExpr("image_id", "cast(150 + image_id % 30 as int) as y0", "cast(160 + (image_id % 11) * 60 as int) as y1")
    return px.plot_region(images, ink, grid)


def grid_choice(spark, sf_dir):
    i = _ids(spark, sf_dir).withColumnRenamed("cycle_id", "image_id")
    region = i.select("image_id", F.lit(0).alias("x0"), F.lit(800).alias("x1"))
    dates = i.where("image_id % 3 = 0").select("image_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")).selectExpr("image_id", "cast(k * 40 as double) as x")
    lines = i.where("image_id % 2 = 0").select("image_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")).selectExpr("image_id", "cast(k * 50 as double) as x")
    hints = i.selectExpr("image_id", "case when image_id % 5 <> 0 then cast(30 + image_id % 30 as double) end as autocorr", "case when image_id % 7 <> 0 then cast(40 + image_id % 10 as double) end as spacing")
    return px.choose_grid(dates, lines, hints, region).select("image_id", "source", F.round("cell_px", 6).alias("cell_px"))


def lh_colour(spark, sf_dir):
    i = _ids(spark, sf_dir).withColumnRenamed("cycle_id", "image_id")
    marks = i.selectExpr("image_id", "explode(concat(array_repeat('purple', cast(image_id % 9 as int)), array_repeat('orange', cast(image_id % 4 as int)), array('blue'))) as color")
    spans = i.selectExpr("image_id", "'purple' as color", "cast(image_id % 11 as double) / 10 as span").unionAll(i.selectExpr("image_id", "'orange'", "cast(image_id % 6 as double) / 10"))
    return px.lh_colour(marks, spans, i)


def line_choice(spark, sf_dir):
    i = F.col("cycle_id")
    return _ids(spark, sf_dir).select("cycle_id", px.line_or_markers((i % 21).cast("double") / 20, i % 30, F.lit(30), i % 36).alias("method"))


def visible_days(spark, sf_dir):
    i = _ids(spark, sf_dir).withColumnRenamed("cycle_id", "image_id")
    return px.visible_days(i.selectExpr("image_id", "cast(image_id % 36 as int) as n"), i.selectExpr("image_id", "cast(200 + image_id % 300 as double) as ink_width", "cast(8 + image_id % 7 as double) as cell_px"))


def regular_columns(spark, sf_dir):
    i = _ids(spark, sf_dir).withColumnRenamed("cycle_id", "image_id")
    xs = i.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).selectExpr("image_id", "cast(k * 20 + (k * image_id) % 11 as double) as x")
    return px.regular(xs, i.select("image_id", F.lit(20.0).alias("cell_px")))


def table_best_rows(spark, sf_dir):
    i = _ids(spark, sf_dir).select(F.col("cycle_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("idx"))
    rows = i.selectExpr("image_id", "idx", "element_at(array('CD', 'DPO', 'Sex'), cast((image_id + idx) % 3 + 1 as int)) as row_name", "cast((image_id * 7 + idx * 5) % 13 as int) as populated")
    return px.best_rows(rows)


def soft_argmax(spark, sf_dir):
    c = charts.truth(spark, sf_dir).where("present = 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    heat = c.select("id", "series", "day", (F.col("k") / 4).alias("y"), ((F.col("id") + F.col("k") * 3) % 5).cast("double").alias("logit"))
    return vision.soft_argmax(heat).select("id", "series", "day", F.round("value", 6).alias("value"))


def _compared(spark, sf_dir) -> DataFrame:
    t = charts.truth(spark, sf_dir)
    return t.select("id", "value", ((F.col("id") + F.col("day")) % 3 > 0).cast("int").alias("present"), (((F.col("id") + F.col("day")) % 9 + 1) / 10).alias("probability"), (F.col("value") + ((F.col("id") + F.col("day")) % 7).cast("double") / 50).alias("true_value"), F.col("present").alias("true_present"))


def vision_losses(spark, sf_dir):
    return vision.losses(_compared(spark, sf_dir)).select(F.round("value_loss", 8).alias("value_loss"), F.round("presence_loss", 8).alias("presence_loss"))


def vision_scores(spark, sf_dir):
    return vision.evaluate_predictions(_compared(spark, sf_dir)).select(*[F.round(c, 8).alias(c) for c in ("mae", "precision", "recall", "f1")])


def series_usable(spark, sf_dir):
    thin = charts.truth(spark, sf_dir).withColumn("present", F.when((F.col("id") % 4 == 0) & (F.col("day") % 15 != 0), 0).otherwise(F.col("present")))
    return vision.usable(thin)


def normalise_series(spark, sf_dir):
    r = cycles.readings(spark, sf_dir).where("temp is not null")
    return r.select("cycle_id", "day", F.round(series.normalise(F.col("temp") / 100, F.lit(36.2), F.lit(36.5)), 6).alias("value"))


def request_states(spark, sf_dir):
    i = F.col("cycle_id")
    body = F.when(i % 7 == 1, "not json").when(i % 7 == 2, '{"lang": "en"}').when(i % 7 == 3, '{"image": "http://x"}').otherwise('{"image": "data:image/png;base64,AA", "lang": "fr"}')
    answer = F.when(i % 5 == 0, "sorry").when(i % 5 == 1, '```json\n{"scale": "celsius"}\n```').otherwise('{"scale": "fahrenheit"}')
    code = F.when(i % 11 == 0, F.lit(None)).when(i % 11 == 1, 500).otherwise(200)
    return _ids(spark, sf_dir).select("cycle_id", vision.request_state(i % 13 != 0, body, answer, code.cast("int")).alias("s")).select("cycle_id", "s.code", "s.error", "s.lang")


def answer_days(spark, sf_dir):
    i = F.col("cycle_id").cast("double")
    a = _ids(spark, sf_dir).select(F.col("cycle_id").alias("id"), F.when(F.col("cycle_id") % 2 == 0, "fahrenheit").otherwise("celsius").alias("scale"), F.array(36.5 + i % 3, F.lit(None), 97.0 + i % 4).alias("temp"), F.array(i % 2, F.lit(1.0)).alias("lh"))
    return vision.answer_days(a).select("id", "series", "day", F.round("value", 6).alias("value"), "present")


def row_bands(spark, sf_dir):
    p = charts.pixels(spark, sf_dir).where("a >= 32").select("image_id", "x", "y", "r", "g", "b")
    return px.row_bands(p, _region(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        segment_ink, mask_runs, mask_dilated, mask_closed, component_boxes, ink_span, line_samples, date_centres, row_names, plot_region, grid_choice, lh_colour, line_choice, visible_days,
        regular_columns, table_best_rows, soft_argmax, vision_losses, vision_scores, series_usable, normalise_series, request_states, answer_days, row_bands,
    )
}

_IDS = f"{cycles.READINGS}, ids as (select distinct cycle_id from r), i as (select cycle_id as image_id from ids)"
_MASK = f"{charts._RASTER}, dots as (select distinct image_id, x, y from px where a >= 32 and r = 214), mk as (select * from dots where (x + y) % 5 <> 0)"
_GROWN = "select distinct image_id, x + dx.dx as x, y + dy.dy as y from mk cross join range(-{0}, {0} + 1) dx(dx) cross join range(-{1}, {1} + 1) dy(dy)"
_CMP = f"""{cycles.CHARTS}, cm as (select value, ((id + day) % 3 > 0)::int as present, ((id + day) % 9 + 1) / 10 as p, value + ((id + day) % 7)::double / 50 as tv, present as tp from ch)"""

ORACLE_SQL = {
    "request_states": f"""with {_IDS}, s as (select cycle_id, case when cycle_id % 13 = 0 then 'cloud_unavailable' when cycle_id % 7 = 1 then 'bad_request' when cycle_id % 7 in (2, 3) then 'missing_image' when cycle_id % 11 = 0 then 'upstream_unreachable'
          when cycle_id % 11 = 1 then 'upstream_error' when cycle_id % 5 = 0 then 'unparseable_model_output' end as error from ids)
        select cycle_id, (case error when 'cloud_unavailable' then 503 when 'bad_request' then 400 when 'missing_image' then 400 else case when error is null then 200 else 502 end end)::int as code, error, case cycle_id % 7 when 1 then null when 2 then 'en' when 3 then null else 'fr' end as lang from s""",
    "answer_days": f"""with {_IDS}, d as (select cycle_id as id, day::int as day, cycle_id % 2 = 0 as f from ids cross join range(0, 35) t(day)),
        v as (select id, 'temp' as series, day, case day when 0 then 36.5::double + id % 3 when 2 then 97::double + id % 4 end as v, case when f then 95::double else 35.6::double end as lo, case when f then 99.5::double else 37.4::double end as hi from d
          union all select id, 'lh', day, case day when 0 then (id % 2)::double when 1 then 1::double end, 0.1::double, 1.9::double from d)
        select id, series, day, round(case when v is null then 0 else greatest(0, least(1, (v - lo) / (hi - lo))) end, 6) as value, (v is not null)::int as present from v""",
    "row_bands": f"""with {charts._RASTER}, rg as (select distinct cycle_id as image_id from r), c as (select image_id, y, count(*) as n from px where a >= 32 and r = 214 and x between 40 and 339 and y between 0 and 400 group by 1, 2),
        ro as (select image_id, t.y::int as y, coalesce(n, 0) as n from rg cross join range(0, 401) t(y) left join c using (image_id, y)), s as (select *, avg(n) over (partition by image_id order by y rows between 1 preceding and 1 following) as s from ro),
        a as (select * from (select *, max(s) over (partition by image_id) as m from s) where s >= 3 and s >= 0.08 * m), b as (select image_id, min(y) as y0, max(y) as y1 from (select *, y - row_number() over (partition by image_id order by y) as k from a) group by image_id, k having max(y) - min(y) >= 4),
        g as (select *, sum(nw) over (partition by image_id order by y0) as g from (select *, coalesce(y0 - lag(y1) over (partition by image_id order by y0) > 5, true)::int as nw from b))
        select image_id, min(y0) as y0, max(y1) as y1 from g group by image_id, g""",
    "segment_ink": f"with {_IDS} select image_id, (['blue', 'orange', 'purple'])[image_id % 5 + 1] as color from i where image_id % 5 < 3",
    "mask_runs": f"with {_MASK}, s as (select *, x - row_number() over (partition by image_id, y order by x) as k from mk) select image_id, y, min(x) as x0, max(x) as x1 from s group by image_id, y, k",
    "mask_dilated": f"with {_MASK}, g as ({_GROWN.format(2, 1)}) select image_id, count(*) as n, sum(x * 7 + y)::bigint as s from g group by 1",
    "mask_closed": f"""with {_MASK}, g as ({_GROWN.format(1, 1)}), v as (select image_id, x + dx.dx as x, y + dy.dy as y, count(*) as n from g cross join range(-1, 2) dx(dx) cross join range(-1, 2) dy(dy) group by 1, 2, 3)
        select image_id, count(*) as n, sum(x * 7 + y)::bigint as s from v where n = 9 group by 1""",
    "component_boxes": f"with {charts._RASTER} select cycle_id as image_id, 9::bigint as area, min(cx) - 1 as x0, min(cy) - 1 as y0, min(cx) + 1 as x1, min(cy) + 1 as y1 from px0 where k = 0 group by cycle_id, cx",
    "ink_span": f"with {_MASK} select image_id, round(count(distinct x) / 300, 6) as span from mk where x between 40 and 339 and y between 0 and 400 group by 1",
    "line_samples": f"""with {_MASK}, c as (select image_id, k::int as cell_idx, 40 + k * 11 as cx from (select distinct image_id from mk) cross join range(0, 27) t(k)),
        s as (select c.image_id, cell_idx, y from c join mk on mk.image_id = c.image_id and mk.x between c.cx - 3 and c.cx + 3 and y between 0 and 400),
        m as (select image_id, cell_idx, median(y) as med from s group by 1, 2 having count(*) >= 4)
        select s.image_id, s.cell_idx, round(avg(y), 6) as cy, round(least(1, count(*) / 20), 6) as score from s join m using (image_id, cell_idx) where abs(y - med) <= 6.6 group by 1, 2 having count(*) >= 4""",
    "date_centres": f"with {_IDS} select image_id, round(k * (20 + image_id % 9) + 1.5::double, 6) as x from i cross join range(0, 10) t(k)",
    "row_names": f"""with {_IDS}, t as (select cycle_id, ([{', '.join(cycles._q(_NAMES.get(x)) for x in _TEXTS)}])[cycle_id % {len(_TEXTS)} + 1] as n, cycle_id % 9 as idx from ids)
        select cycle_id, coalesce(n, case when idx < 7 then ([{', '.join(cycles._q(x) for x in px.ROWS)}])[idx + 1] else 'row' || idx end) as name from t""",
    "plot_region": f"""with {_IDS}, j as (select image_id, image_id % 3 <> 0 as hi, image_id % 4 <> 0 as hg, 100 + image_id % 50 as ix0, 200 + image_id % 40 as iy0, 700 + image_id % 90 as ix1, 400 + image_id % 200 as iy1, 150 + image_id % 30 as gy0, 160 + (image_id % 11) * 60 as gy1 from i),
        h as (select *, greatest(40, iy1 - iy0) as ih from j), g as (select *, case when gy1 - gy0 < 0.4 * ih then iy0 else greatest(gy0, iy0 - ih) end as a, case when gy1 - gy0 < 0.4 * ih then iy1 else least(gy1, iy1 + ih) end as b from h),
        m as (select *, greatest(2, (ix1 - ix0) // 60) as mx, greatest(2, floor((b - a) / 60)) as my, greatest(3, (iy1 - iy0) // 30) as pad from g)
        select image_id, (case when hi and hg then greatest(0, ix0 - mx) when hi then greatest(0, ix0 - pad) else 100 end)::int as x0, (case when hi and hg then greatest(0, a - my) when hi then greatest(0, iy0 - pad) when hg then gy0 else 80 end)::int as y0,
          (case when hi and hg then least(999, ix1 + mx) when hi then least(999, ix1 + pad) else 920 end)::int as x1, (case when hi and hg then greatest(0, least(799, b + my)) when hi then least(799, iy1 + pad) when hg then gy1 else 576 end)::int as y1,
          case when hi and hg then 'ink+grid' when hi then 'ink' when hg then 'grid' else 'fallback' end as method from m""",
    "grid_choice": f"""with {_IDS}, h as (select image_id, case when image_id % 5 <> 0 then (30 + image_id % 30)::double end as ac, case when image_id % 7 <> 0 then (40 + image_id % 10)::double end as sp from i),
        g as (select *, image_id % 3 = 0 and (ac is null or 40 between ac * 0.7 and ac * 1.3) as d, image_id % 2 = 0 and (ac is null or 50 between ac * 0.7 and ac * 1.3) as l, ac is null or coalesce(abs(ac - sp) / greatest(ac, sp) > 0.25, false) as us from h)
        select image_id, case when d then 'date-row' when l then 'gridlines' when us and sp is not null then 'marker-spacing' when ac is not null then 'autocorr' else 'uniform' end as source,
          round(case when d then 40 when l then 50 when us and sp is not null then sp when ac is not null then ac else 800 / 35 end::double, 6) as cell_px from g""",
    "lh_colour": f"with {_IDS} select image_id, case when (image_id % 9 >= 4 and image_id % 9 > image_id % 4 + 2) or ((image_id % 11)::double / 10 >= 0.70::double and (image_id % 11)::double / 10 > (image_id % 6)::double / 10 + 0.25::double) then 'purple' else 'orange' end as lh_color from i",
    "line_choice": f"with {_IDS}, s as (select cycle_id, (cycle_id % 21)::double / 20 as s, cycle_id % 30 as m, cycle_id % 36 as n from ids) select cycle_id, case when (s >= 0.88::double or (s >= 0.70::double and m < 0.70::double * s * 30)) and n > m then 'line' else 'markers' end as method from s",
    "visible_days": f"with {_IDS}, d as (select image_id, greatest(image_id % 36, floor((200 + image_id % 300) / (8 + image_id % 7)) + 1) as d from i) select image_id, d::int as visible_days, d > 35 as truncated from d",
    "regular_columns": f"""with {_IDS}, x as (select image_id, k * 20 + (k * image_id) % 11 as x from i cross join range(0, 12) t(k)), g as (select image_id, x - lag(x) over (partition by image_id order by x) as g from x)
        select image_id, count_if(coalesce(round_even(g / 20, 0) >= 1 and abs(g - round_even(g / 20, 0) * 20) <= 5, false)) >= 0.7 * 11 as regular from g group by 1""",
    "table_best_rows": f"""with {_IDS}, s as (select image_id, k::int as idx, (['CD', 'DPO', 'Sex'])[(image_id + k) % 3 + 1] as row_name, ((image_id * 7 + k * 5) % 13)::int as populated from i cross join range(0, 7) t(k))
        select * from s qualify row_number() over (partition by image_id, row_name order by populated desc, idx) = 1""",
    "soft_argmax": f"""with {cycles.CHARTS}, e as (select id, series, day, k / 4 as y, exp(((id + k * 3) % 5)::double) as w from ch cross join range(0, 5) t(k) where present = 1)
        select id, series, day, round(sum(w * y) / sum(w), 6) as value from e group by 1, 2, 3""",
    "vision_losses": f"""with {_CMP} select round(coalesce(avg(case when tp = 1 then case when abs(value - tv) < 0.05::double then 0.5::double * abs(value - tv) * abs(value - tv) / 0.05::double else abs(value - tv) - 0.025::double end end), 0), 8) as value_loss,
        round(avg(-case when tp = 1 then ln(p) else ln(1 - p) end), 8) as presence_loss from cm""",
    "vision_scores": f"""with {_CMP}, g as (select avg(case when tp = 1 then abs(value - tv) end) as mae, count_if(tp = 1 and present = 1) as a, count_if(tp = 0 and present = 1) as b, count_if(tp = 1 and present = 0) as c from cm)
        select round(mae, 8) as mae, round(a / (a + b), 8) as precision, round(a / (a + c), 8) as recall, round(2 * a / (2 * a + b + c), 8) as f1 from g""",
    "series_usable": f"with {cycles.CHARTS} select id, series, count_if(present = 1 and (id % 4 <> 0 or day % 15 = 0)) >= 3 as enabled from ch group by 1, 2",
    "normalise_series": f"with {cycles.READINGS} select cycle_id, day, round(greatest(0, least(1, (temp / 100 - 36.2::double) / greatest(1e-6, 36.5::double - 36.2::double))), 6) as value from r where temp is not null",
}
