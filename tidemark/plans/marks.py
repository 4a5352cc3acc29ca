"""Queries of label, grid and prediction operators over inputs that follow from the ids in `events` by integer rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import charts as chart
from tidemark.operators import digitize, models, pixels, vision
from tidemark.plans import charts, cycles


def _images(spark, sf_dir, *columns: str):
    return charts._ids(spark, sf_dir).selectExpr("cycle_id as image_id", *columns)


def _each(spark, sf_dir, n: int):
    return _images(spark, sf_dir, f"explode(sequence(0, {n - 1})) as k")


def label_columns(spark, sf_dir):
    boxes = _each(spark, sf_dir, 12).selectExpr("image_id", "if(k < 8, 'left', 'right') as side", "cast(20 + (k % 3) * 60 + (image_id + k) % 7 as double) as cx", "cast(k * 30 as double) as cy", "cast(k as string) as text")
    return chart.label_columns(boxes)


def even_ticks(spark, sf_dir):
    e = _each(spark, sf_dir, 9).where("k = 8 or (k + image_id) % 5 <> 0")
    return chart.even_ticks(e.selectExpr("cast(image_id as string) as column_id", "cast(if(k = 8, 400, 100 + 40 * k) as double) as cy", "cast(k as double) as value"))


def calendar_columns(spark, sf_dir):
    cx = "20 + (30 + image_id % 9) * k + 9 * d"
    d = _each(spark, sf_dir, 12).selectExpr("image_id", "k", "explode(array(0, 1)) as d")
    return pixels.calendar_columns(d.selectExpr("image_id", f"cast({cx} as double) as cx", f"cast({cx} - 3 as int) as x0", f"cast({cx} + 3 as int) as x1"))


def modal_pitch(spark, sf_dir):
    marks = _each(spark, sf_dir, 9).selectExpr("image_id", "cast(50 + (k + if(k > 5, 2, 0)) * (16 + 2 * (image_id % 10)) as double) as cx")
    return pixels.modal_pitch(marks, F.lit(800))


def plot_guess(spark, sf_dir):
    g = _images(spark, sf_dir, "cast(300 + image_id % 97 as int) as w", "cast(200 + image_id % 89 as int) as h")
    return g.select("image_id", digitize.plot_guess(F.col("w"), F.col("h")).alias("g")).select("image_id", "g.*")


def consent_config(spark, sf_dir):
    c = _images(spark, sf_dir, "image_id % 2 = 0 as consent", "image_id % 3 = 0 as enabled", "cast(image_id % 11 as double) / 10 as share")
    return c.select("image_id", vision.consent_config(F.col("consent"), F.col("enabled"), F.col("share")).alias("c")).select("image_id", "c.*")


def decoded_outputs(spark, sf_dir):
    o = charts.truth(spark, sf_dir).selectExpr("id", "series", "day", "cast((id * 7 + day * 3) % 31 as double) / 20 - 0.2 as value", "cast((id + day) % 9 - 4 as double) as logit")
    return vision.decode(o).select("id", "series", "day", "present", F.round("value", 6).alias("value"), F.round("probability", 6).alias("probability"))


def refined_plot(spark, sf_dir):
    region = _images(spark, sf_dir, "0 as x0", "cast(100 + image_id % 7 as int) as y0", "500 as x1", "cast(400 + image_id % 11 as int) as y1", "'ink' as method")
    anchors = _images(spark, sf_dir, "cast(image_id % 8 as int) as n_fit", "cast(110 + image_id % 5 as double) + 0.5 as top", "cast(220 + image_id % 150 as double) + 0.5 as low").where("image_id % 6 <> 0")
    return chart.refine_plot(region, anchors)


def placed_values(spark, sf_dir):
    p = _images(spark, sf_dir, "cast(image_id % 300 as double) as cy", "if(image_id % 3 = 0, null, 38.0d) as a", "-0.01d as b", "cast(20 + image_id % 5 as int) as y0", "cast(260 + image_id % 7 as int) as y1")
    return p.select("image_id", F.round(chart.place_value(F.col("cy"), F.col("a"), F.col("b"), F.lit(35.6), F.lit(37.4), F.col("y0"), F.col("y1")), 6).alias("value"))


def value_strip(spark, sf_dir):
    days = charts.truth(spark, sf_dir).selectExpr("id", "series", "day", "cast((id + day) % 20 as double) / 20 as value", "present")
    return chart.value_strip(days, F.lit(35.0), F.lit(37.0)).select("id", "series", "day", "text")


def stratified_split(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id as cycle_id", "event_type as label")
    rest, part = models.split(rows, "label", 0.2, 42)
    return rest.selectExpr("label", "0 as part").unionAll(part.selectExpr("label", "1 as part")).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (label_columns, even_ticks, calendar_columns, modal_pitch, plot_guess, consent_config, decoded_outputs, refined_plot, placed_values, value_strip, stratified_split)}

_I = f"{cycles.READINGS}, i as (select distinct cycle_id as image_id from r)"
_K = "{0}, e as (select image_id, k::int as k from i cross join range(0, {1}) t(k))"

ORACLE_SQL = {
    "label_columns": f"""with {_K.format(_I, 12)} select image_id, case when k < 8 then 'left' else 'right' end as side, (20 + (k % 3) * 60 + (image_id + k) % 7)::double as cx, (k * 30)::double as cy, k::varchar as text, (k % 3)::int as "column" from e""",
    "even_ticks": f"with {_K.format(_I, 8)} select image_id::varchar as column_id, (100 + 40 * k)::double as cy, k::double as value from e where (k + image_id) % 5 <> 0",
    "calendar_columns": f"with {_K.format(_I, 12)} select image_id, (20 + (30 + image_id % 9) * k + 4.5)::double as x, (30 + image_id % 9)::double as cell_px from e",
    "modal_pitch": f"with {_I} select image_id, (17 + 2 * (image_id % 10))::double as cell_px from i",
    "plot_guess": f"""with {_I}, g as (select image_id, 300 + image_id % 97 as w, 200 + image_id % 89 as h from i), m as (select *, floor(w::double * 0.1::double + 0.5::double)::int as mx, floor(h::double * 0.08::double + 0.5::double)::int as my from g)
        select image_id, mx as x0, my as y0, (w - mx)::int as x1, (h - my)::int as y1 from m""",
    "consent_config": f"with {_I} select image_id, (image_id % 2 = 0 and image_id % 3 = 0) as cloud_enabled, case when image_id % 2 = 0 then (image_id % 11)::double / 10 else 0 end as cloud_share, image_id % 2 = 0 as consent_given from i",
    "decoded_outputs": f"""with {cycles.CHARTS}, dq as (select id, series, day, ((id * 7 + day * 3) % 31)::double / 20 - 0.2::double as v, 1::double / (1 + exp(-((id + day) % 9 - 4)::double)) as p from ch)
        select id, series, day, (p >= 0.5)::int as present, case when p >= 0.5 then round(greatest(0::double, least(1::double, v)), 6) end as value, round(p, 6) as probability from dq""",
    "refined_plot": f"""with {_I}, g as (select image_id, (100 + image_id % 7)::int as y0, (400 + image_id % 11)::int as y1, image_id % 8 as n, 110 + image_id % 5 as top, 220 + image_id % 150 as low from i), h as (select *, (image_id % 6 <> 0 and n >= 4 and low - top >= 0.55::double * (y1 - y0)) as good from g)
        select image_id, 0 as x0, (case when good then top else y0 end)::int as y0, 500 as x1, (case when good then low else y1 end)::int as y1, case when good then 'ink+axiscol' else 'ink' end as method from h""",
    "placed_values": f"""with {_I}, p as (select image_id, (image_id % 300)::double as cy, 20 + image_id % 5 as y0, 260 + image_id % 7 as y1 from i)
        select image_id, round(greatest(0::double, least(1::double, case when image_id % 3 = 0 then (y1 - cy) / (y1 - y0)::double else (38::double + -0.01::double * cy - 35.6::double) / (37.4::double - 35.6::double) end)), 6) as value from p""",
    "value_strip": f"with {cycles.CHARTS} select id, series, day, case when present = 1 then printf('%.2f', 35::double + (id + day) % 20 / 10::double) else '' end as text from ch",
    "stratified_split": "with c as (select event_type as label, count(*) as n from events group by 1), k as (select *, floor(n * 0.2::double + 0.5::double)::bigint as p from c), s as (select label, 0 as part, n - p as n from k union all select label, 1, p from k) select * from s where n > 0",
}
