"""Queries over charts, evaluations and stores. Rasters, axis labels, predictions and runs are derived from `events` by
integer rules, the same in Spark and in the DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.copy import LABELS
from tidemark.functions.numbers import parse_number, parse_tick
from tidemark.operators import axes, digitize, evaluate, stores, vision
from tidemark.plans import cycles



def _sql(df: DataFrame, **columns: str) -> DataFrame:
    """df's columns by Spark SQL expressions."""
    return df.select(*[F.expr(x).alias(k) for k, x in columns.items()])


def _ids(spark, sf_dir) -> DataFrame:
    return cycles.readings(spark, sf_dir).select("cycle_id").distinct()


# --- rasters: a 3 x 3 dot for each temperature, grid and transparent pixels ---


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cycles.readings(spark, sf_dir).where("temp is not null").selectExpr("cycle_id", "40 + (day - 1) * 11 as cx", "cast(300 - (temp - 3600) * 2 as int) as cy")
    kinds = F.explode(F.sequence(F.lit(0), F.lit(10)))
    d = d.withColumn("k", kinds)
    x = F.when(F.col("k") < 9, F.col("cx") + F.col("k") % 3 - 1).otherwise(F.col("cx"))
    y = F.when(F.col("k") < 9, F.col("cy") + F.floor(F.col("k") / 3) - 1).otherwise(F.col("cy") + 20 * (F.col("k") - 8))
    r, g, b = (F.when(F.col("k") == 9, grid).otherwise(curve) for grid, curve in ((230, 214), (230, 68), (235, 127)))
    return d.select(F.col("cycle_id").alias("image_id"), x.cast("int").alias("x"), y.cast("int").alias("y"), r.alias("r"), g.alias("g"), b.alias("b"), F.when(F.col("k") == 10, 10).otherwise(255).alias("a"))


def calibration(spark, sf_dir) -> DataFrame:
    c = _ids(spark, sf_dir).select(F.col("cycle_id").alias("image_id"), F.lit("temp").alias("series"))
    for k, v in (("day_px1", 40.0), ("day_v1", 1.0), ("day_px2", 348.0), ("day_v2", 29.0), ("val_px1", 300.0), ("val_v1", 36.0), ("val_px2", 100.0), ("val_v2", 37.0)):
        c = c.withColumn(k, F.lit(v))
    return c.withColumn("target", F.struct(F.lit(214).alias("r"), F.lit(68).alias("g"), F.lit(127).alias("b"))).withColumn("tolerance", F.lit(40.0))


def _points(spark, sf_dir) -> DataFrame:
    return digitize.scan_columns(pixels(spark, sf_dir), calibration(spark, sf_dir), F.lit(35), F.lit(430), F.lit(0), F.lit(400))


def column_scan(spark, sf_dir):
    return _points(spark, sf_dir).select("image_id", "series", "x", F.round("y", 6).alias("y"))


def resample_days(spark, sf_dir):
    return digitize.resample(_points(spark, sf_dir), calibration(spark, sf_dir)).select("image_id", "day", "value")


def suggest_colour(spark, sf_dir):
    return digitize.suggest_colour(pixels(spark, sf_dir), 39, 0, 430, 400)


_RASTER = f"""{cycles.READINGS},
px0 as (select cycle_id, 40 + (day - 1) * 11 as cx, (300 - (temp - 3600) * 2)::int as cy, k::int as k from r cross join range(0, 11) t(k) where temp is not null),
px as (select cycle_id as image_id, (case when k < 9 then cx + k % 3 - 1 else cx end)::int as x, (case when k < 9 then cy + k // 3 - 1 else cy + 20 * (k - 8) end)::int as y,
         case when k = 9 then 230 else 214 end as r, case when k = 9 then 230 else 68 end as g, case when k = 9 then 235 else 127 end as b, case when k = 10 then 10 else 255 end as a from px0),
pt as (select image_id, 'temp' as series, x, avg(y) as y from px where a >= 32 and x between 35 and 430 and y between 0 and 400
         and sqrt((r - 214) * (r - 214) + (g - 68) * (g - 68) + (b - 127) * (b - 127)) <= 40 group by 1, 2, 3)"""
_RESAMPLE = f"""with {_RASTER}, ids as (select distinct cycle_id as image_id from r), d as (select image_id, day::int as day from ids cross join range(1, 36) t(day)),
near as (select d.image_id, d.day, list_sort(list(y)) as ys from d join pt on pt.image_id = d.image_id and abs(x - (40 + (d.day - 1)::double / 28 * 308)) <= 5.5 group by 1, 2)
select d.image_id, d.day, floor((36 + (ys[len(ys) // 2 + 1] - 300) / (-200)::double * 1) * 100 + 0.5::double) / 100 as value from d left join near using (image_id, day)"""
_COLOUR = f"""with {_RASTER}, s as (select *, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) as sat from px where x between 39 and 429 and y between 0 and 399 and (x - 39) % 2 = 0 and y % 2 = 0
   and a >= 32 and not (greatest(r, g, b) > 235 and least(r, g, b) > 215) and greatest(r, g, b) >= 40),
gr as (select image_id, r // 32 as qr, g // 32 as qg, b // 32 as qb, count(*) as n, arg_min({{'r': r, 'g': g, 'b': b, 'sat': sat, 'y': y, 'x': x}}, y * 10000 + x) as c from s where sat >= 0.18 group by 1, 2, 3, 4),
best as (select image_id, arg_max(c, n * (0.5 + c.sat)) as c from gr group by 1)
select i.image_id, coalesce(c.r, 214)::int as r, coalesce(c.g, 68)::int as g, coalesce(c.b, 127)::int as b from (select distinct image_id from px) i left join best using (image_id)"""

# --- axis labels: nine ticks a column, one misread, one unread ---------------

_LABEL = {
    "column_id": "cycle_id",
    "image_id": "cast(floor(cycle_id / 4) as bigint)",
    "cy": "cast(100 + i * 40 as double)",
    "value": "case when i = (cycle_id + 4) % 9 then null when i = cycle_id % 9 then 3.0d when cycle_id % 4 = 0 then 37.4d - 0.2d * i when cycle_id % 4 = 1 then 99.5d - 0.5d * i when cycle_id % 4 = 2 then 95.0d - 10.0d * i else 1.9d - 0.2d * i end",
}
_LABEL_SQL = {k: v.replace("cast(floor(cycle_id / 4) as bigint)", "cycle_id // 4").replace("d *", "::double *").replace("0d ", "0::double ").replace("4d ", "4::double ").replace("5d ", "5::double ").replace("9d ", "9::double ") for k, v in _LABEL.items()}


def labels(spark, sf_dir) -> DataFrame:
    return _sql(_ids(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))), **_LABEL)


def _lines(spark, sf_dir) -> DataFrame:
    return axes.ransac(labels(spark, sf_dir))


def axis_ransac(spark, sf_dir):
    return _lines(spark, sf_dir).select("column_id", F.round("a", 4).alias("a"), F.round("b", 6).alias("b"), F.round("rmse", 4).alias("rmse"), "n_fit")


def _kinds(spark, sf_dir) -> DataFrame:
    l = labels(spark, sf_dir)
    return axes.classify(axes.ransac(l), l).join(l.select("column_id", "image_id").distinct(), "column_id")


def axis_classify(spark, sf_dir):
    return _kinds(spark, sf_dir).select("column_id", "kind")


def resolve_axes(spark, sf_dir):
    k = _kinds(spark, sf_dir).withColumn("rmse", F.round("rmse", 6))
    return axes.resolve(k).select("image_id", "bbt_column", "scale_idx", F.round("scale_confidence", 6).alias("scale_confidence"), "ratio_column", "level_column")


def snap_labels(spark, sf_dir):
    l = labels(spark, sf_dir)
    return axes.snap(l, axes.ransac(l)).select("column_id", "cy", F.round("value", 3).alias("value"))


def scale_from_labels(spark, sf_dir):
    return axes.scale_of(labels(spark, sf_dir))


def autocorr_pitch(spark, sf_dir):
    p = _ids(spark, sf_dir).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(239)))).selectExpr("cycle_id as image_id", "x", "cast(case when x % (17 + cycle_id % 15) < 3 then 10 else 0 end as double) as v")
    return axes.pitch(p).select("image_id", "lag", F.round("score", 3).alias("score"))


def tick_tokens(spark, sf_dir):
    text = F.get(F.array(*map(F.lit, ("> 98,5", ".5", "abc", "", "36.50 C", "-3"))), (F.col("cycle_id") % 6).cast("int"))
    t = parse_tick(text)
    return _ids(spark, sf_dir).select("cycle_id", t["value"].alias("value"), t["fragment"].alias("fragment"))


def form_fields(spark, sf_dir):
    r = cycles.readings(spark, sf_dir).where("temp is not null")
    whole = F.concat(F.lit("  "), F.floor(F.col("temp") / 100).cast("string"), F.when(F.col("day") % 2 == 0, ",").otherwise("."), F.lpad((F.col("temp") % 100).cast("int").cast("string"), 2, "0"), F.lit(" "))
    text = F.when(F.col("day") % 7 == 0, "").when(F.col("day") % 11 == 0, "n/a").when(F.col("day") % 13 == 0, "Infinity").otherwise(whole)
    return r.select("cycle_id", "day", parse_number(text).alias("temp"))


def ocr_lines(spark, sf_dir):
    steps = _ids(spark, sf_dir).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(11)))).selectExpr("cycle_id as line_id", "t", "cast((cycle_id * 7 + floor(t / 2) * 5) % 11 as int) as class", "cast((cycle_id + t) % 10 as double) / 10 as prob")
    steps = steps.withColumn("text", (F.col("class") - 1).cast("string"))
    out = axes.read_sequence(steps)
    return out.select("line_id", "text", F.round("confidence", 6).alias("confidence"))


_LABELS = f"""{cycles.READINGS}, ids as (select distinct cycle_id from r),
lb as (select {', '.join(f'{v} as {k}' for k, v in _LABEL_SQL.items())} from ids cross join range(0, 9) t(i)),
vl as (select *, count(*) over c as n, min(cy) over c as top, max(cy) over c as low, row_number() over (partition by column_id order by cy, value) as i from lb where value is not null window c as (partition by column_id)),
pr as (select p.column_id, p.i, q.i as j, (p.value - q.value) / (p.cy - q.cy) as b, p.value - (p.value - q.value) / (p.cy - q.cy) * p.cy as a, p.n, p.top, p.low from vl p join vl q on p.column_id = q.column_id and p.i < q.i where abs(p.cy - q.cy) >= 8 and p.n >= 3),
pt as (select *, greatest(0.15::double, 0.30::double * abs(a + b * top - (a + b * low)) / greatest(1, n - 1)) as tol from pr where b < 0),
vo as (select pt.column_id, pt.i, pt.j, any_value(a) as a, any_value(b) as b, any_value(tol) as tol, count(*) as votes from pt join vl on vl.column_id = pt.column_id and abs(value - (a + b * cy)) <= tol group by 1, 2, 3),
be as (select column_id, arg_max({{'a': a, 'b': b, 'tol': tol, 'votes': votes}}, votes * 10000 - i * 100 - j) as m from vo group by 1),
inl as (select vl.column_id, cy, value from vl left join be using (column_id) where vl.n >= 3 and case when coalesce(m.votes, 0) >= 3 then abs(value - (m.a + m.b * cy)) <= m.tol else true end),
f1 as (select inl.*, x.a, x.b, value - (x.a + x.b * cy) as resid from inl join (select column_id, regr_slope(value, cy) as b, regr_intercept(value, cy) as a from inl group by 1) x using (column_id)),
f2 as (select *, sqrt(avg(resid * resid) over c) as rms, count(*) over c as n from f1 window c as (partition by column_id)),
f3 as (select *, count_if(abs(resid) <= 1.5::double * rms) over (partition by column_id) as kept from f2),
f4 as (select * from f3 where not (rms > 1e-6 and n >= 3 and kept >= 2) or abs(resid) <= 1.5::double * rms),
f5 as (select column_id, regr_slope(value, cy) as b, regr_intercept(value, cy) as a from f4 group by 1),
ln as (select f4.column_id, any_value(f5.a) as a, any_value(f5.b) as b, sqrt(avg((value - (f5.a + f5.b * cy)) * (value - (f5.a + f5.b * cy)))) as rmse, count(*)::int as n_fit from f4 join f5 using (column_id) group by 1 having any_value(f5.b) < 0),
en as (select column_id, min(cy) as y0, max(cy) as y1, count(value) as valued from lb where value is not null group by 1),
er as (select ln.*, valued, k.kind, k.i, (abs(greatest(a + b * y0, a + b * y1) - k.hi) + abs(least(a + b * y0, a + b * y1) - k.lo)) / (k.hi - k.lo) as err from ln join en using (column_id)
   cross join (values {', '.join(f"({i}, '{k}', {t}::double, {l}::double)" for i, (k, t, l) in enumerate(axes.PROFILES))}) k(i, kind, hi, lo)),
kd as (select column_id, any_value(a) as a, any_value(b) as b, any_value(rmse) as rmse, any_value(n_fit) as n_fit, case when any_value(valued) >= 3 and min(err) < 0.4 then arg_min(kind, err) else 'unknown' end as kind, column_id // 4 as image_id from er group by column_id),
rk as (select image_id, {', '.join(f"arg_max({{'c': column_id, 'n': n_fit, 'e': round(rmse, 6)}}, n_fit * 1000 - round(rmse, 6)) filter (kind = '{k}') as {k}" for k, _, _ in axes.PROFILES)} from kd group by 1)"""
_STEPS = ", ".join(f"{{'d': abs({s}::double - raw), 's': {s}::double}}" for s in axes.STEPS)
_C_BETTER = "(bbt_c is not null and (bbt_f is null or bbt_c.n > bbt_f.n or (bbt_c.n = bbt_f.n and bbt_c.e < bbt_f.e)))"

# --- evaluation: predictions are the charts, shifted, thinned and bent --------


def truth(spark, sf_dir) -> DataFrame:
    return cycles.charts(spark, sf_dir)


_PRED = {
    "id": "id",
    "series": "series",
    "day": "cast(day + id % 5 - 2 as int)",
    "value": "value + cast((id + day) % 3 as double) / 100",
    "present": "case when (id + day) % 7 = 0 then 0 when (id + day) % 13 = 0 then 1 else present end",
}


def predicted(spark, sf_dir) -> DataFrame:
    return _sql(truth(spark, sf_dir), **_PRED)


def best_shift(spark, sf_dir):
    return evaluate.best_shift(truth(spark, sf_dir), predicted(spark, sf_dir))


def series_scores(spark, sf_dir):
    return evaluate.scores(truth(spark, sf_dir), predicted(spark, sf_dir)).withColumn("err", F.round("err", 6))


def eval_summary(spark, sf_dir):
    s = evaluate.summary(evaluate.scores(truth(spark, sf_dir), predicted(spark, sf_dir)))
    return s.select("series", F.round("f1", 6).alias("f1"), F.round("mae", 6).alias("mae"), "tp", "fp", "fn")


_RESULT = {
    "id": "cycle_id",
    "true_scale": "cast(cycle_id % 3 as int)",
    "scale_idx": "cast(case when cycle_id % 7 = 0 then 0 else cycle_id % 2 end as int)",
    "status": "case cycle_id % 4 when 0 then 'low_confidence' when 1 then 'not_a_chart' else 'extracted' end",
    "confidence": "cast(cycle_id % 100 as double) / 100",
}


def results(spark, sf_dir) -> DataFrame:
    return _sql(_ids(spark, sf_dir), **_RESULT)


def status_summary(spark, sf_dir):
    s = evaluate.status_summary(results(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) for c in ("scale_acc", "scale_acc_extracted", "mean_confidence")], "scale_total_extracted", "n_extracted", "n_low_confidence", "n_not_a_chart")


def eval_gates(spark, sf_dir):
    return evaluate.gates(evaluate.summary(evaluate.scores(truth(spark, sf_dir), predicted(spark, sf_dir))), evaluate.status_summary(results(spark, sf_dir)))


def parity_check(spark, sf_dir):
    t = truth(spark, sf_dir).select("id", "series", "day", "value")
    moved = t.where("(id + day) % 17 <> 0").withColumn("value", F.col("value") + F.when((F.col("id") + F.col("day")) % 5 == 0, 0.001).otherwise(0.00001))
    return evaluate.parity(t, moved, ["id", "series", "day"]).select("id", "series", "day")


_NAMES = ", ".join(f"'{x}'" for x in LABELS)


def _pairs(spark, sf_dir) -> DataFrame:
    name = lambda e: F.get(F.array(*map(F.lit, LABELS)), F.expr(e).cast("int"))
    return _ids(spark, sf_dir).select("cycle_id", name("cycle_id % 5").alias("truth"), name("case when cycle_id % 4 = 0 then (cycle_id + 1) % 4 else cycle_id % 5 end").alias("predicted"))


def classification_report(spark, sf_dir):
    r = evaluate.report(_pairs(spark, sf_dir), LABELS)
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_pairs(spark, sf_dir), LABELS)


def log_loss(spark, sf_dir):
    return evaluate.log_loss(_ids(spark, sf_dir).selectExpr("cast(cycle_id % 50 as double) / 50 as p_true")).select(F.round("log_loss", 6).alias("log_loss"))


_PAIRS_SQL = f"{cycles.READINGS}, pa as (select ([{_NAMES}])[cycle_id % 5 + 1] as truth, ([{_NAMES}])[(case when cycle_id % 4 = 0 then (cycle_id + 1) % 4 else cycle_id % 5 end) + 1] as predicted from (select distinct cycle_id from r))"
_EVAL = f"""{cycles.CHARTS}, pd as (select id, series, (day + id % 5 - 2)::int as day, value + ((id + day) % 3)::double / 100 as value, case when (id + day) % 7 = 0 then 0 when (id + day) % 13 = 0 then 1 else present end as present from ch),
sh as (select i.id, s.s::int as s, count(t.day) as n from (select distinct id from ch) i cross join range(-8, 9) s(s) left join (select t.id, p.day - t.day as s, t.day from ch t join pd p on p.id = t.id and p.series = t.series
     where t.present = 1 and p.present = 1 and p.day between 0 and 34) t on t.id = i.id and t.s = s.s group by 1, 2),
bs as (select id, arg_max(s, n * 100 - s)::int as shift from sh group by 1),
se as (select t.id, t.series, count_if(t.present = 1 and p.present = 1) as tp, count_if(t.present = 0 and p.present = 1) as fp, count_if(t.present = 1 and coalesce(p.present, 0) = 0) as fn,
      coalesce(sum(case when t.present = 1 and p.present = 1 then abs(t.value - p.value) end), 0) as err, count_if(t.present = 1 and p.present = 1) as co
    from ch t join bs on bs.id = t.id left join pd p on p.id = t.id and p.series = t.series and p.day between 0 and 34 and p.day - bs.shift = t.day group by 1, 2),
su as (select series, case when sum(tp) = 0 then 0 else 2.0::double * sum(tp) / (2.0::double * sum(tp) + sum(fp) + sum(fn)) end as f1, sum(err) / nullif(sum(co), 0) as mae, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from se group by 1)"""
_RES = f"rs as (select {', '.join(f'{v} as {k}' for k, v in _RESULT.items())} from (select distinct cycle_id from r))"
_STAT = """st as (select count_if(true_scale in (0, 1) and scale_idx = true_scale) / nullif(count_if(true_scale in (0, 1)), 0) as scale_acc,
  count_if(true_scale in (0, 1) and scale_idx = true_scale and status = 'extracted') / nullif(count_if(true_scale in (0, 1) and status = 'extracted'), 0) as scale_acc_extracted, coalesce(avg(confidence), 0) as mean_confidence,
  count_if(true_scale in (0, 1) and status = 'extracted') as scale_total_extracted, count_if(status = 'extracted') as n_extracted, count_if(status = 'low_confidence') as n_low_confidence, count_if(status = 'not_a_chart') as n_not_a_chart from rs)"""

# --- vision ------------------------------------------------------------------


def vision_confidence(spark, sf_dir):
    sparse = (F.col("id") % 3 == 0) & (F.col("day") % 9 != 0)
    raw = truth(spark, sf_dir).withColumn("logit", F.when((F.col("present") == 1) & ~sparse, 2.0).otherwise(-1.5) - F.when(F.col("id") % 4 == 0, 2.2).otherwise(0.0))
    return vision.confidence(vision.decode(raw)).select("id", "confidence", "status", F.array_join("reasons", "; ").alias("reasons"))


_QUALITY = {
    "id": "cycle_id",
    "n_fit": "cast(case when cycle_id % 5 = 0 then null else cycle_id % 11 end as int)",
    "rmse": "cast(cycle_id % 8 as double) / 10",
    "scale_confidence": "cast(cycle_id % 13 as double) / 10",
    "bbt_points": "cast(cycle_id % 14 as int)",
    "lh_points": "cast(cycle_id % 6 as int)",
    "grid_source": "case cycle_id % 7 when 0 then 'date-row' when 1 then 'gridlines' when 2 then 'autocorr' when 3 then 'marker-spacing' when 4 then 'uniform' when 5 then 'other' end",
    "plot_method": "case cycle_id % 5 when 0 then 'axiscol' when 1 then 'ink+grid' when 2 then 'ink' when 3 then 'ticks' end",
    "visible_days": "cast(30 + cycle_id % 12 as int)",
    "truncated": "30 + cycle_id % 12 > 35",
}


def quality_score(spark, sf_dir):
    q = vision.quality(_sql(_ids(spark, sf_dir), **_QUALITY))
    return q.select("id", F.round("confidence", 3).alias("confidence"), "status", F.round("components.axis", 3).alias("axis"), F.round("components.markers", 3).alias("markers"), F.size("reasons").alias("n_reasons"))


def backend_choice(spark, sf_dir):
    i = F.col("cycle_id")
    got = vision.backend(i % 5 != 0, i % 3 != 0, F.lit(0.5), (i * 37 % 100).cast("double") / 100)
    return _ids(spark, sf_dir).select("cycle_id", got.alias("backend"))


def backend_fallback(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    cloud, device = ids.where("cycle_id % 3 = 0").selectExpr("cycle_id as id", "cycle_id * 2 as answer"), ids.where("cycle_id % 2 = 0").selectExpr("cycle_id as id", "cycle_id * 3 as answer")
    return vision.with_fallback(cloud, device)


def model_answers(spark, sf_dir):
    body = F.concat(F.lit('{"scale": "'), F.when(F.col("cycle_id") % 2 == 0, "fahrenheit").otherwise("kelvin"), F.lit('", "temp": [36.5, null, '), (F.col("cycle_id") % 40).cast("string"), F.lit("]"), F.when(F.col("cycle_id") % 3 == 0, F.concat(F.lit(', "confidence": 0.'), (F.col("cycle_id") % 9).cast("string"))).otherwise(""), F.lit("}"))
    text = F.when(F.col("cycle_id") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("cycle_id") % 4 == 1, F.concat(F.lit("```\n"), body)).otherwise(body)
    a = _ids(spark, sf_dir).select("cycle_id", vision.parse_answer(text).alias("a"))
    best = F.size(F.filter("a.temp", lambda x: x.isNotNull()))
    return a.select("cycle_id", "a.scale", "a.confidence", F.get("a.temp", F.lit(2)).alias("third"), F.size("a.lh").alias("n_lh"), vision.answer_status(best, F.col("a.confidence")).alias("status"))


_QSQL = {k: v for k, v in _QUALITY.items()}
_QUAL = f"""{cycles.READINGS}, q as (select {', '.join(f'{v} as {k}' for k, v in _QSQL.items())} from (select distinct cycle_id from r)),
q1 as (select *, coalesce(n_fit >= 2, false) as fit, case when n_fit >= 2 then least(1, n_fit / 8) * exp(-least(rmse, 3)) else 0 end as axis, least(1, scale_confidence) as scale, greatest(bbt_points, lh_points) as best,
   case grid_source when 'date-row' then 1 when 'gridlines' then 0.95 when 'autocorr' then 0.8 when 'marker-spacing' then 0.6 when 'uniform' then 0.3 else 0.4 end::double as grid,
   case plot_method when 'axiscol' then 1 when 'ticks' then 1 when 'ink+grid' then 0.8 when 'ink' then 0.6 else 0.3 end::double as plot from q),
q2 as (select *, least(1, best / 10) * case when axis > 0 then 1 else 0.25::double end as markers from q1),
q3 as (select *, least(1, 0.25::double * axis + 0.15::double * scale + 0.3::double * markers + 0.2::double * grid + 0.1::double * plot) as blend from q2)"""

# --- stores ------------------------------------------------------------------


def runs(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    # epoch_ms of the SQL rounds microseconds to the nearest millisecond, halves away from 0, so the last half of one is of the next hour.
    # It takes the instant where ts has a zone and the wall clock where it has none, whatever the session's zone.
    zoned = dict(e.dtypes)["ts"] == "timestamp"
    us = "unix_micros(ts)" if zoned else "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
    hours = f"floor((({us} + if({us} < 0, -500, 500)) div 1000) / 3600000)"
    return e.select(F.col("event_id").alias("id"), F.expr(hours).alias("created_at"), F.col("user_id").alias("owner"), F.col("event_type").alias("title"), F.col("props").alias("analysis"))


def run_history_top30(spark, sf_dir):
    return stores.listing(stores.keep_latest(runs(spark, sf_dir)))


def run_history_by_owner(spark, sf_dir):
    return stores.keep_latest(runs(spark, sf_dir), owner="owner").select("owner", "id", "created_at")


def run_history_delete(spark, sf_dir):
    r = runs(spark, sf_dir)
    return stores.without(r, r.where("id % 3 = 0")).groupBy("owner").agg(F.count(F.lit(1)).alias("runs"))


def _files(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat_ws(":", "event_type", "user_id")
    return e.select(
        F.concat_ws(":", F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")), F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("key"),
        F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("version"), F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string")).alias("file_name"),
        F.sha2(text, 256).alias("sha256"), F.encode(F.when(F.col("event_id") % 100 == 0, F.lit("other")).otherwise(text), "utf-8").alias("data"), F.length(text).cast("long").alias("bytes"), "event_id",
    )


def model_cache_state(spark, sf_dir):
    f = _files(spark, sf_dir)
    have = f.where("event_id % 60 <> 0").withColumn("sha256", F.when(F.col("event_id") % 80 == 0, "old").otherwise(F.col("sha256")))
    return stores.cache_state(f, have)


def model_cache_write(spark, sf_dir):
    f = stores.verified(_files(spark, sf_dir))
    current = f.groupBy("file_name").agg(F.max("version").alias("version"))
    return stores.purge(f, current).select("key")


def model_cache_bytes(spark, sf_dir):
    return stores.cached_bytes(_files(spark, sf_dir))


def image_lookup(spark, sf_dir):
    i = _ids(spark, sf_dir)
    images = i.selectExpr("explode(array(concat('/a/s', cycle_id, '.jpg'), concat('/a/s', cycle_id, case when cycle_id % 2 = 0 then '.png' else '.gif' end))) as path")
    return stores.pick_images(i.where("cycle_id % 5 <> 0").selectExpr("cycle_id", "concat('/l/s', cycle_id, '.labels.json') as label_path").unionAll(i.where("cycle_id % 5 = 0").selectExpr("cycle_id", "concat('/l/none', cycle_id, '.json')")), images).select("cycle_id", "image")


def label_seeding(spark, sf_dir):
    i = _ids(spark, sf_dir).selectExpr("concat('s', cycle_id) as source", "cycle_id % 4 = 0 as reviewed")
    return stores.seed_labels(i.select("source"), i)


_RUNS = "ru as (select event_id as id, floor(epoch_ms(ts) / 3600000)::bigint as created_at, user_id as owner, event_type as title, props as analysis from events)"
_FILES = """fi as (select 'v' || event_id % 3 || ':f' || event_id as key, 'v' || event_id % 3 as version, 'f' || event_id % 40 as file_name, sha256(event_type || ':' || user_id) as sha256,
   case when event_id % 100 = 0 then 'other' else event_type || ':' || user_id end as data, length(event_type || ':' || user_id)::bigint as bytes, event_id from events)"""

QUERIES = {
    k.__name__: k
    for k in (
        column_scan, resample_days, suggest_colour, axis_ransac, axis_classify, resolve_axes, snap_labels, scale_from_labels, autocorr_pitch, tick_tokens, form_fields, ocr_lines,
        best_shift, series_scores, eval_summary, status_summary, eval_gates, parity_check, classification_report, confusion_matrix, log_loss,
        vision_confidence, quality_score, backend_choice, backend_fallback, model_answers,
        run_history_top30, run_history_by_owner, run_history_delete, model_cache_state, model_cache_write, model_cache_bytes, image_lookup, label_seeding,
    )
}

_IDS = f"with {cycles.READINGS}, ids as (select distinct cycle_id from r)"
_BODY = """'{"scale": "' || (case when cycle_id % 2 = 0 then 'fahrenheit' else 'kelvin' end)"""
ORACLE_SQL = {
    "column_scan": f"with {_RASTER} select image_id, series, x, round(y, 6) as y from pt",
    "resample_days": _RESAMPLE,
    "suggest_colour": _COLOUR,
    "axis_ransac": f"with {_LABELS} select column_id, round(a, 4) as a, round(b, 6) as b, round(rmse, 4) as rmse, n_fit from ln",
    "axis_classify": f"with {_LABELS} select column_id, kind from kd",
    "resolve_axes": f"""with {_LABELS} select image_id, case when {_C_BETTER} then bbt_c.c else bbt_f.c end as bbt_column, (case when {_C_BETTER} then 0 when bbt_f is not null then 1 end)::int as scale_idx,
        round(coalesce(case when {_C_BETTER} then least(1, 0.5::double + 0.1::double * bbt_c.n) * case when bbt_c.e < 0.3 then 1 else 0.7::double end when bbt_f is not null then least(1, 0.5::double + 0.1::double * bbt_f.n) * case when bbt_f.e < 0.3 then 1 else 0.7::double end end, 0), 6) as scale_confidence,
        ratio.c as ratio_column, level.c as level_column from rk""",
    "snap_labels": f"""with {_LABELS}, gp as (select column_id, cy - lag(cy) over (partition by column_id order by cy) as gap from lb), dy as (select column_id, median(gap) as dy from gp group by 1),
        s0 as (select lb.column_id, cy, ln.a, ln.b, abs(ln.b) * dy as raw from lb join ln using (column_id) join dy using (column_id)), s1 as (select *, list_min([{_STEPS}]).s as step from s0)
        select column_id, cy, round(round_even(round((a + b * cy) / step, 6), 0) * step, 3) as value from s1""",
    "scale_from_labels": f"""with {_LABELS}, m as (select column_id, median(value) as m, count(value) as n from lb where value is not null group by 1)
        select column_id, case when n >= 2 and least(abs(m - 36.5::double), abs(m - 97.25::double)) <= 5 then case when abs(m - 36.5::double) <= abs(m - 97.25::double) then 0 else 1 end end as scale_idx from m""",
    "autocorr_pitch": f"""{_IDS}, p0 as (select cycle_id as image_id, x::int as x, (case when x % (17 + cycle_id % 15) < 3 then 10 else 0 end)::double as v from ids cross join range(0, 240) t(x)), p as (select image_id, x, v - avg(v) over (partition by image_id) as v from p0),
        s as (select a.image_id, l.l::int as lag, sum(a.v * b.v) as score from p a cross join range(15, 41) l(l) join p b on b.image_id = a.image_id and b.x = a.x + l.l group by 1, 2)
        select image_id, arg_max(lag, round(score, 6) * 1000 - lag * 1e-9)::int as lag, round(max(score), 3) as score from s group by 1""",
    "tick_tokens": f"{_IDS} select cycle_id, ([98.5, 0.5, null, null, 36.5, -3.0]::double[])[cycle_id % 6 + 1] as value, cycle_id % 6 = 1 as fragment from ids",
    "form_fields": f"with {cycles.READINGS} select cycle_id, day, case when day % 7 = 0 or day % 11 = 0 or day % 13 = 0 then null else (floor(temp / 100)::int || '.' || lpad((temp % 100)::int::varchar, 2, '0'))::double end as temp from r where temp is not null",
    "ocr_lines": f"""{_IDS}, s as (select cycle_id as line_id, t::int as t, ((cycle_id * 7 + (t // 2) * 5) % 11)::int as c, ((cycle_id + t) % 10)::double / 10 as prob from ids cross join range(0, 12) t(t)),
        k as (select *, c <> 0 and coalesce(lag(c) over (partition by line_id order by t) <> c, true) as kept from s)
        select line_id, coalesce(string_agg((c - 1)::varchar, '' order by t) filter (kept), '') as text, round(coalesce(avg(prob) filter (kept), 0), 6) as confidence from k group by 1""",
    "best_shift": f"with {_EVAL} select * from bs",
    "series_scores": f"with {_EVAL} select id, series, tp, fp, fn, round(err, 6) as err, co from se",
    "eval_summary": f"with {_EVAL} select series, round(f1, 6) as f1, round(mae, 6) as mae, tp, fp, fn from su",
    "status_summary": f"with {cycles.READINGS}, {_RES}, {_STAT} select round(scale_acc, 6) as scale_acc, round(scale_acc_extracted, 6) as scale_acc_extracted, round(mean_confidence, 6) as mean_confidence, scale_total_extracted, n_extracted, n_low_confidence, n_not_a_chart from st",
    "eval_gates": f"""with {_EVAL}, {_RES}, {_STAT} select 'f1' as gate, f1 >= 0.55 as passed from su where series = 'temp' union all select 'mae', coalesce(mae <= 0.16, false) from su where series = 'temp'
        union all select 'scale', scale_total_extracted < 8 or coalesce(scale_acc_extracted >= 0.8, false) from st""",
    "parity_check": f"with {cycles.CHARTS} select id, series, day from ch where (id + day) % 17 = 0 or ((id + day) % 5 = 0 and not (0.001::double <= 1e-4 + 1e-4 * abs(value)))",
    "classification_report": f"""with {_PAIRS_SQL}, l as (select unnest([{_NAMES}]) as label), c as (select label, count_if(truth = label and predicted = label) as tp, count_if(predicted = label) as p, count_if(truth = label) as support from l cross join pa group by 1)
        select label, round(coalesce(tp / nullif(p, 0), 0), 6) as precision, round(coalesce(tp / nullif(support, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(p + support, 0), 0), 6) as f1, support from c""",
    "confusion_matrix": f"with {_PAIRS_SQL} select truth, {', '.join(f'''count_if(predicted = '{x}') as {x}''' for x in LABELS)} from pa group by 1",
    "log_loss": f"{_IDS} select round(-avg(ln(greatest(1e-15, least(1, (cycle_id % 50)::double / 50)))), 6) as log_loss from ids",
    "vision_confidence": f"""with {cycles.CHARTS}, x as (select *, case when present = 1 and not (id % 3 = 0 and day % 9 <> 0) then 2::double else -1.5::double end - case when id % 4 = 0 then 2.2::double else 0 end as logit from ch),
        y as (select *, 1 / (1 + exp(-logit)) as p from x), g as (select id, count_if(series = 'temp' and p >= 0.5) as t, count_if(series = 'lh' and p >= 0.5) as l, coalesce(avg(p) filter (series = 'temp' and p >= 0.5), 0) as tp, coalesce(avg(p) filter (series = 'lh' and p >= 0.5), 0) as lp from y group by 1),
        h as (select *, greatest(t, l) as best, 0.5::double * least(1, greatest(t, l) / 10) + 0.4::double * greatest(tp, lp) + 0.1::double * (t >= 2)::int as blend from g)
        select id, floor((case when best < 2 then least(blend, 0.15::double) else blend end) * 100 + 0.5::double) / 100 as confidence, case when best < 2 then 'not_a_chart' when blend < 0.45::double then 'low_confidence' else 'extracted' end as status,
          concat_ws('; ', case when best = 0 then 'aucun point de donnée détecté' when best < 5 then 'peu de points détectés (' || best || ')' end, case when t < 2 then 'pas de courbe de température nette' end, case when best < 2 then 'aucune courbe exploitable — ce n''est probablement pas un graphique de cycle' end) as reasons from h""",
    "quality_score": f"""with {_QUAL} select id, round(round_even(case when axis = 0 and best < 2 then least(blend, 0.15::double) when axis = 0 then least(blend, 0.44::double) else blend end, 3), 3) as confidence,
        case when axis = 0 and best < 2 then 'not_a_chart' when axis = 0 or blend < 0.45::double then 'low_confidence' else 'extracted' end as status, round(round_even(axis, 3), 3) as axis, round(round_even(markers, 3), 3) as markers,
        ((not fit)::int + (fit and n_fit < 5)::int + (fit and rmse > 0.5)::int + (scale < 0.5)::int + (best < 5)::int + (grid_source is null or grid_source = 'uniform')::int + (axis = 0)::int + truncated::int)::int as n_reasons from q3""",
    "backend_choice": f"{_IDS} select cycle_id, case when cycle_id % 5 <> 0 and cycle_id % 3 <> 0 and (cycle_id * 37 % 100)::double / 100 < 0.5 then 'cloud' else 'device' end as backend from ids",
    "backend_fallback": f"{_IDS} select cycle_id as id, case when cycle_id % 3 = 0 then cycle_id * 2 else cycle_id * 3 end as answer, case when cycle_id % 3 = 0 then 'cloud' else 'device' end as backend from ids where cycle_id % 3 = 0 or cycle_id % 2 = 0",
    "model_answers": f"""{_IDS}, a as (select cycle_id, case when cycle_id % 2 = 0 then 'fahrenheit' else 'celsius' end as scale, case when cycle_id % 3 = 0 then ('0.' || cycle_id % 9)::double else 0.7::double end as confidence, (cycle_id % 40)::double as third from ids)
        select *, 0 as n_lh, case when confidence < 0.45 then 'low_confidence' else 'extracted' end as status from a""",
    "run_history_top30": f"with {_RUNS} select id, created_at, owner, title from ru order by created_at desc, id desc limit 30",
    "run_history_by_owner": f"with {_RUNS} select owner, id, created_at from ru qualify row_number() over (partition by owner order by created_at desc, id desc) <= 30",
    "run_history_delete": f"with {_RUNS} select owner, count(*) as runs from ru where id % 3 <> 0 group by 1",
    "model_cache_state": f"with {_FILES} select key, case when event_id % 60 = 0 then 'miss' when event_id % 80 = 0 then 'stale' else 'hit' end as state from fi",
    "model_cache_write": f"with {_FILES}, v as (select * from fi where sha256(data) = sha256), c as (select file_name, max(version) as version from v group by 1) select key from v join c using (file_name, version)",
    "model_cache_bytes": f"with {_FILES} select coalesce(sum(bytes), 0)::bigint as bytes from fi",
    "image_lookup": f"{_IDS} select cycle_id, case when cycle_id % 5 <> 0 then '/a/s' || cycle_id || case when cycle_id % 2 = 0 then '.png' else '.jpg' end end as image from ids",
    "label_seeding": f"{_IDS} select 's' || cycle_id as source from ids where cycle_id % 4 <> 0",
}
