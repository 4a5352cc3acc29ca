"""Queries over cycles derived from `events`: readings, features, analysis and its content, charts. Readings are whole
hundredths, so every comparison is exact in Spark and in the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.copy import CHIPS, GLOSSARY, LABELS, QUESTIONS, SECTIONS, VERDICTS
from tidemark.operators import analysis, locale, series
from tidemark.operators.features import FEATURES, features, with_ovulation, with_phases
from tidemark.sources.readings import from_events, spine

UNIT = 100.0


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value"))


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(readings(spark, sf_dir), UNIT)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ovulation(spine(readings(spark, sf_dir)), UNIT)


def _features(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vector(spark, sf_dir).select("cycle_id", *[F.round(n, 6).alias(n) for n in names])

    return query


def readings_daily(spark, sf_dir):
    return readings(spark, sf_dir)


def ovulation(spark, sf_dir):
    return vector(spark, sf_dir).select("cycle_id", F.col("estimated_ovulation_day").cast("int").alias("ovulation_day"))


_SCORES = ["(cycle_id * (7 + 2 * {i}) + 13 * {i}) % 97 + 1 + case when cycle_id % 5 = {i} then (cycle_id % 4) * 90 else 0 end".format(i=i) for i in range(5)]


def scored(spark, sf_dir) -> DataFrame:
    """The features of each cycle with class probabilities and an anomaly score that follow from its id."""
    v = vector(spark, sf_dir)
    v = v.withColumn("_s", F.array(*[F.expr(x).cast("double") for x in _SCORES])).withColumn("_sum", F.aggregate("_s", F.lit(0.0), lambda a, x: a + x))
    v = v.withColumn("p", F.transform("_s", lambda x: x / F.col("_sum"))).withColumn("locale", F.get(F.array(*map(F.lit, ("fr", "en", "de"))), (F.col("cycle_id") % 3).cast("int")))
    v = v.withColumn("score", ((F.col("cycle_id") * 37) % 1000).cast("double") / F.lit(5000.0) - F.lit(0.05))
    hundred = lambda c: F.col(c) / 100 if c == "thermal_rise_amplitude" else F.col(c)
    return v.withColumn("g", analysis.gate(F.col("p"))).withColumn("d", analysis.derived(hundred)).select("*", "g.label", "g.confidence", "g.confident")


def confidence_gate(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("cycle_id", "label", F.round("confidence", 9).alias("confidence"), "confident", analysis.argmax(F.col("p")).alias("best"), F.round(F.col("g.probabilities")[LABELS[2]], 9).alias("p_anovulation"))


def ood_percentile(spark, sf_dir):
    return scored(spark, sf_dir).select("cycle_id", analysis.unusual(F.col("score")).alias("percentile"))


def derived_metrics(spark, sf_dir):
    return scored(spark, sf_dir).select("cycle_id", "d.ovulation_day", "d.follicular_length", "d.luteal_length", "d.lh_peak_day", "d.lh_peak_count", F.round("d.rise", 6).alias("rise"))


def analysable(spark, sf_dir):
    return analysis.enough(vector(spark, sf_dir)).select("cycle_id")


def verdict_content(spark, sf_dir):
    v = analysis.verdict(scored(spark, sf_dir))
    pct = F.floor(F.col("confidence") * 100 + 0.5).cast("int")
    asked = analysis.questions(F.col("locale"), F.col("label"), F.col("doctor_question"), F.col("d.luteal_length"))
    note = analysis.unusual_note(F.col("locale"), analysis.unusual(F.col("score")))
    return v.select("cycle_id", "title", "tone", "summary", pct.alias("confidence_pct"), F.array_join(asked, " ").alias("questions"), note.alias("note"))


def stat_chips(spark, sf_dir):
    text = lambda c: F.concat_ws("|", c["label"], c["value"], c["hint"])
    return scored(spark, sf_dir).select("cycle_id", F.array_join(F.transform(analysis.chips(F.col("locale"), F.col("d")), text), ";").alias("chips"))


def narrative_sections(spark, sf_dir):
    s = scored(spark, sf_dir).select("cycle_id", F.explode(analysis.sections(F.col("locale"), F.col("d"))).alias("s"))
    return s.select("cycle_id", "s.heading", "s.body")


def glossary_terms(spark, sf_dir):
    v = analysis.verdict(scored(spark, sf_dir))
    bodies = F.transform(analysis.sections(F.col("locale"), F.col("d")), lambda s: s["body"])
    return v.select("cycle_id", F.array_join(analysis.glossary(F.col("locale"), F.col("summary"), bodies), ",").alias("terms"))


_SIGNALS = {
    "override": "case cycle_id % 7 when 0 then 'en-GB' when 1 then 'de' when 2 then '' end",
    "cookie": "case cycle_id % 5 when 0 then 'en' when 1 then 'FR' end",
    "accept": "case cycle_id % 4 when 0 then ' en-US,fr;q=0.8' when 1 then 'fr-CA' when 2 then ',en' end",
    "country": "case cycle_id % 3 when 0 then 'be' when 1 then 'US' end",
}


def locale_resolution(spark, sf_dir):
    c = readings(spark, sf_dir).select("cycle_id").distinct().select("cycle_id", *[F.expr(x).alias(k) for k, x in _SIGNALS.items()])
    got = locale.resolve(*[F.col(k) for k in _SIGNALS])
    return c.select("cycle_id", locale.detect(F.col("override"), F.col("accept"), F.col("country")).alias("detected"), got.alias("locale"), locale.language_name(got).alias("language"))


_MESSAGES = [("fr", "days", "{n} jours, {what}"), ("en", "days", "{n} days, {what}"), ("fr", "only", "seulement {n}"), ("en", "rise", "rise of {n} {n}")]


def message_text(spark, sf_dir):
    c = readings(spark, sf_dir).select("cycle_id").distinct()
    key = F.get(F.array(*map(F.lit, ("days", "only", "rise", "none"))), (F.col("cycle_id") % 4).cast("int"))
    c = c.select("cycle_id", key.alias("key"), F.when(F.col("cycle_id") % 3 == 0, "en").otherwise("fr").alias("locale"))
    got = locale.translate(c, spark.createDataFrame(_MESSAGES, "locale string, key string, text string"))
    return got.select("cycle_id", locale.interpolate(F.col("text"), F.create_map(F.lit("n"), F.col("cycle_id").cast("string"))).alias("text"))


def charts(spark, sf_dir) -> DataFrame:
    """Two series a cycle on days 0 to 34 with values between 0 and 1, as a digitised chart has them."""
    d = spine(readings(spark, sf_dir))
    unit = lambda c, lo, hi: (F.col(c) - lo) / (hi - lo)
    both = F.explode(F.array(F.struct(F.lit("temp").alias("series"), unit("temp", 3560, 3740).alias("v")), F.struct(F.lit("lh").alias("series"), unit("lh", 0, 300).alias("v"))))
    return d.select(F.col("cycle_id").alias("id"), (F.col("day") - 1).alias("day"), both.alias("s")).select("id", "day", "s.series", F.coalesce("s.v", F.lit(0.0)).alias("value"), F.col("s.v").isNotNull().cast("int").alias("present"))


def interpolate_gaps(spark, sf_dir):
    return series.interpolate(charts(spark, sf_dir)).select("id", "series", "day", F.round("value", 6).alias("value"), "present", "interpolated")


def left_pack(spark, sf_dir):
    return series.left_pack(charts(spark, sf_dir).where("present = 1")).select("id", "series", "day", F.round("value", 6).alias("value"))


def collapse_present(spark, sf_dir):
    c = charts(spark, sf_dir)
    temp = F.col("series") == "temp"
    real = series.denormalise(c, F.when(temp, 35.6).otherwise(0.0), F.when(temp, 37.4).otherwise(3.0))
    return series.collapse(real).select("id", "series", "day", F.round("value", 2).alias("value"))


def chart_segments(spark, sf_dir):
    return series.chart_segments(days(spark, sf_dir))


def chart_range(spark, sf_dir):
    return series.chart_range(spine(readings(spark, sf_dir)), UNIT)


def ovulation_band(spark, sf_dir):
    d = vector(spark, sf_dir).select("cycle_id", F.nullif(F.col("estimated_ovulation_day").cast("int"), F.lit(0)).alias("ov"))
    return d.withColumn("b", series.ovulation_band(F.col("ov"))).select("cycle_id", F.col("b.low").alias("band_low"), F.col("b.high").alias("band_high"))


def lh_bars(spark, sf_dir):
    b = series.lh_bars(spine(readings(spark, sf_dir)), UNIT)
    return b.select("cycle_id", "day", "lh", F.round("height", 6).alias("height"), "strong")


def day_phases(spark, sf_dir):
    p = with_phases(spine(readings(spark, sf_dir)), UNIT)
    return p.select("cycle_id", "day", "luteal", F.coalesce("high", F.lit(False)).alias("high"), "peak", F.col("high_run").cast("int").alias("high_run"))


# --- oracles -----------------------------------------------------------------

READINGS = """
ev as (select *, cast(round(value * 100) as bigint) as v from events),
daily as (select user_id as cycle_id, (date_diff('day', date '2024-01-01', date_trunc('day', ts)::date) + 1)::int as day,
            max(case when event_type in ('view', 'click', 'signup') then event_id * 1000 + v % 100 end) as tk,
            max(case when event_type in ('purchase', 'error') then event_id * 1000 + v % 300 end) as lk
          from ev group by 1, 2),
r as (select cycle_id, day, (3620 + (tk % 1000) % 18 + case when cycle_id % 5 <> 4 and day > 11 + cycle_id % 7 then 22 + (cycle_id % 4) * 6 else 0 end)::double as temp,
             ((lk % 1000) % 300)::double as lh from daily where day between 1 and 35)"""

SPINE = f"""{READINGS},
meds as (select cycle_id, median(lh) as med from r group by 1),
spine as (select m.cycle_id, d.day::int as day, r.temp, r.lh, m.med from meds m cross join range(1, 36) d(day) left join r on r.cycle_id = m.cycle_id and r.day = d.day),
o1 as (select *, case when count(temp) over b >= 4 and temp > max(temp) over b and lead(temp, 1) over w > max(temp) over b and lead(temp, 2) over w > max(temp) over b
            and lead(temp, 2) over w - max(temp) over b >= 20 and day >= 7 then day - 1 end as f
       from spine window w as (partition by cycle_id order by day), b as (partition by cycle_id order by day rows between 6 preceding and 1 preceding)),
o as (select *, min(f) over (partition by cycle_id) as ov from o1)"""

PHASES = f"""{SPINE},
p1 as (select *, coalesce(day > ov, false) as luteal,
         coalesce(avg(case when day <= coalesce(ov, 35) then temp end) over c, 0)::float::double as base,
         coalesce(avg(temp) over c, 0)::float::double as mean,
         coalesce(max(case when day <= ov then temp end) over c, 0) as low_max,
         coalesce(lh > greatest(130, med * 1.5) and lh >= coalesce(lag(lh) over w, -1) and lh >= coalesce(lead(lh) over w, -1), false) as peak,
         lead(temp) over w - temp as jump
       from o window c as (partition by cycle_id), w as (partition by cycle_id order by day)),
p2 as (select *, coalesce(luteal and temp > base + 15, false) as high, coalesce(temp >= mean, false) as above, coalesce(temp < mean, false) as below from p1),
p as (select *, case when high then day - coalesce(max(case when not high then day end) over s, 0) else 0 end as high_run,
         case when above then day - coalesce(max(case when not above then day end) over s, 0) else 0 end as above_run,
         case when below then day - coalesce(max(case when not below then day end) over s, 0) else 0 end as below_run
      from p2 window s as (partition by cycle_id order by day rows between unbounded preceding and current row))"""

_SLOPE = "coalesce((select case when isnan(x) then 0 else x end from (select regr_slope(case when {c} then temp end, day::double) as x)), 0)"
VECTOR = f"""{PHASES},
a as (select cycle_id, count(temp) as n, count(lh) as m, avg(temp) as mean, stddev_pop(temp) as std, min(temp) as lo, max(temp) as hi, max(ov) as ov,
        avg(case when day <= coalesce(ov, 35) then temp end) as lm, stddev_pop(case when day <= coalesce(ov, 35) then temp end) as ls,
        avg(case when luteal then temp end) as am, stddev_pop(case when luteal then temp end) as as_, count(case when luteal then temp end) as an,
        max(case when day between greatest(1, ov - 1) and least(34, ov + 2) then jump end) as jump,
        count_if(high) as plateau, max(high_run) as high_run, count_if(coalesce(luteal and temp < low_max, false)) as dips,
        arg_max(day, lh * 1000 - day) filter (peak) as pd, max(lh) filter (peak) as pv, count_if(peak) as peaks, max(lh) as lh_max,
        regr_slope(case when (ov is null and day <= 10) or day between ov - 4 and ov then temp end, day::double) as pre,
        regr_slope(case when (ov is null and day between 11 and 20) or day between ov + 1 and ov + 4 then temp end, day::double) as post,
        count_if(below) as below, max(above_run) as above_run, max(below_run) as below_run
      from p group by cycle_id),
vec as (select cycle_id, n::double as n_temp_observed, m::double as n_lh_observed, 1 - n / 35 as missing_rate_temp, 1 - m / 35 as missing_rate_lh,
   coalesce(mean, 0) as temp_mean_overall, coalesce(std, 0) as temp_std_overall, coalesce(lo, 0) as temp_min, coalesce(hi, 0) as temp_max, coalesce(hi - lo, 0) as temp_range,
   coalesce(ov, 0)::double as estimated_ovulation_day, coalesce(lm, 0) as follicular_mean, coalesce(ls, 0) as follicular_std,
   case when ov is null then 0 else coalesce(am, 0) end as luteal_mean, case when ov is null then 0 else coalesce(as_, 0) end as luteal_std,
   case when ov is null then 0 else greatest(0, coalesce(am, 0) - coalesce(lm, 0)) end as thermal_rise_amplitude,
   case when ov is null then 0 else greatest(0, coalesce(jump, 0)) end as rise_steepness_max,
   case when ov is null then 0 else plateau end::double as plateau_days_above_baseline, case when ov is null then 0 else high_run end::double as n_consecutive_high_days,
   case when ov is null then 0 else dips end::double as post_rise_dip_count, coalesce(pd, 0)::double as lh_peak_day, coalesce(pv, lh_max, 0)::double as lh_peak_value,
   peaks::double as lh_peak_count, coalesce(ov - pd, 0)::double as days_lh_peak_to_thermal_rise, coalesce(ov, 0)::double as follicular_length,
   case when ov is null then 0 else an end::double as luteal_length,
   coalesce(case when not isnan(pre) then pre end, 0) as spline_slope_pre_ovulation, coalesce(case when not isnan(post) then post end, 0) as spline_slope_post_ovulation,
   (below / greatest(1, n))::double as fraction_days_below_mean, above_run::double as longest_run_above_mean, below_run::double as longest_run_below_mean
  from a)"""

_P = ", ".join(f"(({x})::double)" for x in _SCORES)
_P5, _P50, _P95 = analysis.PERCENTILES
SCORED = f"""{VECTOR},
sc as (select *, [{_P}] as s, (['fr', 'en', 'de'])[cycle_id % 3 + 1] as locale, ((cycle_id * 37) % 1000)::double / 5000::double - 0.05::double as score,
        case when estimated_ovulation_day > 0 then estimated_ovulation_day::int end as ovd, case when follicular_length > 0 then follicular_length::int end as fol,
        case when luteal_length > 0 then luteal_length::int end as lut, thermal_rise_amplitude / 100 as rise, case when lh_peak_day > 0 then lh_peak_day::int end as lpd, lh_peak_count::int as lpc from vec),
sp as (select *, list_transform(s, lambda x: x / list_sum(s)) as p from sc),
g0 as (select *, list_max(p) as confidence, list_position(p, list_max(p)) - 1 as best from sp),
g as (select *, confidence >= 0.6::double as confident, case when confidence < 0.6::double then '{LABELS[4]}' else ([{", ".join(repr(x) for x in LABELS)}])[best + 1] end as label,
   (case when score <= {_P5}::double then 100 when score >= {_P95}::double then 0
      when score <= {_P50}::double then floor(100::double - (score - {_P5}::double) / {_P50 - _P5!r}::double * 50 + 0.5::double)
      else floor(50::double - (score - {_P50}::double) / {_P95 - _P50!r}::double * 50 + 0.5::double) end)::int as percentile from g0)"""


def _q(s: str | None) -> str:
    return "null" if s is None else "'" + s.replace("'", "''") + "'"


def _both(texts: dict[str, str]) -> str:
    return f"(case when locale = 'en' then {_q(texts['en'])} else {_q(texts['fr'])} end)"


_COPY = ", ".join(f"({_q(lang)}, {_q(n)}, {_q(v['title'])}, {_q(v['tone'])}, {_q(v['summary'])}, {_q(v.get('question'))})" for lang, by in VERDICTS.items() for n, v in by.items())
CONTENT = f"""{SCORED},
copy(l, n, title, tone, summary, question) as (values {_COPY}),
ct as (select g.*, title, tone, summary, question from g left join copy on n = label and l = case when locale = 'en' then 'en' else 'fr' end)"""
_AMPL = "(case when locale = 'en' then format('{:.2f} °C', rise) else replace(format('{:.2f} °C', rise), '.', ',') end)"


def _fill(key: str, **values: str) -> str:
    out = _both(SECTIONS[key])
    for k, v in values.items():
        out = f"replace({out}, '{{{k}}}', ({v})::varchar)"
    return out


_FAINT = f"case when rise > 0 then {_both(SECTIONS['faint_present'])} else {_both(SECTIONS['faint_absent'])} end"
_GOOD = f"case when lut >= 10 then {_both(SECTIONS['luteal_good'])} else {_both(SECTIONS['luteal_short'])} end"
_CLEAR = f"case when rise > 0.2::double then {_fill('ovulation_clear', ampl=_AMPL)} else {_fill('ovulation_faint', how=_FAINT)} end"
NARRATIVE = f"""{CONTENT},
na as (select *, 1 as k, {_fill('follicular_heading', ov='ovd')} as heading, {_fill('follicular_body', len='coalesce(fol, ovd)')} as body from ct where ovd > 0
   union all select *, 2, {_fill('ovulation_heading', ov='ovd')}, {_CLEAR} from ct where ovd > 0
   union all select *, 3, {_fill('luteal_heading', day='ovd + 1')}, {_fill('luteal_body', how=_GOOD, len='lut')} from ct where ovd > 0 and lut > 0
   union all select *, 1, {_both(SECTIONS['none_heading'])}, {_both(SECTIONS['none_body'])} from ct where ovd is null)"""
_TERMS = " , ".join(f"case when {'' if lang == 'en' else 'not '}(locale = 'en') and contains(hay, {_q(t)}) then {_q(t)} end" for lang in ("fr", "en") for t in GLOSSARY[lang])


def _chip(on: str, key: str, value: str, hint: str | None) -> str:
    return f"case when {on} then concat_ws('|', {_both(CHIPS[key])}, {value}, {hint or 'null'}) end"


_DAY, _UNIT = _both(CHIPS["day"]), _both(CHIPS["day_unit"])
_CHIPS = ", ".join(
    [
        _chip("ovd > 0", "ovulation", f"{_DAY} || ovd", _both(CHIPS["ovulation_hint"])),
        _chip("fol > 0", "follicular", f"fol || ' ' || {_UNIT}", None),
        _chip("lut > 0", "luteal", f"lut || ' ' || {_UNIT}", _both(CHIPS["luteal_hint"])),
        _chip("rise > 0", "rise", _AMPL, None),
        _chip("lpd > 0", "lh_peak", f"{_DAY} || lpd", f"case when lpc > 1 then replace({_both(CHIPS['lh_peak_many'])}, '{{n}}', lpc::varchar) end"),
    ]
)

CHARTS = f"""{SPINE},
ch as (select cycle_id as id, day - 1 as day, 'temp' as series, coalesce((temp - 3560) / (3740 - 3560), 0)::double as value, (temp is not null)::int as present from spine
       union all select cycle_id, day - 1, 'lh', coalesce((lh - 0) / (300 - 0), 0)::double, (lh is not null)::int from spine)"""

_TO = "case when coalesce({x}, '') = '' or split_part(lower({x}), '-', 1) not in ('fr', 'en') then 'fr' else split_part(lower({x}), '-', 1) end"
_FIRST = "trim(split_part(accept, ',', 1))"
_REST = f"case when coalesce(accept, '') <> '' and {_FIRST} <> '' then {_TO.format(x=_FIRST)} else 'fr' end"
_LOCALE = f"case when coalesce(override, '') <> '' then {_TO.format(x='override')} when coalesce(cookie, '') <> '' then {_TO.format(x='cookie')} else {_REST} end"


def _pick(*names: str) -> str:
    return f"with {VECTOR} select cycle_id, {', '.join(f'round({n}, 6) as {n}' for n in names)} from vec"


FAMILIES = {
    "cycle_counts_missing": FEATURES[0:4],
    "temp_summary": FEATURES[4:9],
    "phase_stats": FEATURES[10:15],
    "rise_steepness_plateau": [FEATURES[15], FEATURES[16], FEATURES[18], FEATURES[24]],
    "luteal_high_run": [FEATURES[17]],
    "mean_runs": FEATURES[28:30],
    "lh_peaks": FEATURES[19:23],
    "slopes": FEATURES[25:27],
    "fraction_below_mean": [FEATURES[27]],
    "feature_vector": FEATURES,
}

QUERIES = {
    "readings_daily": readings_daily,
    "ovulation_3over6": ovulation,
    **{k: _features(*v) for k, v in FAMILIES.items()},
    "day_phases": day_phases,
    "confidence_gate": confidence_gate,
    "ood_percentile": ood_percentile,
    "derived_metrics": derived_metrics,
    "analysable_cycles": analysable,
    "verdict_content": verdict_content,
    "stat_chips": stat_chips,
    "narrative_sections": narrative_sections,
    "glossary_terms": glossary_terms,
    "locale_resolution": locale_resolution,
    "message_text": message_text,
    "interpolate_gaps": interpolate_gaps,
    "left_pack": left_pack,
    "collapse_present": collapse_present,
    "chart_segments": chart_segments,
    "chart_range": chart_range,
    "ovulation_band": ovulation_band,
    "lh_bars": lh_bars,
}

ORACLE_SQL = {
    "readings_daily": f"with {READINGS} select * from r",
    "ovulation_3over6": f"with {SPINE} select cycle_id, coalesce(max(ov), 0)::int as ovulation_day from o group by 1",
    **{k: _pick(*v) for k, v in FAMILIES.items()},
    "day_phases": f"with {PHASES} select cycle_id, day, luteal, high, peak, high_run::int as high_run from p",
    "confidence_gate": f"with {SCORED} select cycle_id, label, round(confidence, 9) as confidence, confident, best::int as best, round(p[3], 9) as p_anovulation from g",
    "ood_percentile": f"with {SCORED} select cycle_id, percentile from g",
    "derived_metrics": f"with {SCORED} select cycle_id, ovd as ovulation_day, fol as follicular_length, lut as luteal_length, lpd as lh_peak_day, lpc as lh_peak_count, round(rise, 6) as rise from g",
    "analysable_cycles": f"with {READINGS} select cycle_id from r group by 1 having count(temp) + count(lh) >= 5",
    "verdict_content": f"""with {CONTENT} select cycle_id, title, tone, summary, floor(confidence * 100 + 0.5::double)::int as confidence_pct,
        concat_ws(' ', question, case when label = '{LABELS[0]}' and lut > 0 and lut < 11 then {_both(QUESTIONS['short_luteal'])} end) as questions,
        case when percentile >= 80 then {_both(QUESTIONS['unusual'])} end as note from ct""",
    "stat_chips": f"with {SCORED} select cycle_id, concat_ws(';', {_CHIPS}) as chips from g",
    "narrative_sections": f"with {NARRATIVE} select cycle_id, heading, body from na",
    "glossary_terms": f"""with {NARRATIVE}, hays as (select cycle_id, any_value(locale) as locale, lower(any_value(summary) || ' ' || string_agg(body, ' ' order by k)) as hay from na group by 1)
        select cycle_id, concat_ws(',', {_TERMS}) as terms from hays""",
    "locale_resolution": f"""with {READINGS}, c as (select distinct cycle_id from r), x as (select cycle_id, {', '.join(f'{v} as {k}' for k, v in _SIGNALS.items())} from c)
        select cycle_id, case when coalesce(override, '') <> '' then {_TO.format(x='override')} else {_REST} end as detected, {_LOCALE} as locale, case when {_LOCALE} = 'fr' then 'French' else 'English' end as language from x""",
    "message_text": f"""with {READINGS}, m(locale, key, text) as (values {', '.join(f"({_q(a)}, {_q(b)}, {_q(c)})" for a, b, c in _MESSAGES)}),
        c as (select distinct cycle_id, (['days', 'only', 'rise', 'none'])[cycle_id % 4 + 1] as key, case when cycle_id % 3 = 0 then 'en' else 'fr' end as locale from r)
        select cycle_id, replace(coalesce(a.text, b.text, c.key), '{{n}}', cycle_id::varchar) as text from c left join m a on a.key = c.key and a.locale = c.locale left join m b on b.key = c.key and b.locale = 'fr'""",
    "interpolate_gaps": f"""with {CHARTS}, z as (select *, max(case when present = 1 then day end) over b as bd, min(case when present = 1 then day end) over a as ad from ch
          window b as (partition by id, series order by day rows between unbounded preceding and 1 preceding), a as (partition by id, series order by day rows between 1 following and unbounded following)),
        y as (select z.*, (z.present = 0 and coalesce(ad - bd - 1 between 1 and 3, false)) as fill, vb.value as bv, va.value as av from z
          left join ch vb on vb.id = z.id and vb.series = z.series and vb.day = z.bd left join ch va on va.id = z.id and va.series = z.series and va.day = z.ad)
        select id, series, day, round(case when fill then bv * (1 - (day - bd)::double / (ad - bd)) + av * ((day - bd)::double / (ad - bd)) else value end, 6) as value, present, fill::int as interpolated from y""",
    "left_pack": f"with {CHARTS} select id, series, day - min(day) over (partition by id) as day, round(value, 6) as value from ch where present = 1",
    "collapse_present": f"""with {CHARTS} select id, series, row_number() over (partition by id, series order by day)::int as day,
        round(case when series = 'temp' then floor((35.6::double + value * (37.4::double - 35.6::double)) * 100 + 0.5::double) / 100 else floor((0::double + value * 3::double) * 10 + 0.5::double) / 10 end, 2) as value from ch where present = 1""",
    "chart_segments": f"""with {SPINE}, x as (select *, lag(temp) over (partition by cycle_id order by day) as from_temp from o)
        select cycle_id, day - 1 as from_day, day, from_temp, temp, case when day > ov then 'luteal' else 'follicular' end as phase from x where temp is not null and from_temp is not null""",
    "chart_range": f"""with {SPINE}, x as (select cycle_id, coalesce(floor((min(temp) - 10) / 10) * 10, 3600) as lo, coalesce(ceil((max(temp) + 10) / 10) * 10, 3720) as hi from spine group by 1)
        select cycle_id, lo::double as y_low, (case when hi - lo < 50 then lo + 50 else hi end)::double as y_high from x""",
    "ovulation_band": f"with {SPINE}, x as (select cycle_id, max(ov) as ov from o group by 1) select cycle_id, case when ov >= 1 then greatest(1, ov - 1) end as band_low, case when ov >= 1 then least(35, ov + 1) end as band_high from x",
    "lh_bars": f"""with {SPINE}, x as (select *, greatest(100, max(lh) over (partition by cycle_id)) as top from spine)
        select cycle_id, day, lh, round(lh / top * 0.32::double, 6) as height, lh >= greatest(130, top * 0.8::double) as strong from x where lh is not null""",
}
