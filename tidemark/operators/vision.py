"""Predictions of charts: decoding, quality, routing between backends, parsing of a language model's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import clip, half_up, sigmoid
from tidemark.operators.series import PRESENCE

#: Weights of the quality blend, scores of day grids and plots, and the confidence below which a result is flagged.
WEIGHTS = {"axis": 0.25, "scale": 0.15, "markers": 0.30, "grid": 0.20, "plot": 0.10}
GRID_SCORES = {"date-row": 1.0, "gridlines": 0.95, "autocorr": 0.80, "marker-spacing": 0.60, "uniform": 0.30}
GRID_OTHER = 0.4
LOW = 0.45
#: Width and height of the network's input, means and deviations of red, green and blue.
INPUT = (384, 224)
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def _resampled(p: DataFrame, axis: str, size: str, to: int) -> DataFrame:
    """p (image_id, x, y, r, g, b and sizes) with `axis` brought from `size` to `to` pixels by triangles a pixel wide, source or
    target, whichever is larger, rounded to whole values."""
    scale = F.col(size) / F.lit(float(to))
    reach, middle = F.greatest(F.lit(1.0), scale), F.col(axis) + 0.5
    low, high = F.ceil((middle - reach) / scale - 0.5), F.floor((middle + reach) / scale - 0.5)
    at = F.explode(F.sequence(F.greatest(F.lit(0), low).cast("int"), F.least(F.lit(to - 1), high).cast("int")))
    spread = p.where(F.greatest(F.lit(0), low) <= F.least(F.lit(to - 1), high)).withColumn("_at", at)
    weight = 1 - F.abs(middle - (F.col("_at") + 0.5) * scale) / reach
    spread = spread.withColumn("_w", weight).where("_w > 0")
    other = "y" if axis == "x" else "x"
    mean = lambda c: F.floor(F.round(F.sum(F.col("_w") * F.col(c)) / F.sum("_w"), 6) + 0.5).cast("int").alias(c)
    return spread.groupBy("image_id", F.col("_at").alias(axis), other, "width", "height").agg(*[mean(c) for c in "rgb"])


def network_input(pixels: DataFrame, images: DataFrame, width: int = INPUT[0], height: int = INPUT[1]) -> DataFrame:
    """(image_id, channel, y, x, value): images (image_id, width, height) with pixels (image_id, x, y, r, g, b and, where there is one,
    an alpha a) at the network's size, on white, each colour with its mean taken off, in deviations."""
    on_white = lambda c: F.floor((F.col(c) * F.col("a") + 255 * (255 - F.col("a"))) / 255.0 + 0.5).cast("int") if "a" in pixels.columns else F.col(c)
    p = pixels.select("image_id", "x", "y", *[on_white(c).alias(c) for c in "rgb"]).join(images.select("image_id", "width", "height"), "image_id")
    p = _resampled(_resampled(p, "x", "width", width), "y", "height", height)
    value = lambda k, c: F.struct(F.lit(k).alias("channel"), ((F.col(c) / 255.0 - MEAN[k]) / DEVIATION[k]).alias("value"))
    planes = p.withColumn("_p", F.explode(F.array(*[value(k, c) for k, c in enumerate("rgb")])))
    return planes.select("image_id", "_p.channel", "y", "x", "_p.value")


def decode(outputs: DataFrame, threshold: float = PRESENCE) -> DataFrame:
    """Network outputs (…, value, logit) to probability, presence and a value between 0 and 1."""
    p = sigmoid(F.col("logit"))
    out = outputs.withColumn("probability", p).withColumn("present", (p >= threshold).cast("int"))
    return out.withColumn("value", F.when(F.col("present") == 1, clip(F.col("value"), 0.0, 1.0)))


def soft_argmax(heat: DataFrame, keys: tuple[str, ...] = ("id", "series", "day")) -> DataFrame:
    """Expected height of a column of logits (…, y, logit): the softmax's mean."""
    from pyspark.sql import Window

    e = F.exp(F.col("logit") - F.max("logit").over(Window.partitionBy(*keys)))
    return heat.withColumn("_e", e).groupBy(*keys).agg((F.sum(F.col("_e") * F.col("y")) / F.sum("_e")).alias("value"))


def scale_of(logits: Column) -> Column:
    """Index of the largest scale logit, the first of equals."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def confidence(series: DataFrame, key: str = "id") -> DataFrame:
    """(id, confidence, status, reasons) of a prediction (id, series, day, probability, present)."""
    of = lambda s, c: F.when((F.col("series") == s) & (F.col("present") == 1), c)
    g = series.groupBy(key).agg(
        F.count(of("temp", F.lit(1))).alias("t"), F.count(of("lh", F.lit(1))).alias("l"),
        F.coalesce(F.avg(of("temp", F.col("probability"))), F.lit(0.0)).alias("tp"), F.coalesce(F.avg(of("lh", F.col("probability"))), F.lit(0.0)).alias("lp"),
    )
    best, anchored = F.greatest("t", "l"), F.col("t") >= 2
    blend = F.lit(0.5) * F.least(F.lit(1.0), best / 10) + F.lit(0.4) * F.greatest("tp", "lp") + F.lit(0.1) * anchored.cast("int")
    value = F.when(best < 2, F.least(clip(blend, 0.0, 1.0), F.lit(0.15))).otherwise(clip(blend, 0.0, 1.0))
    status = F.when(best < 2, "not_a_chart").when(blend < LOW, "low_confidence").otherwise("extracted")
    reasons = F.array_compact(
        F.array(
            F.when(best == 0, F.lit("aucun point de donnée détecté")).when(best < 5, F.concat(F.lit("peu de points détectés ("), best.cast("string"), F.lit(")"))),
            F.when(~anchored, F.lit("pas de courbe de température nette")),
            F.when(best < 2, F.lit("aucune courbe exploitable — ce n'est probablement pas un graphique de cycle")),
        )
    )
    return g.select(key, half_up(value, 2).alias("confidence"), status.alias("status"), reasons.alias("reasons"))


def quality(charts: DataFrame) -> DataFrame:
    """Blend of an extraction's parts (n_fit, rmse, scale_confidence, bbt_points, lh_points, grid_source, plot_method, visible_days,
    truncated) to confidence, status, components and reasons. A readable temperature axis is a gate: without one
    markers count a quarter and the result is flagged."""
    n, rmse = F.col("n_fit"), F.coalesce("rmse", F.lit(0.0))
    fit = F.coalesce(n >= 2, F.lit(False))
    axis = F.when(fit, F.least(F.lit(1.0), n / 8.0) * F.exp(-F.least(rmse, F.lit(3.0)))).otherwise(0.0)
    scale = clip(F.coalesce("scale_confidence", F.lit(0.0)), 0.0, 1.0)
    best = F.greatest("bbt_points", "lh_points")
    raw = clip(best / 10.0, 0.0, 1.0)
    has_axis = axis > 0
    markers = raw * F.when(has_axis, 1.0).otherwise(0.25)
    grid = F.lit(GRID_OTHER)
    for source, score in GRID_SCORES.items():
        grid = F.when(F.col("grid_source") == source, score).otherwise(grid)
    method = F.coalesce("plot_method", F.lit(""))
    plot = F.when(F.contains(method, F.lit("axiscol")) | F.contains(method, F.lit("ticks")), 1.0).when(F.contains(method, F.lit("ink+grid")), 0.8).when(F.contains(method, F.lit("ink")), 0.6).otherwise(0.3)
    blend = clip(sum((F.lit(WEIGHTS[k]) * v for k, v in (("axis", axis), ("scale", scale), ("markers", markers), ("grid", grid), ("plot", plot))), F.lit(0.0)), 0.0, 1.0)
    nothing = ~has_axis & (best < 2)
    value = F.when(nothing, F.least(blend, F.lit(0.15))).when(~has_axis, F.least(blend, F.lit(LOW - 0.01))).otherwise(blend)
    status = F.when(nothing, "not_a_chart").when(~has_axis | (blend < LOW), "low_confidence").otherwise("extracted")
    reasons = F.array_compact(
        F.array(
            F.when(~fit, "no BBT temperature axis detected"),
            F.when(fit & (n < 5), F.format_string("BBT axis fit on only %d ticks", n)),
            F.when(fit & (rmse > 0.5), F.format_string("BBT axis fit residual high (rmse=%.2f)", rmse)),
            F.when(scale < 0.5, "°C/°F scale uncertain"),
            F.when(best == 0, F.lit("no data points recovered")).when(best < 5, F.format_string("few data points recovered (%d)", best)),
            F.when(F.col("grid_source").isNull() | (F.col("grid_source") == "uniform"), "day grid fell back to uniform spacing"),
            F.when(nothing, "no axis and no data points — likely not a cycle chart").when(~has_axis, "no readable temperature axis — values not calibrated"),
            F.when(F.col("truncated"), F.format_string("chart shows ~%d days; only the first 35 were kept", F.col("visible_days"))),
        )
    )
    parts = F.struct(*[F.bround(v, 3).alias(k) for k, v in (("axis", axis), ("scale", scale), ("markers", markers), ("markers_raw", raw), ("grid", grid), ("plot", plot))])
    return charts.withColumn("components", parts).withColumn("confidence", F.bround(value, 3)).withColumn("status", status).withColumn("reasons", reasons)


def backend(cloud: Column, consent: Column, share: Column, draw: Column) -> Column:
    """The cloud serves a share of those who consent while it is switched on."""
    return F.when(cloud & consent & (draw < share), "cloud").otherwise("device")


def with_fallback(cloud: DataFrame, device: DataFrame, key: str = "id") -> DataFrame:
    """The cloud's result, else the device's."""
    names = [c for c in cloud.columns if c != key]
    joined = cloud.select(key, F.struct(*names).alias("_c")).join(device.select(key, F.struct(*names).alias("_d")), key, "full_outer")
    best = F.coalesce("_c", "_d")
    return joined.select(key, *[best[c].alias(c) for c in names], F.when(F.col("_c").isNotNull(), "cloud").otherwise("device").alias("backend"))


def parse_answer(text: Column) -> Column:
    """A language model's JSON answer, with or without code fences: scale (Celsius unless it says Fahrenheit), confidence
    (0.7 where missing) and the two series."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    j = F.from_json(bare, "scale string, confidence double, temp array<double>, lh array<double>")
    return F.struct(
        F.when(j["scale"] == "fahrenheit", "fahrenheit").otherwise("celsius").alias("scale"),
        F.coalesce(j["confidence"], F.lit(0.7)).alias("confidence"),
        F.coalesce(j["temp"], F.array().cast("array<double>")).alias("temp"),
        F.coalesce(j["lh"], F.array().cast("array<double>")).alias("lh"),
    )


def answer_status(best: Column, sure: Column) -> Column:
    """Status of a cloud result by its points and confidence."""
    return F.when(best < 2, "not_a_chart").when(sure < LOW, "low_confidence").otherwise("extracted")


def consent_config(consent: Column, enabled: Column, share: Column) -> Column:
    """Routing settings of a user: without consent the cloud gets nothing."""
    return F.struct((enabled & consent).alias("cloud_enabled"), F.when(consent, share).otherwise(F.lit(0.0)).alias("cloud_share"), consent.alias("consent_given"))


def usable(points: DataFrame, key: str = "id", least: int = 3) -> DataFrame:
    """(id, series, enabled): a series can be imported from three present days on."""
    return points.groupBy(key, "series").agg((F.count_if(F.col("present") > PRESENCE) >= least).alias("enabled"))


def measured(points: DataFrame) -> DataFrame:
    """Values of present days only: interpolated ones are left out."""
    return points.withColumn("value", F.when(F.col("present") > PRESENCE, F.col("value")))


def losses(rows: DataFrame, beta: float = 0.05) -> DataFrame:
    """One row: masked smooth L1 of values, cross-entropy of presence, of rows (value, present, true_value, true_present)."""
    d = F.abs(F.col("value") - F.col("true_value"))
    smooth = F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)
    p = clip(F.col("probability"), 1e-7, 1 - 1e-7)
    bce = -F.when(F.col("true_present") > PRESENCE, F.log(p)).otherwise(F.log(1 - p))
    return rows.agg(F.coalesce(F.avg(F.when(F.col("true_present") > PRESENCE, smooth)), F.lit(0.0)).alias("value_loss"), F.avg(bce).alias("presence_loss"))


def scale_loss(logits: Column, truth: Column) -> Column:
    """Cross-entropy of scale logits, null where the true scale is unknown (-1)."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(truth >= 0, F.log(total) + top - F.get(logits, truth))


def evaluate_predictions(rows: DataFrame) -> DataFrame:
    """One row: error on truly present days, precision, recall and F1 of presence."""
    t, p = F.col("true_present") > PRESENCE, F.col("present") > PRESENCE
    g = rows.agg(F.avg(F.when(t, F.abs(F.col("value") - F.col("true_value")))).alias("mae"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return g.select("mae", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"))


def request_state(ready: Column, body: Column, answer: Column, answer_code: Column) -> Column:
    """(code, error, image, lang) of a request to digitise a chart, from whether the service is configured, the request's body and the
    upstream's answer: 503 where it isn't, 400 for a bad body or image, 502 for an answer that failed or isn't JSON, else 200."""
    image, lang = F.get_json_object(body, "$.image"), F.get_json_object(body, "$.lang")
    bad_body = F.get_json_object(body, "$").isNull()
    bad_image = ~F.coalesce(image.startswith("data:image/"), F.lit(False))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    unread = F.get_json_object(bare, "$").isNull()
    checks = (
        (~ready, 503, "cloud_unavailable"), (bad_body, 400, "bad_request"), (bad_image, 400, "missing_image"), (answer_code.isNull(), 502, "upstream_unreachable"),
        (~answer_code.between(200, 299), 502, "upstream_error"), (unread, 502, "unparseable_model_output"),
    )
    code, error = F.lit(200), F.lit(None).cast("string")
    for test, number, name in checks[::-1]:
        code, error = F.when(test, number).otherwise(code), F.when(test, name).otherwise(error)
    return F.struct(code.alias("code"), error.alias("error"), image.alias("image"), lang.alias("lang"))


def answer_days(answers: DataFrame, key: str = "id", days: int = 35) -> DataFrame:
    """(id, series, day, value, present) of parsed answers (id, scale, temp, lh): places between 0 and 1 of the scale's range, 0 and absent
    where the answer has no number."""
    from tidemark.operators.series import LH_RANGE, SCALES, normalise

    f = F.col("scale") == "fahrenheit"
    low, high = F.when(f, SCALES[1][1]).otherwise(SCALES[0][1]), F.when(f, SCALES[1][2]).otherwise(SCALES[0][2])
    both = F.explode(F.array(F.struct(F.lit("temp").alias("series"), F.col("temp").alias("v"), low.alias("lo"), high.alias("hi")), F.struct(F.lit("lh").alias("series"), F.col("lh").alias("v"), F.lit(LH_RANGE[0]).alias("lo"), F.lit(LH_RANGE[1]).alias("hi"))))
    d = answers.select(key, both.alias("s")).select(key, "s.*").withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    v = F.get("v", F.col("day"))
    there = v.isNotNull() & ~F.isnan(v)
    return d.select(key, "series", "day", F.when(there, normalise(v, F.col("lo"), F.col("hi"))).otherwise(0.0).alias("value"), there.cast("int").alias("present"))
