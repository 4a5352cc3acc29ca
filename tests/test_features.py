import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators.features import FEATURES, features, to_celsius
from tidemark.sources.readings import DAYS, demo, from_arrays, from_form

NA = None


def plain(temps, lh):
    """The features of one cycle by their definitions, day by day."""
    t = [x if x is not None and math.isfinite(x) else None for x in (list(temps) + [None] * DAYS)[:DAYS]]
    h = [x if x is not None and math.isfinite(x) else None for x in (list(lh) + [None] * DAYS)[:DAYS]]
    mean = lambda v: sum(v) / len(v) if v else 0.0
    std = lambda v: math.sqrt(mean([(x - mean(v)) ** 2 for x in v])) if len(v) > 1 else 0.0
    some = lambda v: [x for x in v if x is not None]
    ov = None
    for d in range(6, DAYS - 2):
        prior, rise = some(t[d - 6 : d]), t[d : d + 3]
        if len(prior) >= 4 and None not in rise and min(rise) > max(prior) and rise[2] - max(prior) >= 0.2:
            ov = d - 1
            break

    def run(mask):
        best = now = 0
        for m in mask:
            now = now + 1 if m else 0
            best = max(best, now)
        return best

    def slope(lo, hi):
        p = [(i, t[i]) for i in range(max(0, lo), min(DAYS, hi)) if t[i] is not None]
        if len(p) < 2:
            return 0.0
        mx, my = mean([a for a, _ in p]), mean([b for _, b in p])
        return sum((a - mx) * (b - my) for a, b in p) / sum((a - mx) ** 2 for a, _ in p)

    all_, low, after = some(t), some(t[: ov + 1] if ov is not None else t), some(t[ov + 1 :]) if ov is not None else []
    lhs = some(h)
    median = sorted(lhs)[len(lhs) // 2] if len(lhs) % 2 else (sum(sorted(lhs)[len(lhs) // 2 - 1 : len(lhs) // 2 + 1]) / 2 if lhs else 0)
    edge = lambda i: h[i] if 0 <= i < DAYS and h[i] is not None else -math.inf
    peaks = [i for i in range(DAYS) if h[i] is not None and h[i] > max(1.3, 1.5 * median) and h[i] >= edge(i - 1) and h[i] >= edge(i + 1)]
    best = max(peaks, key=lambda i: h[i]) if peaks else None
    base, m = mean(low), mean(all_)
    out = [len(all_), len(lhs), 1 - len(all_) / DAYS, 1 - len(lhs) / DAYS, m, std(all_), min(all_, default=0), max(all_, default=0), max(all_, default=0) - min(all_, default=0)]
    out += [ov + 1 if ov is not None else 0, base, std(low), mean(after), std(after)]
    if ov is None:
        out += [0, 0, 0, 0, 0]
    else:
        jumps = [t[d + 1] - t[d] for d in range(max(0, ov - 1), min(DAYS - 1, ov + 3)) if t[d] is not None and t[d + 1] is not None]
        out += [max(0, mean(after) - base), max([0, *jumps]), sum(x > base + 0.15 for x in after), run([x is not None and x > base + 0.15 for x in t[ov + 1 :]]), sum(x < max(low, default=0) for x in after)]
    out += [best + 1 if best is not None else 0, h[best] if best is not None else max(lhs, default=0), len(peaks), ov - best if ov is not None and best is not None else 0]
    out += [ov + 1 if ov is not None else 0, len(after), *((slope(ov - 4, ov + 1), slope(ov + 1, ov + 5)) if ov is not None else (slope(0, 10), slope(10, 20)))]
    out += [sum(x < m for x in all_) / max(1, len(all_)), run([x is not None and x >= m for x in t]), run([x is not None and x < m for x in t])]
    return out


LOW, HIGH = 36.25, 36.75  # exact in binary, so boundaries are what they seem
CASES = {
    "all missing": ([NA] * 35, [NA] * 35),
    "constant": ([36.5] * 35, [1.0] * 35),
    "rise": ([LOW] * 14 + [HIGH] * 14, [NA] * 12 + [1.0, 2.5, 1.5]),
    "rise at day 7": ([LOW] * 6 + [HIGH] * 20, []),
    "rise at day 33": ([LOW] * 32 + [HIGH] * 3, []),
    "three days only before": ([LOW, NA, LOW, NA, NA, LOW] + [HIGH] * 5, []),
    "third day too low": ([LOW] * 8 + [HIGH, HIGH, LOW + 0.125, HIGH, HIGH], []),
    "gap in the high run": ([LOW] * 10 + [HIGH] * 4 + [NA] + [HIGH] * 6 + [LOW] + [HIGH] * 2, []),
    "plateau of LH": ([], [0.5] * 10 + [2.0, 2.0, 0.5, 2.0] + [NA, 1.75]),
    "LH without a peak": ([], [1.0, 1.25, 1.0]),
    "not numbers": ([float("nan"), float("inf"), 36.5, 36.75], [float("-inf"), 1.5]),
    "longer than 35": ([LOW] * 20 + [HIGH] * 30, [1.0] * 50),
}


@pytest.mark.parametrize("unit", [1.0, 100.0])
def test_features_by_definition(spark, unit):
    rows = [(i, [x and x * unit for x in t], [x and x * unit for x in h]) for i, (t, h) in enumerate(CASES.values())]
    df = from_arrays(spark.createDataFrame(rows, "cycle_id long, temps array<double>, lh array<double>"))
    got = {r.cycle_id: r for r in features(df, unit).collect()}
    scaled = {4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 20, 25, 26}
    for i, (name, (t, h)) in enumerate(CASES.items()):
        for k, (f, want) in enumerate(zip(FEATURES, plain(t, h))):
            assert math.isclose(got[i][f], want * (unit if k in scaled else 1), rel_tol=1e-6, abs_tol=1e-6 * unit), (name, f)


def test_demo_cycle(spark):
    r = features(demo(spark)).first()
    assert (r.estimated_ovulation_day, r.lh_peak_day, r.luteal_length, r.n_temp_observed) == (14, 14, 14, 28)


def test_form_fields_and_units(spark):
    rows = [(1, 1, " 36,5 ", "x"), (1, 2, "", None), (1, 3, "1e400", "0.8")]
    got = {r.day: (r.temp, r.lh) for r in from_form(spark.createDataFrame(rows, "cycle_id long, day int, temp_text string, lh_text string")).collect()}
    assert got == {1: (36.5, None), 2: (None, None), 3: (None, 0.8)}
    c = spark.createDataFrame([(97.7, "Fahrenheit"), (36.5, "celsius")], "t double, s string").select(to_celsius(F.col("t"), F.col("s")).alias("c"))
    assert [round(r.c, 6) for r in c.collect()] == [36.5, 36.5]


def test_one_shuffle_for_all_features(spark):
    df = from_arrays(spark.createDataFrame([(1, [36.5], [1.0])], "cycle_id long, temps array<double>, lh array<double>"))
    plan = features(df)._jdf.queryExecution().sparkPlan().toString()
    full = features(df)._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
