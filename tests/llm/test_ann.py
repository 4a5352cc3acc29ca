import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def brute(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i, tuple(x + 0.0 for x in v)] = 1
    out = []
    for (q, a) in ok:
        if q % 50 == 0:
            best = {}
            for (i, b) in ok:
                if i != q:
                    best[i] = max(best.get(i, -2), float(ann.cosines(np.array(a), np.array([b]))[0]))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def rows(n=900):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((n, 8)).astype(np.float32).astype(float)
    out = [(i, [float(x) for x in v[i]]) for i in range(n)]
    for i in range(100, 400, 2):  # one hot vector
        out[i] = (i, out[100][1])
    out += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [1.0] * 7 + [None]), (2200, [1.0, float("inf")] + [0.0] * 6), (2250, [1.0] * 3), (None, out[1][1]), (50, out[50][1]), (2300, [-0.0, 1.0] + [0.0] * 6), (2350, [0.0, 1.0] + [0.0] * 6)]
    return out


def run(spark, data, **kw):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in data], "vec_id long, embedding array<double>, list int, score string")
    return sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, **kw).collect())


def test_one_list_is_exact(spark):
    data = rows()
    got, want = run(spark, data, block=300, queries=7), brute(data)
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12)


def test_many_lists_reach_the_recall(spark):
    data = rows(3000)
    got, want = run(spark, data, list_size=64), brute(data)
    pairs = {(a, c) for a, _, c, _ in got}
    assert len(got) == len(want)
    assert np.mean([(a, c) in pairs for a, _, c, _ in want]) >= 0.9


@pytest.mark.parametrize("data", [[], [(0, [1.0] * 8)], [(0, [1.0] * 8), (1, [1.0] * 8), (7, [2.0] * 8)], [(0, None)]])
def test_few_vectors(spark, data):
    assert run(spark, data) == brute(data)


def test_scan_drops_early_but_keeps_the_nearest():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-9)
    q = v[:40]
    kept = ann.scan(q @ turn, v @ turn, 6)
    true = np.argsort(-(q @ v.T), 1)[:, :6]
    assert np.mean([np.isin(true[i], kept[i]).mean() for i in range(40)]) > 0.97
    assert np.mean([len(x) for x in kept]) < 400
