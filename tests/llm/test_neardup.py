import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import neardup, textbytes
from tidemark.llm.graph import components


def shingles(t, k=2):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^ \t-\r]+", t or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
    sets = {i: shingles(t) for i, (d, t) in enumerate(rows)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return {i: (len(sets[i]), least.get(root(i)) if d is not None else None) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=60, copies=12):
    rnd = random.Random(seed)
    word = lambda: f"W{rnd.randrange(3000)}É"
    out = []
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([1, 2, 3, 5, 8, 20, 60, 200]))]
        for _ in range(rnd.randrange(1, copies)):
            t = list(base)
            for _ in range(int(len(t) * rnd.choice([0, 0.01, 0.03, 0.05, 0.08, 0.12]))):
                t[rnd.randrange(len(t))] = word()
            out.append(" ".join(t) if rnd.random() < 0.7 else "\n ".join(t).upper().replace("É", "É"))
    out += [None, "", " \t", "one", "ONE", "one two", "One  Two"]
    rnd.shuffle(out)
    rows = list(enumerate(out))
    return rows + [(None, rows[3][1]), (2, rows[2][1])]


@pytest.mark.parametrize("whole, block", [(4000, 1000), (4, 3), (1, 1000)])
def test_components_equal_brute_force(spark, whole, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(4)
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, node int")
    got = sorted(map(str, (tuple(r) for r in neardup.groups(df, rounds=1 if block == 3 else 3, whole=whole).collect())))
    want = sorted(str((d, n, c, c == d if d is not None else True)) for i, (n, c) in brute(rows).items() for d in [rows[i][0]])
    assert got == want
    assert neardup.first_of_each(df).where("doc_id is not null").count() == sum(f"{d}" != "None" and c == d for i, (n, c) in brute(rows).items() for d in [rows[i][0]])


def test_estimates_are_near_the_truth():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    for share in (0.5, 0.8, 0.95):
        n = 1500
        common = int(2 * n * share / (1 + share))
        a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
        j, used = neardup.estimate(neardup.sketch(np.unique(a)), neardup.sketch(np.unique(b)))
        assert abs(j - share) < 4 * (share * (1 - share) / used) ** 0.5


def test_band_keys_of_small_sets():
    s = np.stack([neardup.sketch(np.unique(textbytes.mix(np.arange(k, k + n, dtype=np.uint64)))) for k, n in ((1, 10), (1, 10), (1, 9), (500, 10))])
    keys = neardup.band_keys(neardup.densify(s))
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[2]).any() and not (keys[0] == keys[3]).any()


def test_chain_of_links(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_empty_table(spark):
    assert neardup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_low_estimates_reach_the_exact_check():
    """Sets of similarity 0.9 whose sketches differ in 85 registers of 256, five standard errors below the threshold."""
    rng = np.random.default_rng(9)
    b = np.unique(np.concatenate([(i << np.uint64(56)) | rng.integers(1 << 40, 1 << 56, 4).astype(np.uint64) for i in np.arange(256, dtype=np.uint64)]))
    a = np.unique(np.concatenate([b, (np.arange(85, dtype=np.uint64) << np.uint64(56)) | np.uint64(7)]))
    sketches = [neardup.sketch(x) for x in (a, b)]
    j, n = neardup.estimate(*sketches)
    assert len(b) > 0.9 * len(a) and -6 < (j - 0.8) / np.sqrt(0.8 * 0.2 / n) < -5
    table = pa.table({"node": [1, 2], "doc": [1, 2], "sketch": [x.tobytes() for x in sketches], "set": [x.tobytes() for x in (a, b)]})
    assert neardup._within(80)(table).column("least").to_pylist() == [1, 1]
    pairs = pa.table({"a": [1], "b": [2]})
    assert neardup._verify(80)(pairs, table).num_rows == 1


def test_estimates_drop_fewer_pairs_than_bands():
    def lower(n):
        least = n * 0.8 - neardup.MARGIN * (n * 0.8 * 0.2) ** 0.5
        return sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(n + 1) if k < least - 1e-9)

    assert max(map(lower, range(1, neardup.REGISTERS + 1))) < (1 - 0.8**neardup.ROWS) ** neardup.BANDS / 10


def test_rounds_do_not_multiply_size_estimates(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    found = components(df)
    # The digits of the estimated bytes of a result tripled with each round of joins.
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**150
    assert {(r.node, r.comp) for r in found.collect()} == {(i, 0) for i in range(n + 1)}
