import random
import re

import numpy as np

from tidemark.llm import substring


def brute(rows, window=50):
    words = [(i, d, re.findall(r"[^ \t-\r]+", t or "")) for i, (d, t) in enumerate(rows)]
    first = {}
    for _, d, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = {}
    for i, d, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def rows():
    rnd = random.Random(11)
    word = lambda n: [f"w{rnd.randrange(400)}é" for _ in range(n)]
    passages = [word(n) for n in (49, 50, 51, 60, 80, 130)]
    out = [(0, None), (1, ""), (2, "  \n ")]
    for d in range(3, 140):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            parts += word(rnd.randrange(0, 70)) + rnd.choice(passages)[rnd.randrange(0, 3) :]
        out.append((d, rnd.choice([" ", "\n", " \t "]).join(parts)))
    out += [(200, out[10][1]), (201, out[10][1]), (202, " ".join(word(40))), (203, out[-1][1]), (None, out[10][1]), (204, "a " * 400), (205, "a " * 300), (206, "a " * 49)]
    out += [(300, out[11][1]), (300, " ".join(word(120))), (301, " ".join(word(10) + passages[5])), (5, " ".join(passages[4]))]
    rnd.shuffle(out)
    return out


def test_cover_brings_any_two_places_together():
    c, p = set(substring.COVER), substring.PERIOD
    assert all(any((i + s) % p in c and (j + s) % p in c for s in range(p)) for i in range(p) for j in range(p))


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, d, t, "z") for i, (d, t) in enumerate(data)], "i int, doc_id long, text string, n_words string")
    got = {r.i: (r.n_words, r.n_removed, r.text) for r in substring.drop_repeats(df).collect()}
    want = brute(data)
    assert len(got) == len(data)
    for i in want:
        assert got[i] == want[i], (i, data[i][0])
    assert sum(w[1] > 0 for w in want.values()) > 50


def test_empty_table(spark):
    assert substring.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_match_runs_only():
    from tidemark.llm import textbytes as tb

    data = np.frombuffer(b"ab ab  abc\x0bab", np.uint8)
    w = tb.Words(data, np.array([0, 6, 6, 13]))
    h = w.hashes(tb.byte_prefix(data))
    assert list(w.count) == [2, 0, 2] and h[0] == h[1] == h[3] != h[2]
