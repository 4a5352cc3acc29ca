import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ctw


def brute_model(train: list[bytes], depth: int):
    """The definition, node by node: counts, KT by multiplying out, Pw by recursion."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for t in train:
        s = b"\n" * depth + t
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                c = s[i - d : i]
                if d:
                    children[c[1:]].add(c)
                for bit in range(8):
                    counts[c, (1 << bit) | (s[i] >> (8 - bit))][s[i] >> (7 - bit) & 1] += 1

    def kt(a, b):
        out, n0, n1 = 0.0, 0, 0
        for x in [0] * a + [1] * b:
            out += math.log(((n1 if x else n0) + 0.5) / (n0 + n1 + 1))
            n0, n1 = n0 + (x == 0), n1 + (x == 1)
        return out

    @lru_cache(None)
    def pw(c, p):
        if (c, p) not in counts:
            return 0.0
        k = kt(*counts[c, p])
        if len(c) == depth:
            return k
        return np.logaddexp(k, sum(pw(x, p) for x in children[c])) - math.log(2)

    def predict(past, p, x, d=0):
        c = past[len(past) - d :] if d else b""
        if (c, p) not in counts:
            return None
        n = counts[c, p]
        own = (n[x] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        w = math.exp(math.log(0.5) + kt(*n) - pw(c, p))
        longer = predict(past, p, x, d + 1)
        return own if longer is None else w * own + (1 - w) * longer

    def score(t):
        s, out = b"\n" * depth + t, 0.0
        for i in range(depth, len(s)):
            for bit in range(8):
                got = predict(s[i - depth : i], (1 << bit) | (s[i] >> (8 - bit)), s[i] >> (7 - bit) & 1)
                out += math.log10(0.5 if got is None else got)
        return out

    return score


TEXTS = ["the cat sat", "The  hat\nsat on the mat", "é ñ the", "the cat sat on the hat", None, "", "zzz qqq the", "THE CAT", "on on on on on", "a" * 90, "the cat sat", "x"]


def check(spark, texts, depth, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(i, t, False) for i, t in zip(ids, texts)], "doc_id long, text string, train boolean")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    got = sorted(ctw.score(df, held, depth=depth).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    out = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i in ids}
    train = [ctw.canonical(t) for i, t in zip(ids, texts) if not out[i]]
    c = Counter(w for t in train for w in t.split())
    if train:
        c["end"] = len(train)
    n, v = sum(c.values()), len(c)
    model = brute_model(train, depth)
    assert len(got) == len(texts)
    for r, (i, t) in zip(got, sorted(zip(ids, texts), key=lambda x: (x[0] is None, x[0]))):
        ws = [*ctw.canonical(t).split(), "end"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, model(ctw.canonical(t)), rel_tol=1e-9, abs_tol=1e-9), (i, t)


def test_scores_equal_the_definition(spark):
    check(spark, TEXTS, 3)
    check(spark, TEXTS[:6], 5)


def test_without_training_texts_and_with_null_ids(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    check(spark, ["ab", "c"], 3, held)
    check(spark, ["ab", "c d"], 3, [None, 5])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score(empty, F.lit(True)).count() == 0


def test_probabilities_of_the_next_byte_add_up():
    rnd = np.random.default_rng(3)
    text = bytes(rnd.choice(list(b"ab c\n"), 500).tolist())
    g, _ = ctw._strings([text], 3)
    u, n = np.unique(g, return_counts=True)
    levels = ctw.build(u, n, 3, 0)
    for context in (b"ab ", b"zzz", b"c\n\n", b" zb"):
        base = int.from_bytes(context, "big") << 8
        all_ = np.arange(256, dtype=np.uint64) + np.uint64(base)
        assert abs((10 ** ctw.log10_last(all_, levels)).sum() - 1) < 1e-9


def test_large_counts():
    assert math.isclose(ctw.log_kt(np.array([70_000]), np.array([3]))[0], sum(math.log((k + 0.5) / (k + 1)) for k in range(70_000)) + sum(math.log((k + 0.5) / (70_001 + k)) for k in range(3)), rel_tol=1e-9)
