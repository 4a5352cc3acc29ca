import hashlib
import math
import random

from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.common import n_words


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water filling by the letter: reshare what is above until nobody is."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        for s in over or open_:
            out[s] = most * sizes[s] if over else level * w[s]
        if not over:
            break
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def rows():
    rnd = random.Random(2)
    out = [(i, rnd.choice(["a", "a", "a", "b", "c", "é", None]), " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300]))) for i in range(500)]
    return out + [(1000, "tiny", "one two"), (1001, "none", None), (1002, "none", ""), (None, "a", "x y z"), (3, "a", "same id"), (3, "a", "same id")]


def mixed(spark, data):
    df = spark.createDataFrame([(i, s, t, "clash") for i, s, t in data], "doc_id long, source string, text string, target string")
    sized = df.select("doc_id", "source", "target", n_words(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "source", "size", F.col("target").alias("own"), "_mix.*").collect()


def test_targets_and_budgets(spark):
    data = rows()
    got = mixed(spark, data)
    assert len(got) == len(data) and {r.own for r in got} == {"clash"}
    sizes = {}
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sizes[s] and math.isclose(own[0].target, want[s], rel_tol=1e-12)
        assert sum(r.taken for r in own) == math.floor(want[s])
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()))


def test_order_is_by_hash_and_runs_agree(spark):
    data = rows()
    a, b = sorted(map(str, mixed(spark, data))), sorted(map(str, mixed(spark, data[::-1])))
    assert a == b
    got = sorted((hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest(), r.taken / r.size) for r in mixed(spark, data) if r.source == "a" and r.size and r.doc_id not in (None, 3))
    shares = [s for _, s in got]
    assert shares == sorted(shares, reverse=True)


def test_empty_and_wordless_tables(spark):
    assert mixed(spark, []) == []
    assert [(r.target, r.taken) for r in mixed(spark, [(1, "a", None), (2, None, " ")])] == [(0.0, 0)] * 2
