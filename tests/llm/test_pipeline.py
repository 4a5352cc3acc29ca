import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_neardup import shingles
from tests.llm.test_pii import brute as pii_brute
from tidemark.llm import bpe, quality


def words(t):
    return re.findall(r"[^ \t-\r]+", t or "")


def keeps(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    m = {
        "one": 1, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in quality.SYMBOLS for c in t or ""), "n_marks": (t or "").count("!"),
        "n_repeat_words": len(hit), "n_stop_words": sum(x.lower() in quality.STOP_WORDS for x in w), "n_letter_words": sum(any(c.isalpha() for c in x) for x in w),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
    }
    return not any(len(w) >= r.words and (m[r.measure] < m[r.per] * r.low if math.isfinite(r.low) else False or (math.isfinite(r.high) and m[r.measure] > m[r.per] * r.high + 1e-12)) for r in (*quality.BASE_RULES, *quality.RULES))


def first_of_each(docs):
    rows = [(d["doc_id"], d["text"]) for d in docs]
    sets = [shingles(t, 5) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [d for i, d in enumerate(docs) if least[root(i)] == d["doc_id"]]


def redacted(t):
    spans = [(a, b, f"[{k}]") for k, v in pii_brute(t).items() for a, b in v]
    base = list(spans)
    free = lambda a, b: not any(x <= a and b <= y for x, y, _ in base)
    known = r"[0-9a-f]{16,}|(?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16}"
    for m in re.finditer(r"(?<![A-Za-z0-9])(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{12,}", t):
        if re.fullmatch(known, m.group()) and free(*m.span()):
            spans.append((*m.span(), "[secret]"))
    out, at = "", 0
    for a, b, by in sorted(spans):
        if a >= at:
            out, at = out + t[at:a] + by, b
        else:
            at = max(at, b)
    return out + t[at:]


def mixed(docs):
    size = {id(d): len(words(d["text"])) for d in docs}
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size[id(d)] for d in docs if d["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    open_, target, left = set(sources), {}, 1.5 * sum(of.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * of[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * of[s]
            left -= 2 * of[s]
            open_.remove(s)
    out = []
    for s in sources:
        budget, before = math.floor(target[s]), 0
        for d in sorted((d for d in docs if d["source"] == s), key=lambda d: (hashlib.md5(f"mix-1:{d['doc_id']}".encode()).hexdigest(), d["doc_id"])):
            n = size[id(d)]
            taken = n * (budget // of[s]) + max(0, min(n, budget % of[s] - before)) if of[s] else 0
            before += n
            out += [d] * math.floor(taken / max(n, 1) + 0.5)
    return out


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pipeline_equals_plain_python(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [r.asDict() for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    stages, df = [docs], None
    docs = [d for d in docs if keeps(d["text"])]
    stages.append(docs)
    docs = first_of_each(docs)
    stages.append(docs)
    docs = [d | {"text": redacted(d["text"])} for d in docs]
    stages.append(docs)
    docs = mixed(docs)
    stages.append(docs)
    encode = bpe.codec()._leaf
    want = sorted((d["doc_id"], d["source"], np.array(encode(d["text"]), "<u4").tobytes()) for d in docs)
    got = sorted((r.doc_id, r.source, bytes(r.ids)) for r in cp.run(spark, path).collect())
    df = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), plain in zip(cp.STAGES[:4], stages[1:]):
        rows = [r.asDict() for r in stage(spark, df, path).collect()]
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((d["doc_id"], d["text"]) for d in plain), name
        assert rows == [] or list(rows[0]) == df.columns
        df = spark.createDataFrame([tuple(r[c] for c in df.columns) for r in rows], df.schema)
    assert got == want


def test_odd_rows_pass_every_stage(spark):
    text = " ".join(f"word{i} the of and" for i in range(30))
    odd = [(1, text, "en", "a", 3, 9), (1, text, "en", "a", 3, 9), (2, None, None, None, None, 1), (3, "", "en", None, 0, 2), (None, text + " more", None, None, None, 3), (4, text.upper(), "en", None, 5, 4), (5, "x" * 200_000, "en", "b", 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _quality int"
    for rows in (odd, []):
        df = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES:
            df = stage(spark, df, "")
            assert df.count() >= bool(rows), name
            assert [c for c in df.columns if c != "text"][:5] == ["doc_id", "lang", "source", "n_chars", "_quality"], name
    assert near_brute([(1, text)])[0][0] > 0


def test_near_duplicates_of_a_chain_keep_size_estimates_short(spark):
    """Each text resembles the next one only, so that their links take several rounds; the estimated bytes had three times as many digits after each."""
    stream = [f"w{i}" for i in range(1200)]
    df = spark.createDataFrame([(i, " ".join(stream[6 * i : 6 * i + 120])) for i in range(160)], "doc_id long, text string")
    left = cp.near_duplicates(spark, df, "")

    def largest(plan):
        below = plan.children()
        return max([plan.stats().sizeInBytes(), *[largest(below.apply(i)) for i in range(below.size())]])

    assert largest(left._jdf.queryExecution().optimizedPlan()) < 10**150
    assert [r.doc_id for r in left.collect()] == [0]
