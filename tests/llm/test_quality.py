import random
import re
from collections import Counter

from tidemark.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^ \t-\r]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def texts():
    rnd = random.Random(8)
    out = [None, "", " \n\x0b\x0c\r", "a b c d e a b c d e", "x " * 3000, "é🙂 漢字 " * 4, "same line\nsame line\n \nsame line ", "#$%& |<>* " * 5, "a\x1cb c\x85d " * 6]
    for _ in range(300):
        out.append("".join(rnd.choice(["a", "b", "cc", " ", " ", "\n", "\t", "#", "é", "the "]) for _ in range(rnd.randrange(0, 120))))
    return out + [out[3], "word%d " % 1 + " ".join(f"w{i}" for i in range(20_000))]


def test_measures_equal_brute_force(spark):
    data = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in data] + [(None, "null id", 1)], "doc_id long, text string, n_words int")
    got = quality.quality(df).collect()
    assert len(got) == len(data) + 1
    for r in got:
        if r.doc_id is not None:
            q = r._quality
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(data[r.doc_id][1]), data[r.doc_id][1]
            assert not (q.base_failed and q.kept) and q.kept == (q.failed == [])


def test_junk_goes_and_prose_stays(spark):
    prose = "The rain came down on the old roof and the cat slept by the fire. Nobody spoke of it for a while, and then they did."
    junk = {"symbols": " ".join(f"{w}$$$" for w in prose.split()), "shouting": " ".join(f"{w.upper()}!!" for w in prose.split()), "letters": " ".join(f"12 {i}" for i in range(30)) , "repeated_windows": "one two three four five " * 5, "few_words": "too short"}
    df = spark.createDataFrame([("prose", prose), ("lines", "\n".join(prose.split(". "))), *junk.items()], "name string, text string")
    got = {r.name: r._quality for r in quality.quality(df).collect()}
    assert got["prose"].kept and got["lines"].kept
    assert all(name in got[name].failed for name in junk)


def test_one_projection_without_exchange(spark):
    plan = quality.quality(spark.createDataFrame([(1, "a")], "doc_id long, text string")).where("_quality.kept")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
