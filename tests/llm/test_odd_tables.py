"""Columns named like the operators' own, ties, repeated rows, and a text of more than a megabyte, through every operator."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, bytespans, ctw, mixing, neardup, pii, quality, substring, urls
from tidemark.llm.common import n_words

#: Working names of the operators, as a user's columns.
NAMES = ("_row", "_id", "_key", "_s", "_range", "_before", "_target", "_offset", "_size", "_host", "_path", "_t", "_rule", "_verdict", "_a", "_b", "_hit", "block", "doc", "node", "key", "n", "size", "taken", "low", "high", "what", "of", "marks")


def words(n, seed=3):
    rnd = random.Random(seed)
    return [f"{rnd.choice('abcdeéß')}{rnd.randrange(40000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    long_ = " ".join(words(220_000))
    assert len(long_) > 1 << 20
    part = " ".join(words(220_000)[1000:1200])
    rows = [(1, long_), (2, long_), (3, part), (3, part), (4, None), (5, ""), (None, part), (6, "mail a@b.cd now"), (7, "mail a@b.cd now"), (8, "x" * 1_100_000)]
    df = spark.createDataFrame([(i, t, f"s{k % 2}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, at int")
    return df.select("*", *[F.concat(F.lit(c + ":"), F.col("at").cast("string")).alias(c) for c in NAMES]).cache()


def untouched(out, n=10):
    rows = out.collect()
    assert len(rows) == n and all(r[c] == f"{c}:{r['at']}" for r in rows for c in NAMES)
    return {r["at"]: r for r in rows}


def test_quality_and_personal_data(docs):
    q = untouched(quality.quality(docs))
    assert q[0]._quality.n_words == 220_000 and q[0]._quality == q[1]._quality and q[9]._quality.n_words == 1 and q[4]._quality.n_words == 0
    found = untouched(pii.find(docs, pii.train(docs)))
    assert [tuple(s) for s in found[7]._pii.email] == [(5, 11)] and found[0]._pii == found[1]._pii and found[9]._pii.email == []


def test_mixing(docs):
    sized = docs.withColumn("words", n_words(F.col("text")))
    out = untouched(mixing.mix(sized, size="words"))
    assert all(0 <= r._mix.taken <= 2 * r.words for r in out.values())


def test_urls(spark, docs):
    pages = docs.withColumn("url", F.concat(F.lit("http://example.com/en/"), F.col("at").cast("string"))).withColumn("url", F.when(F.col("at") == 4, None).otherwise(F.col("url")))
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    out = untouched(urls.judge(pages, labels, id_col="doc_id"))
    assert {k: r._url.verdict for k, r in out.items()} == {k: "allow" if k == 4 else "block" for k in range(10)}


def test_near_duplicates(docs):
    out = {r["at"]: r for r in neardup.first_of_each(docs).collect()}
    assert sorted(out) == [0, 2, 3, 4, 5, 6, 7, 9] and all(r[c] == f"{c}:{r['at']}" for r in out.values() for c in NAMES)


def test_repeated_passages_and_bytes(docs):
    out = untouched(substring.drop_repeats(docs, to=("n_words", "n_removed", "kept")))
    assert {k: (r.n_words, r.n_removed) for k, r in out.items()} == {0: (220_000, 0), 1: (220_000, 220_000), 2: (200, 200), 3: (200, 200), 4: (0, 0), 5: (0, 0), 6: (200, 0), 7: (3, 0), 8: (3, 0), 9: (1, 0)}
    spans = untouched(bytespans.drop_repeats(docs, keep=tuple(docs.columns)))
    size = {k: len((r.text or "").encode()) for k, r in spans.items()}
    gone = {k: r.n_removed for k, r in spans.items()}
    assert all(spans[k].n_bytes == size[k] for k in size)
    assert [gone[k] for k in (0, 1, 4, 5, 6, 7, 8)] == [0, size[1], 0, 0, 0, 0, 0]
    # Rows of one id are one document whose places coincide, and one letter repeats itself from its second place on.
    assert gone[2] == gone[3] == size[2] and gone[9] == size[9] - 1


def test_scores_and_tokens(docs):
    out = {r.doc_id: r for r in ctw.score(docs, F.coalesce(F.col("doc_id") == 2, F.lit(False))).collect()}
    assert out[1].score == pytest.approx(out[2].score) and out[1].n_tokens == 220_001 and out[6].n_bytes == len("mail a@b.cd now") + 1
    assert out[1].bits_per_byte == pytest.approx(-out[1].score / 0.30102999566 / out[1].n_bytes)
    ids = untouched(bpe.encode(docs))
    back = {r["at"]: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs.select("at", "text"))).collect()}
    assert all(back[k] == (r.text or "").encode() for k, r in ids.items()) and re.fullmatch(rb"x+", back[9])
