"""Splits that are cut into many blocks give the rows that whole splits give."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, bytespans, ctw, substring


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rnd = random.Random(4)
    base = [" ".join(f"w{rnd.randrange(300)}" for _ in range(120)) for _ in range(20)]
    rows = [(i, " ".join(rnd.choice(base) for _ in range(rnd.randrange(3)))) for i in range(200)] + [(None, base[0]), (3, base[1]), (500, None)]
    path = str(tmp_path_factory.mktemp("blocks") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def same(a, b, digits=9):
    round_ = lambda r: tuple(round(x, digits) if isinstance(x, float) else x for x in r)
    return sorted(map(repr, map(round_, a.collect()))) == sorted(map(repr, map(round_, b.collect())))


def test_blocks_are_stable_and_bounded(docs):
    rows = docs.select(F.col("doc_id").alias("doc"), "text")
    some = blocks.blocked(rows, limit=20_000)
    assert some.select("block").distinct().count() > 5
    assert same(some.select("doc", "block"), blocks.blocked(rows, limit=20_000).where("true").select("doc", "block"))
    largest = some.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0]
    assert largest < 60_000


@pytest.mark.parametrize("run, module, name", [(lambda d: ctw.score(d, F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False))), ctw, "BLOCK"), (substring.drop_repeats, blocks, "LIMIT"), (bytespans.drop_repeats, blocks, "LIMIT")])
def test_results_do_not_depend_on_blocks(docs, run, module, name, monkeypatch):
    whole = run(docs)
    monkeypatch.setattr(module, name, 10_000)
    parts = run(docs)
    assert same(whole, parts, 6)
