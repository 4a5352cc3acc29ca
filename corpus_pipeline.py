"""A corpus pipeline of five stages, each one operator of tidemark.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; `run` writes every
stage's rows as Parquet under the shared checkpoint folder and reads them again, so a lost executor
costs one stage at most and no lineage grows.

Defined results: an empty `documents` table passes through every stage as an empty table; null texts fail the
quality rules; null ids and repeated rows are treated as each operator's docstring says; all further columns of
`documents` are carried to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, neardup, pii, quality
from tidemark.llm.common import drop_folder, n_words, read, shared_dir


def _packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row of docs as one struct `row`, beside what the operator works on, so that no names can clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(k) for k, c in more.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality.quality(_packed(docs, text=F.col("text"))).where("_quality.kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.first_of_each(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars, where there is one, follows the new text."""
    rows = _packed(docs, text=F.col("text"))
    found = pii.find(rows, pii.train(rows))
    touched = F.exists(F.array(*[F.size(f"_pii.{k}") > 0 for k in (*pii.KINDS, *pii.ADDED)]), lambda x: x)
    new = found.select("row", touched.alias("touched"), pii.redact(F.col("text"), F.col("_pii")).alias("new"))
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("touched"), F.length("new")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return new.select(row.alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for each whole time. The one document of each source at which
    the budget ends counts as whole if at least half of it is taken, so no text is cut."""
    sized = _packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=n_words(F.col("text")))
    times = F.floor(F.col("_mix.taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    mixed = mixing.mix(sized).withColumn("times", times).where("times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, and n_tokens, ids (the ids of the text as little-endian unsigned 32-bit integers) and
    round_trip, whether they decode to it; older columns of these three names are replaced."""
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "round_trip")]
    ids = bpe.encode(docs.select(F.struct(*kept).alias("row"), "text"))
    back = bpe.decode(ids)
    same = F.coalesce(F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.lit(False))
    return back.select("row.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Connected components, learned weights and BPE have no counterpart in SQL; tests/llm/test_pipeline.py holds the
#: pipeline against a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of sf_dir. A stage's folder goes once the next one is written;
    the last one stays, for the result is read from it."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                drop_folder(spark, before)
            before = path
    return docs
