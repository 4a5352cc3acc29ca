"""Blocks of documents that ask the corpus questions.

A block is one split of the input files, or a part of it that holds about LIMIT bytes of text. A task that holds a
block's texts reduces them to distinct keys (hashes or short byte strings) with combined values; keys are dealt out by
hash, answered once, and the answers go back to the blocks that asked. So a key has at most one row for each
block, however many documents repeat it: no key is hot. The texts of a block meet its answers in one task of
bounded size, whatever the splits' compression: only one text longer than LIMIT makes a larger block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes of text in a block, about.
LIMIT = 24 << 20


def blocked(rows: DataFrame, doc: str = "doc", text: str = "text", limit: int | None = None) -> DataFrame:
    """rows plus `block`, the same however often and in whatever branch of a plan it is computed.

    Splits (file and offset) are stable names, and a hash of id and text deals a split's rows to its parts. Rows that
    come from no file (or through a shuffle) have no such name: they are written out once with blocks made of
    their hashes and of where they stood."""
    limit = limit or LIMIT
    name, size = F.input_file_name(), F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    split = F.struct(name.alias("name"), F.input_file_block_start().alias("start"))
    splits = rows.select(split.alias("split"), size.alias("size")).groupBy("split").agg(F.sum("size").alias("size"))
    most, nameless, all_ = splits.agg(F.max("size"), F.count(F.when(F.col("split.name") == "", 1)), F.sum("size")).first()
    parts = lambda n: max(1, -(-(n or 0) // limit))
    part = lambda n: F.pmod(F.xxhash64(doc, text), F.lit(parts(n)))
    if nameless:
        # Equal rows may be many: their standing spreads them too. What is written doesn't change any more.
        place = F.pmod(F.xxhash64(doc, text, F.monotonically_increasing_id()), F.lit(parts(all_)))
        return cut(rows.withColumn("block", F.xxhash64(place)))
    return rows.withColumn("block", F.xxhash64(name, F.input_file_block_start(), part(most)))


def meet(texts: DataFrame, answers: DataFrame, fn, schema) -> DataFrame:
    """fn(texts of a block, answers to it) for each block; both are Arrow tables, `block` names the block in each."""
    back = answers.withColumnRenamed("block", "of")
    return texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(fn, schema)
