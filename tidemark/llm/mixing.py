"""Operator 8, mixing sources to target weights.

Each row gets a random key from a hash of its id. Rows are range-sorted by key within their source:
the key's leading digits name one of 4096 ranges, so a source of any size is spread over that many
sort groups, and no task ever holds a source. Sums per range are added up along the ranges (at most
4096 rows a source), and a row's prefix sum is its range's offset plus the running sum inside the
range. The cut falls at the source's exact budget; whole epochs come before it.

Defined results: a null text has size 0 and is never taken; a null source is a source, the last;
a null id's key comes from its size, so such rows spread over the ranges; equal ids share a key and are taken in the
order of their sizes; an empty table gives an empty table. Other columns ride along unchanged, whatever their names; only
an older column `_mix` is replaced. Sources themselves are sorted in one task: a table of one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1:"


def _source_key(c: str) -> Column:
    """A source as a join key that holds null too."""
    return F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: one row a source (_s, _source_size). Adds _target: weights share out `share` of all
    sizes; what a source gets above `most` times its size is shared again among the others.

    Sources fill up in the order of capacity to weight, so one pass in that order finds the level at
    which nobody is above: all sources before it are full, all others get level times weight."""
    nth = F.row_number().over(Window.orderBy((F.col("_s") == "n").cast("int"), "_s")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (nth % len(weights) + 1).cast("int"))
    w = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("_source_size") * most)
    by = Window.orderBy((F.col("_cap") / F.col("_w")), "_s")
    before, rest, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    full = F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = (F.sum("_source_size").over(all_) * F.lit(share) - full) / F.sum("_w").over(rest)
    w = w.withColumn("_level", level)
    open_ = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("a"), F.col("_s").alias("b"), F.col("_level").alias("level")))).over(all_)
    final = F.least(F.col("_cap").cast("double"), F.coalesce(open_["level"] * F.col("_w"), F.col("_cap").cast("double")))
    return w.select("_s", "_source_size", final.alias("_target"))


def mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "size", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """df (with a size column) plus a struct `_mix`: source_size, target, taken. The row itself rides along as one struct, so
    no column of it can clash with the working names."""
    kept = [c for c in df.columns if c != "_mix"]
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.col(size).cast("string")), F.lit(""))))
    rows = df.select(F.struct(*kept).alias("_row"), F.col(id_col).alias("_id"), F.col(size).alias("_size"), _source_key(source).alias("_s"), key.alias("_key")).withColumn("_range", F.substring("_key", 1, 3))
    ranges = rows.groupBy("_s", "_range").agg(F.sum("_size").alias("_range_size"))
    budget = targets(ranges.groupBy("_s").agg(F.sum("_range_size").alias("_source_size")), weights, share, most)
    along = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_range_size").over(along), F.lit(0))).drop("_range_size")
    offsets = offsets.join(budget, "_s")
    inside = Window.partitionBy("_s", "_range").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(offsets, ["_s", "_range"])
    whole = F.floor(F.col("_target"))
    n = F.greatest(F.col("_source_size"), F.lit(1))
    rest = F.greatest(F.lit(0), F.least(F.col("_size"), whole % n - F.col("_offset") - F.col("_before")))
    taken = (F.col("_size") * F.floor(whole / n) + rest).cast("long")
    mixed = F.struct(F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))
    return out.select("_row.*", mixed.alias("_mix"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "_mix.source_size", "_mix.target", "_mix.taken")
