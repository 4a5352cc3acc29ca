"""Files: manifests, corpus labels, images, and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.stores import reviewed

MANIFEST = "version string, created_at string, files array<struct<name:string,bytes:long,sha256:string>>, feature_names array<string>, labels array<string>, iforest_score_percentiles struct<p5:double,p50:double,p95:double>"
LABELS = "source string, reviewed boolean, scale_idx int, scale_label string, value array<array<double>>, present array<array<int>>, pipeline_confidence double, pipeline_status string, note string"
FIXTURES = "archetype string, k long, temps array<double>, lh array<double>, expected_features array<double>"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def corpus_labels(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed label files of the right shape, with their paths."""
    return reviewed(spark.read.schema(LABELS).option("multiLine", True).json(path).withColumn("label_path", F.input_file_name()))


def label_days(labels: DataFrame) -> DataFrame:
    """(source, series, day, value, present) of label files."""
    series = F.explode(F.array(F.struct(F.lit("temp").alias("series"), F.get("value", F.lit(0)).alias("v"), F.get("present", F.lit(0)).alias("p")), F.struct(F.lit("lh").alias("series"), F.get("value", F.lit(1)).alias("v"), F.get("present", F.lit(1)).alias("p"))))
    d = labels.select("source", series.alias("s")).select("source", "s.series", F.posexplode(F.arrays_zip("s.v", "s.p")).alias("day", "d"))
    return d.select("source", "series", "day", F.col("d.v").alias("value"), F.col("d.p").alias("present"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as bytes, with their digests; decoding is left to who has a codec."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def work_size(width, height, low: int = 1200, high: int = 2400):
    """Width and height of the working canvas: the width is brought into [low, high], the shape stays."""
    scale = F.when(width < low, F.lit(float(low)) / width).when(width > high, F.lit(float(high)) / width).otherwise(1.0)
    return F.struct(F.bround(width * scale).cast("int").alias("width"), F.bround(height * scale).cast("int").alias("height"), scale.alias("scale"))


def resize(pixels: DataFrame, scale: float) -> DataFrame:
    """A pixel table at another size: shrinking averages the pixels that fall on one, growing repeats the nearest."""
    if scale <= 1:
        g = pixels.groupBy("image_id", F.floor(F.col("x") * scale).cast("int").alias("x"), F.floor(F.col("y") * scale).cast("int").alias("y"))
        return g.agg(*[F.bround(F.avg(c)).cast("int").alias(c) for c in ("r", "g", "b")])
    grow = lambda c: F.explode(F.sequence(F.ceil(F.col(c) * scale).cast("int"), (F.ceil((F.col(c) + 1) * scale) - 1).cast("int")))
    return pixels.withColumn("_x", grow("x")).withColumn("_y", grow("y")).select("image_id", F.col("_x").alias("x"), F.col("_y").alias("y"), "r", "g", "b")


def table_json(cells: DataFrame, rows: tuple[str, ...]) -> DataFrame:
    """(image_id, json) of a chart's table: all rows are there, in their order, also the empty ones."""
    spine = cells.select("image_id").distinct().withColumn("row", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("row_name")) for i, r in enumerate(rows)]))).select("image_id", "row.i", "row.row_name")
    packed = cells.groupBy("image_id", "row_name").agg(F.array_sort(F.collect_list(F.struct("day", "text", "kind"))).alias("cells"))
    j = spine.join(packed, ["image_id", "row_name"], "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<day:int,text:string,kind:string>>")))
    g = j.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "row_name", "cells"))).alias("rows"))
    return g.select("image_id", F.to_json(F.struct(F.transform("rows", lambda r: F.struct(r["row_name"].alias("name"), r["cells"].alias("cells"))).alias("rows"))).alias("json"))
