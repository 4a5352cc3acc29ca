"""Readings as a stream: late and repeated readings arrive, touched cycles are computed again.

A cycle's features need all of its days, so each micro-batch merges its readings into the stored ones of the cycles it touches
and computes only these cycles' features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import features

SCHEMA = "cycle_id long, day int, temp double, lh double, seen_at timestamp"


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def latest(readings: DataFrame, late: str = "7 days") -> DataFrame:
    """Daily readings of a stream, the last seen of each day; state older than `late` is dropped by the watermark."""
    return readings.withWatermark("seen_at", late).groupBy("cycle_id", "day", F.window("seen_at", late)).agg(F.max_by("temp", "seen_at").alias("temp"), F.max_by("lh", "seen_at").alias("lh"))


def hourly_counts(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Readings an hour, with a watermark."""
    return readings.withWatermark("seen_at", late).groupBy(F.window("seen_at", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("readings"), F.approx_count_distinct("cycle_id").alias("cycles"))


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All readings of the cycles in `new`, the last seen of each day."""
    touched = new.select("cycle_id").distinct()
    both = stored.join(touched, "cycle_id", "left_semi").unionByName(new)
    last = both.groupBy("cycle_id", "day").agg(F.max(F.struct("seen_at", "temp", "lh")).alias("r"))
    return last.select("cycle_id", "day", "r.temp", "r.lh", "r.seen_at")


#: Parts of the store, by a hash of the cycle; a batch reads those of its cycles only.
PARTS = 256


def _part() -> Column:
    return F.pmod(F.xxhash64("cycle_id"), F.lit(PARTS)).cast("int")


def update(store: str, out: str, unit: float = 1.0):
    """A foreachBatch function: appends readings to the Parquet folder `store` and the touched cycles' features to `out`, one folder
    a batch, so a batch that runs again overwrites itself. The store is partitioned by a hash of the cycle: a batch of few cycles
    reads few of its folders, however large it has grown."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("part", _part()).write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={batch_id}")
        touched = [r["part"] for r in batch.select(_part().alias("part")).distinct().collect()]  # at most PARTS numbers
        stored = spark.read.option("basePath", store).schema(f"{SCHEMA}, batch long, part int").parquet(store).where(F.col("part").isin(touched)).drop("batch", "part")
        merged = merge(stored, batch.select(*stored.columns))
        features(merged, unit).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return run


def start(stream: DataFrame, store: str, out: str, checkpoint: str, unit: float = 1.0):
    return stream.writeStream.foreachBatch(update(store, out, unit)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
