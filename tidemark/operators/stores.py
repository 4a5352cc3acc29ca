"""Small stores: the history of runs, the cache of model files, catalogs of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: runs that a history keeps.
HISTORY = 30
HEAVY = ("thumbnail", "chart_svg", "temps", "lh", "analysis")


def keep_latest(runs: DataFrame, owner: str | None = None, most: int = HISTORY) -> DataFrame:
    """The newest `most` runs, of each owner where there is one."""
    newest = [F.desc("created_at"), F.desc("id")]
    if owner is None:
        return runs.orderBy(*newest).limit(most)
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy(*newest))).where(F.col("_n") <= most).drop("_n")


def listing(runs: DataFrame) -> DataFrame:
    """Runs, newest first, without their heavy columns."""
    return runs.drop(*HEAVY).orderBy(F.desc("created_at"), F.desc("id"))


def without(runs: DataFrame, ids: DataFrame) -> DataFrame:
    return runs.join(ids.select("id"), "id", "left_anti")


def chosen(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """The runs of the ids asked for; an id that no run has gives no row."""
    return runs.join(ids.select("id"), "id", "left_semi")


def cleared(runs: DataFrame) -> DataFrame:
    """An empty history with the same columns."""
    return runs.limit(0)


def counted(runs: DataFrame, *by: str) -> DataFrame:
    """(by, runs): how many runs there are, of each owner where one is named."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"))


def cache_state(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """(key, state): hit where the stored digest equals the wanted one, stale where it differs, else miss."""
    j = wanted.select("key", "sha256").join(cached.select("key", F.col("sha256").alias("_have")), "key", "left")
    return j.select("key", F.when(F.col("_have").isNull(), "miss").when(F.col("_have") == F.col("sha256"), "hit").otherwise("stale").alias("state"))


def verified(files: DataFrame) -> DataFrame:
    """Files whose bytes have the digest they claim."""
    return files.where(F.sha2("data", 256) == F.lower("sha256"))


def purge(cached: DataFrame, current: DataFrame) -> DataFrame:
    """The cache without other versions of files that have a current one."""
    latest = current.select(F.col("file_name").alias("_f"), F.col("version").alias("_v"))
    return cached.join(latest, F.col("file_name") == F.col("_f"), "left").where(F.col("_v").isNull() | (F.col("_v") == F.col("version"))).drop("_f", "_v")


def cached_bytes(cached: DataFrame) -> DataFrame:
    return cached.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def pick_images(labels: DataFrame, images: DataFrame, order: tuple[str, ...] = ("png", "jpg", "jpeg", "webp")) -> DataFrame:
    """labels plus the image with the same stem; of several the first by extension."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    stem = lambda c: F.regexp_extract(F.col(c), r"([^/]+?)(?:\.labels)?\.[^./]+$", 1)
    best = images.withColumn("_r", rank).where("_r > 0").groupBy(stem("path").alias("_s")).agg(F.min_by("path", "_r").alias("image"))
    return labels.join(best, stem("label_path") == F.col("_s"), "left").drop("_s")


def reviewed(labels: DataFrame) -> DataFrame:
    """Label files that a person has looked at, with two rows of 35 values and presences."""
    shape = lambda c: (F.size(c) == 2) & F.forall(c, lambda x: F.size(x) == 35)
    return labels.where(F.col("reviewed") & shape("value") & shape("present"))


def seed_labels(found: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """New label rows for sources that nobody has reviewed yet; all of them by force."""
    return found if force else found.join(existing.where("reviewed").select("source"), "source", "left_anti")
