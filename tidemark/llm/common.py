"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every operator here understands it: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application; they may not have it installed. Batches for
    Python are kept to a few MB: rows hold whole texts. Every operator that starts Python workers calls this itself."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(target)
    sc._tidemark_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row.

    Higher-order functions evaluate a captured expression for each element; a lambda
    variable is evaluated once, so long arrays are always bound through here."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without an array of them: a word starts where no word character stands before."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(NON_SPACE + "++")).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share. Where none is set, a local one is made if all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if where is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if where is not None and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where or sc._jsc.sc().getCheckpointDir().get()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there: lineage ends, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_unsized(df: DataFrame) -> DataFrame:
    """cut for loops. A checkpoint keeps the planner's estimate of its bytes, and a join's estimate is the product of its sides': a
    loop that joins its own results multiplies the number's length in each round, until the number alone fills the driver.
    Here the size is unknown, which to the planner is a fixed large number; rows and partitioning stay."""
    done = cut(df)
    plan, session = done._jdf.queryExecution().logical(), df.sparkSession
    none = session._jvm.scala.Option.empty()
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session._jsparkSession, none, none)
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)
