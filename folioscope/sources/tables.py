"""Reading the project's tables and writing shared intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep one row of each natural key: the first in the given order.

    Rows with a null in the key are kept, as one group of their own. The window is limited to rank 1, so Spark
    drops the other copies before the shuffle as well as after it.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")


def hash_sample(df: DataFrame, n: int, *keys: str) -> list[Row]:
    """At most ``n`` rows on the driver, the same on every run: those whose keys have the least hashes.

    The rows are counted first and a bound on the hash is set just above ``n`` of them, so what reaches the driver
    doesn't grow with the number of partitions or rows. Rows of one key share a hash; which of them stay is told by their text.
    """
    total = df.count()
    h = F.pmod(F.xxhash64(*keys, F.lit(0)), F.lit(1 << 40))
    near = df.withColumn("__h", h)
    if total > n:
        near = near.where(F.col("__h") < int((n + 8 * n**0.5 + 8) / total * (1 << 40)))
    rows = sorted(near.collect(), key=lambda r: (r["__h"], str(r)))
    return rows[:n]


def most_frequent(df: DataFrame, n: int, count: str) -> DataFrame:
    """The rows of the highest counts, at most ``n`` and whole steps of 1/32 of a power of two of the count.

    The steps are counted first (some hundred rows), so no partition sends its own top rows anywhere.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 32).cast("int")
    left, least = n, None
    for r in sorted(df.where(F.col(count) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        if r.n > left:
            break
        left, least = left - r.n, r.step
    return df.where(F.lit(False) if least is None else (F.col(count) > 0) & (step >= least))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a folder of its own machine; a cluster is an error, since its
    executors share no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "folioscope-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/folioscope/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that read them can't be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_end(spark: SparkSession) -> None:
    """Have the application's folder deleted when its file system is closed, at the end of the driver's JVM."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts the lineage: the rows survive the loss of any executor and are computed once, however often they are read.
    The folder goes when the application ends, or earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=codec)
    _release_at_end(spark)
    return spark.read.schema(df.schema).parquet(path)
