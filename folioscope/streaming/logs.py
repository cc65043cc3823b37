"""Log import and page states as streams: the batch operators over readStream, with watermarks and idempotent sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.logs import imported
from folioscope.sources.tables import shared_dir


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New log files of a folder as imported lines; the line's number isn't known in a stream, its file is."""
    lines = spark.readStream.format("text").load(folder).withColumn("log_file", F.col("_metadata.file_path"))
    return imported(lines)


def level_rates(lines: DataFrame, time: str = "time", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, level, n) of a stream of lines, closed once its watermark has passed."""
    t = lines.withColumn("at", F.try_to_timestamp(F.col(time))).where("at IS NOT NULL").withWatermark("at", late)
    return t.groupBy(F.window("at", width), F.coalesce("level", F.lit("none")).alias("level")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "level", "n")


def to_table(stream: DataFrame, path: str, name: str) -> StreamingQuery:
    """Append a stream to parquet; its checkpoint lies in the shared folder, so a restart goes on where it stopped."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/streams/{name}").start(path)
