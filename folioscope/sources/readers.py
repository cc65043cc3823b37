"""Reading files of the tool: page images, Markdown, line-delimited logs, trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def image_files(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """(path, length, sha256) of image files; the bytes are hashed and dropped."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))


def image_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data) of images, decoded on the JVM."""
    return spark.read.format("image").load(folder).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def markdown_files(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """(path, text) of whole Markdown files."""
    return spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def log_files(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """(log_file, line_no, value): lines of log files, numbered from 1 within their file."""
    t = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("log_file"), F.regexp_replace("value", r"\n\z", "").alias("value"))
    return t.select("log_file", F.posexplode(F.split("value", r"\r?\n")).alias("i", "value")).select("log_file", (F.col("i") + 1).cast("long").alias("line_no"), "value")


def trial_files(spark: SparkSession, folder: str) -> DataFrame:
    """Trials of a run folder (trials/trial-*/trial.json) with the text of the answer beside each."""
    where = lambda name: F.regexp_replace(F.col("_metadata.file_path"), f"/{name}$", "")
    t = spark.read.option("multiLine", True).json(f"{folder}/trials/trial-*/trial.json").withColumn("__dir", where("trial.json"))
    r = spark.read.text(f"{folder}/trials/trial-*/response.txt", wholetext=True).select(where("response.txt").alias("__dir"), F.col("value").alias("raw_response"))
    return t.join(r, "__dir", "left").drop("__dir")
