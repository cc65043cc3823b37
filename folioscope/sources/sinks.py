"""Writing results: tables, and documents as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A table in place of what was there; running it again gives the same."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_states(df: DataFrame, path: str) -> None:
    """States are only ever added; the last one of a key is a view (operators.projection.latest)."""
    df.write.mode("append").parquet(path)


def write_documents(parts: DataFrame, folder: str, book: str = "book_id", text: str = "markdown") -> None:
    """Parts of assembled documents as text files, a folder a book, in the order of their parts."""
    parts.select(F.col(book).alias("book"), "part", F.col(text).alias("value")).repartition("book", "part").sortWithinPartitions("book", "part").select("value", "book", "part").write.mode("overwrite").partitionBy("book", "part").text(folder)


def json_report(df: DataFrame) -> DataFrame:
    """Each row of a report as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_trials(trials: DataFrame, folder: str) -> None:
    """Files of a benchmark: a folder a run and trial with its row as JSON and the text of its answer, and a summary a run."""
    t = trials.select("run_id", F.col("id").alias("trial"), F.to_json(F.struct(*trials.columns)).alias("value"))
    t.repartition("run_id", "trial").write.mode("overwrite").partitionBy("run_id", "trial").text(f"{folder}/trials")
    if "raw_response" in trials.columns:
        r = trials.where("raw_response IS NOT NULL").select("run_id", F.col("id").alias("trial"), F.col("raw_response").alias("value"))
        r.repartition("run_id", "trial").write.mode("overwrite").partitionBy("run_id", "trial").text(f"{folder}/responses")
    s = trials.groupBy("run_id").agg(F.count("*").alias("trials"), F.count_if(F.col("status") == "succeeded").alias("succeeded"))
    s.write.mode("overwrite").json(f"{folder}/summary")


def append_turns(turns: DataFrame, path: str) -> None:
    """Turns of a session by run, only ever added; a turn that is written twice counts once when read by its id."""
    turns.write.mode("append").partitionBy("run_id").parquet(path)


def printed(df: DataFrame) -> DataFrame:
    """(value): each row as ``key=value`` pairs by key; nulls are left out."""
    pairs = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string"))) for c in sorted(df.columns)]
    return df.select(F.concat_ws(" ", *pairs).alias("value"))
