"""Import of line-delimited JSON logs, and counts over imported lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("level", "event", "workflow_id", "op_id", "site", "queue", "attempt", "workflow_status", "error_code", "time")
TROUBLE = ("warn", "error", "fatal", "panic")


def imported(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines with their fields where a line is one JSON object; else parsed is false and the message is the line.

    Only string values fill string fields, except retryable and attempt, which are written out; message falls back to msg.
    """
    v = lines.withColumn("v", F.expr(f"CASE WHEN `{line}` LIKE '%{{%' THEN try_parse_json(`{line}`) END"))
    v = v.withColumn("parsed", F.expr("coalesce(schema_of_variant(v) LIKE 'OBJECT%', false)"))
    text = lambda k: F.expr(f"CASE WHEN parsed AND schema_of_variant(try_variant_get(v, '$.{k}', 'variant')) = 'STRING' THEN try_variant_get(v, '$.{k}', 'string') END")
    any_text = lambda k: F.expr(f"CASE WHEN parsed THEN cast(try_variant_get(v, '$.{k}', 'variant') as string) END")
    out = v.select(*lines.columns, "parsed", *[(any_text(k) if k == "attempt" else text(k)).alias(k) for k in FIELDS], F.when(F.col("parsed"), F.coalesce(text("message"), text("msg"))).otherwise(F.col(line)).alias("message"), any_text("retryable").alias("retryable"), F.col(line).alias("raw"))
    return out


def level_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce(F.nullif("level", F.lit("")), F.lit("none")).alias("level")).agg(F.count("*").alias("n"))


def counts(log: DataFrame) -> DataFrame:
    """Lines in all, parsed, of trace and of trouble, and events that aren't trace."""
    level = F.lower(F.coalesce("level", F.lit("")))
    return log.agg(F.count("*").alias("lines"), F.count_if("parsed").alias("parsed"), F.count_if(level == "trace").alias("trace"), F.count_if(level.isin(*TROUBLE)).alias("trouble"), F.count_if((level != "trace") & (F.coalesce("event", F.lit("")) != "")).alias("events"))


def events(log: DataFrame) -> DataFrame:
    """(event, n, failures) of named events."""
    return log.where("event IS NOT NULL AND event <> ''").groupBy("event").agg(F.count("*").alias("n"), F.count_if(F.lower("level").isin("warn", "error") | F.col("event").like("%failed%")).alias("failures"))


def failures(log: DataFrame) -> DataFrame:
    """Lines of trouble or of failed events."""
    return log.where(F.lower("level").isin("warn", "error") | F.col("event").like("%failed%"))
