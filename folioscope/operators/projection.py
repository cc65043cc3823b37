"""Status projections as views over append-only states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.documents import PART_PAGES
from folioscope.sources.tables import one_per_key

#: The order in which a page goes through its states.
STATES = ("pending", "running", "failed", "succeeded")


def latest(states: DataFrame) -> DataFrame:
    """The last state of each page: by time, then by how far it came, then by the text of the row, so that copies agree."""
    step = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.coalesce("status", F.lit(""))), F.lit(0))
    tail = [F.xxhash64(*[c for c in states.columns if c not in ("updated_at",)]).asc()]
    return one_per_key(states, ["book_id", "page_num"], [F.col("updated_at").desc_nulls_last(), step.desc(), *tail])


def listed(pages: DataFrame, book: str | None = None, status: str | None = None, limit: int = 0) -> DataFrame:
    """Pages of a book, of a status, in order; a limit above 0 is a top-k."""
    out = pages
    if book is not None:
        out = out.where(F.col("book_id") == book)
    if status is not None:
        out = out.where(F.col("status") == status)
    out = out.orderBy("book_id", "page_num")
    return out.limit(limit) if limit > 0 else out


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("status").agg(F.count("*").alias("n"))


def totals(pages: DataFrame) -> DataFrame:
    """Pages, warnings, tables, figures and bytes over all; 0 for an empty table."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return pages.agg(F.count("*").alias("pages"), total("warning_count"), total("table_count"), total("figure_count"), total("rendered_bytes"))


def warning_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code").agg(F.count("*").alias("n"))


def errors(pages: DataFrame) -> DataFrame:
    """(error_code, retryable, n): failures by what is known of them; the code, else the message, says whether to try again."""
    m = F.lower(F.coalesce("error_message", F.lit("")))
    permanent = F.col("error_code").isin("structured_page_mismatch", "parse_failed", "image_read") | m.rlike("page mismatch|parse structured|read image|no such file")
    again = F.when(m.rlike("timeout|deadline|cancel|tls|connection|rate limit|temporar"), True).when(permanent, False).otherwise(True)
    return pages.where("status = 'failed'").groupBy(F.coalesce("error_code", F.lit("")).alias("error_code"), again.alias("retryable")).agg(F.count("*").alias("n"))


def rerun(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages set back to pending, wanted pages that don't exist): an equi-join either way."""
    w = wanted.select("book_id", "page_num").distinct()
    reset = pages.join(w, ["book_id", "page_num"], "left_semi").withColumn("status", F.lit("pending"))
    return reset, w.join(pages.select("book_id", "page_num"), ["book_id", "page_num"], "left_anti")


def rerun_parts(reset: DataFrame) -> DataFrame:
    """(book_id, part): the parts of assembled documents that pages which are run again make stale; their books are validated anew."""
    return reset.where(F.col("page_num").isNotNull()).select("book_id", F.floor((F.col("page_num") - 1) / PART_PAGES).cast("long").alias("part")).distinct()
