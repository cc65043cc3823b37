"""The queries of the core by name, and the SQL that DuckDB runs for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import drift, logparse, nested
from folioscope.plans import reference
from folioscope.sources.tables import table

QUERIES = {
    "p1_found": lambda spark, d: nested.found(table(spark, d, "ocr_pages")),
    "p1_blocks": lambda spark, d: nested.blocks_table(table(spark, d, "ocr_pages")).withColumn("level", F.col("level").cast("string")),
    "p1_items": lambda spark, d: nested.items_table(table(spark, d, "ocr_pages")),
    "p1_table_rows": lambda spark, d: nested.rows_table(table(spark, d, "ocr_pages")),
    "p1_warnings": lambda spark, d: nested.warnings_table(table(spark, d, "ocr_pages")),
    "p1_cells": lambda spark, d: nested.cells_table(table(spark, d, "ocr_pages")),
    **{f"p1_{v}s": (lambda spark, d, v=v: nested.subtype(table(spark, d, "ocr_pages"), v)) for v in nested.SUBTYPES},
    "p1_elements": lambda spark, d: nested.elements(table(spark, d, "ocr_pages")),
    "p1_variants": lambda spark, d: nested.variant_counts(table(spark, d, "ocr_pages")),
    "p3_found": lambda spark, d: drift.found(table(spark, d, "page_files")),
    "p3_fingerprints": lambda spark, d: drift.fingerprints(table(spark, d, "page_files")),
    "p3_migrations": lambda spark, d: drift.migrations(table(spark, d, "page_files")),
    "p3_pages": lambda spark, d: drift.pages(table(spark, d, "page_files")),
    "p6_found": lambda spark, d: logparse.found(table(spark, d, "log_events")),
    "p6_entries": lambda spark, d: logparse.found(table(spark, d, "log_events"), message=True),
    "p6_messages": lambda spark, d: logparse.messages(table(spark, d, "log_events")),
    "p6_unparsed": lambda spark, d: logparse.unparsed(table(spark, d, "log_events")),
    **reference.QUERIES,
}
ORACLES: dict[str, str] = {**reference.ORACLES}
