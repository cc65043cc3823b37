"""Validation of structured pages and books, and of texts against phrases that must or mustn't be in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import normalize_space
from folioscope.sources.tables import one_per_key

WARNING = "struct<code:string,value:string,message:string>"


def block_warnings(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, block_no, code, value): figures without caption, tables without payload or cells, code without text, lists without items.

    ``items`` may be JSON text or null; a blank text and an empty array are no items.
    """
    b = pages.select(key, F.posexplode("blocks").alias("block_no", "b")).where("b IS NOT NULL")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    kind = F.col("b.type")
    t = F.col("b.table")
    code = (
        F.when((kind == "figure") & blank(F.col("b.caption")), "figure_missing_caption")
        .when((kind == "table") & t.isNull(), "table_missing_payload")
        .when((kind == "table") & (F.coalesce(F.size(t["headers"]), F.lit(0)) <= 0) & (F.coalesce(F.size(t["rows"]), F.lit(0)) <= 0), "table_empty")
        .when((kind == "code") & blank(F.col("b.text")), "code_empty")
        .when((kind == "list") & (blank(F.col("b.items")) | (F.regexp_replace("b.items", r"\s", "") == "[]")), "list_empty")
    )
    return b.select(key, "block_no", code.alias("code"), F.coalesce("b.id", F.lit("")).alias("value")).where("code IS NOT NULL")


def block_counts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, n_blocks, tables, figures) of each page."""
    n = lambda kind: F.size(F.filter(F.coalesce("blocks", F.array().cast(pages.schema["blocks"].dataType)), lambda b: b["type"] == kind)).cast("long")
    return pages.select(key, F.size(F.filter(F.coalesce("blocks", F.array().cast(pages.schema["blocks"].dataType)), lambda b: b.isNotNull())).cast("long").alias("n_blocks"), n("table").alias("tables"), n("figure").alias("figures"))


def anchors(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, expected_hits, expected_total, missing, forbidden_hits, caption_hits, bleed).

    phrases is a small table (phrase, kind) with kind expected, forbidden or forbidden_caption; it is read once to the
    driver and becomes an array literal, so texts meet it without a join. Blank phrases count as never found.
    """
    rows = [(r.phrase, r.kind) for r in phrases.select("phrase", "kind").distinct().orderBy("kind", "phrase").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 phrases: join them by key instead")
    hits = {}
    t = normalize_space(F.coalesce(F.col(text), F.lit("")))
    for kind in ("expected", "forbidden", "forbidden_caption"):
        own = [p for p, k in rows if k == kind and p and p.strip()]
        a = F.array(*map(F.lit, own)) if own else F.array().cast("array<string>")
        hits[kind] = (F.filter(a, lambda p: F.contains(F.col("__t"), normalize_space(p))), len([p for p, k in rows if k == kind]), a)
    df = texts.withColumn("__t", t)
    count = lambda kind: F.size(hits[kind][0]).cast("long")
    return df.select(
        key, count("expected").alias("expected_hits"), F.lit(hits["expected"][1]).cast("long").alias("expected_total"), F.array_except(hits["expected"][2], hits["expected"][0]).alias("missing"),
        count("forbidden").alias("forbidden_hits"), count("forbidden_caption").alias("caption_hits"), ((count("forbidden") > 0) | (count("forbidden_caption") > 0)).alias("bleed"),
    )


def short_pages(states: DataFrame, least: int) -> DataFrame:
    """(book_id, page_num, rendered_bytes) of succeeded pages with some bytes but fewer than wanted; none if least isn't positive."""
    return states.where((F.lit(least) > 0) & (F.col("status") == "succeeded") & (F.col("rendered_bytes") > 0) & (F.col("rendered_bytes") < least)).select("book_id", "page_num", "rendered_bytes")


def book_report(pages: DataFrame, states: DataFrame, adjacent: DataFrame, expected: DataFrame, least: int) -> DataFrame:
    """(book_id, n_pages, expected_pages, complete, adjacent_captions, short_pages, warning_count) of each book.

    adjacent has a row (book_id, ...) for each caption on two pages in a row; expected has (book_id, expected_pages).
    """
    n = pages.select("book_id", "page_number").distinct().groupBy("book_id").agg(F.count("*").alias("n_pages"))
    a = adjacent.groupBy("book_id").agg(F.count("*").alias("adjacent_captions"))
    s = short_pages(states, least).groupBy("book_id").agg(F.count("*").alias("short_pages"))
    x = n.join(expected, "book_id", "left").join(a, "book_id", "left").join(s, "book_id", "left").na.fill(0, ["adjacent_captions", "short_pages"])
    x = x.withColumn("complete", F.coalesce(F.col("n_pages") == F.col("expected_pages"), F.lit(False)))
    return x.withColumn("warning_count", F.col("adjacent_captions") + F.col("short_pages"))


def first_spelling(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The first row of each value that differs in more than case and white space."""
    return one_per_key(df.withColumn("norm", normalize_space(F.col(value))), [group, "norm"], [F.col(order).asc()])


def window_first(df: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
