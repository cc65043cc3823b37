"""Markdown documents into pages, lines and captions; neighbours of pages; assembly of pages into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import CAPTION_LINE, PAGE_MARKER, last_number, normalize_space

#: Pages in one part of an assembled document, so that no row grows with its book.
PART_PAGES = 200


def split_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, page, body) of each page of a document; what stands before the first marker belongs to none."""
    numbers = F.regexp_extract_all(text, F.lit(PAGE_MARKER), 1)
    bodies = F.slice(F.split(text, PAGE_MARKER), F.lit(2), F.greatest(F.size(numbers), F.lit(0)))
    p = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.arrays_zip(numbers.alias("page"), bodies.alias("body"))).alias("pos", "p"))
    return p.select(key, "pos", F.col("p.page").try_cast("int").alias("page"), F.regexp_replace("p.body", r"\A\n+|\n+\z", "").alias("body"))


def page_lines(pages: DataFrame, *keys: str, text: str = "body") -> DataFrame:
    """(keys, line_no, line), counted from 1 within a page."""
    return pages.select(*keys, F.posexplode(F.split(text, "\n")).alias("i", "line")).select(*keys, (F.col("i") + 1).alias("line_no"), "line")


def captions(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, pos, caption, norm): figure captions of a text in order."""
    found = texts.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(CAPTION_LINE), 1)).alias("pos", "caption"))
    return found.withColumn("norm", normalize_space(F.col("caption")))


def distinct_captions(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The captions of a text that differ in more than case and white space, in their first spelling."""
    c = captions(texts, *keys, text=text)
    return c.groupBy(*keys, "norm").agg(F.min(F.struct("pos", "caption")).alias("f")).select(*keys, "norm", F.col("f.pos").alias("pos"), F.col("f.caption").alias("caption"))


def adjacent_keys(pages: DataFrame, book: str, page: str, key: str) -> DataFrame:
    """(book, page, next_page, key) where a key stands on a page and on the one after it: an equi-join, no window over a book."""
    k = pages.select(book, page, key).distinct()
    after = k.select(book, (F.col(page) - 1).alias(page), key)
    return k.join(after, [book, page, key], "left_semi").withColumn("next_page", F.col(page) + 1)


def neighbours(pages: DataFrame, window: int, book: str = "book_id", page: str = "page_number") -> DataFrame:
    """(book, page, side, neighbour) of the pages within a window of 0 to 2, by equi-join on the shifted number."""
    w = max(0, min(2, window))
    numbers = pages.select(book, page).distinct()
    if w == 0:
        return numbers.where("false").select(book, page, F.lit("").alias("side"), F.col(page).alias("neighbour"))
    steps = [s for s in range(-w, w + 1) if s]
    wanted = numbers.select(book, page, F.explode(F.array(*map(F.lit, steps))).alias("step")).withColumn("neighbour", F.col(page) + F.col("step"))
    there = numbers.select(book, F.col(page).alias("neighbour"))
    return wanted.join(there, [book, "neighbour"]).select(book, page, F.when(F.col("step") < 0, "previous").otherwise("next").alias("side"), "neighbour")


def discovered(files: DataFrame, first: int = 0, last: int = 0, path: str = "path") -> DataFrame:
    """(page, path) of image files by the last number of their names, within a range; 0 leaves an end open."""
    name = F.element_at(F.split(path, "/"), -1)
    p = files.select(last_number(name).alias("page"), F.col(path).alias("path")).where("page IS NOT NULL")
    return p.where((F.lit(first <= 0) | (F.col("page") >= first)) & (F.lit(last <= 0) | (F.col("page") <= last)))


def image_index(files: DataFrame, path: str = "path") -> DataFrame:
    """One path a page number above 0: the first by name."""
    return discovered(files, path=path).where("page > 0").groupBy("page").agg(F.min("path").alias("path"))


def folder_index(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, page, path): the same for the images of many folders, each by itself."""
    p = discovered(files, path=path).where("page > 0").withColumn("folder", F.regexp_replace("path", r"/?[^/]*\z", ""))
    return p.groupBy("folder", "page").agg(F.min("path").alias("path"))


def ordered_pages(files: DataFrame, first: int = 0, last: int = 0, path: str = "path") -> DataFrame:
    """The image files by number and path; none in the range is an error, as it is for the tool that this stands in for."""
    p = discovered(files, first, last, path).orderBy("page", "path")
    if p.isEmpty():
        raise ValueError("no page images in the range")
    return p


def assembled(pages: DataFrame, book: str, page: str, text: Column, separator: str = "\n") -> DataFrame:
    """(book, part, n_pages, markdown): the pages of a book in order, in parts of PART_PAGES that follow one another."""
    part = F.floor((F.col(page) - 1) / PART_PAGES).cast("long")
    p = pages.select(book, F.col(page).alias("__page"), part.alias("part"), text.alias("__text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__page", "__text"))), lambda x: x["__text"])
    return p.groupBy(book, "part").agg(F.count("*").alias("n_pages"), F.array_join(ordered, separator).alias("markdown"))
