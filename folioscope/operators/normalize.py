"""Normalisation of contents pages, and the line-by-line difference that it makes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import PAGE_MARKER, list_line, rtrim_blank, trim_all
from folioscope.operators.qa import pages_of


def list_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, normalized): the lines that normalisation changes."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return lines.select(key, (F.col("i") + 1).alias("line_no"), "line", list_line(F.col("line")).alias("normalized")).where(F.col("normalized") != rtrim_blank(F.col("line")))


def body(text: Column) -> tuple[Column, Column]:
    """A page body with its lines normalised and at most two blank lines in a row, and how many lines changed."""
    pairs = F.transform(F.split(text, "\n"), lambda s: F.struct(s.alias("old"), list_line(s).alias("new")))
    changed = F.size(F.filter(pairs, lambda p: p["new"] != rtrim_blank(p["old"])))
    joined = F.array_join(F.transform(pairs, lambda p: F.when(trim_all(p["new"]) == "", "").otherwise(p["new"])), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{4,}", "\n\n\n"), r"\A\n+|\n+\z", ""), changed.cast("long")


def documents(docs: DataFrame, list_pages: Sequence[int] | None, key: str = "doc_id", text: str = "text", leading_blank: bool = False) -> DataFrame:
    """(key, markdown, changed_lines, changed_pages) of each document; ``list_pages`` None stands for every page.

    Documents without page markers stay as they are. With ``leading_blank`` a document that begins with a marker gets an
    empty line before it, as the tool does that this one stands in for.
    """
    t = F.col(text)

    def rewritten(p: Column) -> Column:
        fixed, n = body(p["body"])
        hit = F.lit(True) if list_pages is None else F.coalesce(p["page"].isin(list(list_pages)), F.lit(False))
        md = F.concat(F.format_string("<!-- page:%03d -->\n\n", p["page"]), F.when(hit, fixed).otherwise(p["body"]), F.lit("\n\n"))
        return F.struct(p["page"].alias("page"), md.alias("md"), F.when(hit, n).otherwise(F.lit(0).cast("long")).alias("n"))

    p = docs.where(t.isNotNull()).select(key, t.alias("__text"), F.transform(pages_of(t), rewritten).alias("p"))
    before = F.regexp_replace(F.element_at(F.split("__text", PAGE_MARKER), 1), r"\n+\z", "")
    head = F.when(F.lit(leading_blank) | (before != ""), F.concat(before, F.lit("\n"))).otherwise("")
    whole = F.concat(F.regexp_replace(F.concat(head, F.array_join(F.transform("p", lambda x: x["md"]), "")), r"\n+\z", ""), F.lit("\n"))
    changed = F.array_sort(F.array_distinct(F.array_compact(F.transform("p", lambda x: F.when(x["n"] > 0, x["page"])))))
    lines = F.aggregate("p", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return p.select(key, F.when(F.size("p") > 0, whole).otherwise(F.col("__text")).alias("markdown"), lines.alias("changed_lines"), changed.alias("changed_pages"))


def positional_changes(df: DataFrame, old: Column, new: Column, *keys: str) -> DataFrame:
    """(keys, line_no, op, old_line, new_line) of two texts that stand in one row: no shuffle."""
    pairs = F.zip_with(F.split(F.coalesce(old, F.lit("")), "\n"), F.split(F.coalesce(new, F.lit("")), "\n"), lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("o"), F.coalesce(b, F.lit("")).alias("n")))
    x = df.select(*keys, F.posexplode(pairs).alias("i", "p")).where("p.o <> p.n")
    op = F.when(F.col("p.o") == "", "+").when(F.col("p.n") == "", "-").otherwise("~")
    return x.select(*keys, (F.col("i") + 1).alias("line_no"), op.alias("op"), F.col("p.o").alias("old_line"), F.col("p.n").alias("new_line"))


def positional_diff(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, op, old_line, new_line) where line i of one text isn't line i of the other; '+' and '-' where one side has none.

    Whole texts are joined by key, not lines; two texts of one row need no join (:func:`positional_changes`).
    """
    side = lambda df, name: df.where(F.col(text).isNotNull()).select(key, F.col(text).alias(name))
    return positional_changes(side(old, "__old").join(side(new, "__new"), key, "full_outer"), F.col("__old"), F.col("__new"), key)


def unified(diff: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, diff): the differences of a document as text in line order."""
    one = F.when(F.col("op") == "+", F.concat(F.lit("+"), "new_line")).when(F.col("op") == "-", F.concat(F.lit("-"), "old_line")).otherwise(F.concat(F.lit("-"), "old_line", F.lit("\n+"), "new_line"))
    return diff.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", one.alias("s")))), lambda x: x["s"]), "\n").alias("diff"))
