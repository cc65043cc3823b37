"""Quality checks of Markdown documents. Findings share (key, severity, code, page, line, message)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import BULLET_LINE, HEADING_LINE, PAGE_MARKER, count_of, trim_all
from folioscope.operators.documents import split_pages

#: Cues of a diagram in a line.
DIAGRAM_CUES = ("->", "<-", "---", "- -")


def doubled_lines(lines: Column) -> Column:
    """(line_no, line) of the lines equal to the one before but for white space at the ends, blank ones aside; one pass over the array."""
    own = F.transform(lines, lambda s: trim_all(s))
    pairs = F.zip_with(own, F.concat(F.array(F.lit(None).cast("string")), own), lambda s, before: F.struct(s.alias("line"), before.alias("before")))
    numbered = F.transform(pairs, lambda x, i: F.struct((i + 1).alias("line_no"), x["line"].alias("line"), x["before"].alias("before")))
    return F.filter(numbered, lambda x: (x["line"] != "") & (x["line"] == x["before"]))


def pages_of(text: Column) -> Column:
    """The pages of a text as an array of (page, body), in the order of its markers; within the row, without a shuffle."""
    numbers = F.regexp_extract_all(text, F.lit(PAGE_MARKER), 1)
    bodies = F.slice(F.split(text, PAGE_MARKER), F.lit(2), F.greatest(F.size(numbers), F.lit(0)))
    return F.transform(F.arrays_zip(numbers.alias("page"), bodies.alias("body")), lambda p: F.struct(p["page"].try_cast("int").alias("page"), F.regexp_replace(p["body"], r"\A\n+|\n+\z", "").alias("body")))


def adjacent_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page, line_no, line): lines equal to the one before but for white space at the ends; a blank line parts them."""
    p = split_pages(docs, key, text).select(key, "page", F.explode(doubled_lines(F.split("body", "\n"))).alias("x"))
    return p.select(key, "page", "x.line_no", "x.line")


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As above over whole texts, for texts without page markers."""
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(doubled_lines(F.split(text, "\n"))).alias("x")).select(key, "x.line_no", "x.line")


def line_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """Lines, bullets, headings, table lines, fences, blanks and figure markers of each text, beside other columns that are asked for."""
    lines = F.split(text, "\n")
    count = lambda test: F.size(F.filter(lines, test)).cast("long")
    return docs.where(F.col(text).isNotNull()).select(
        key, *also, F.size(lines).cast("long").alias("n_lines"), count(lambda s: s.rlike(BULLET_LINE)).alias("bullets"), count(lambda s: s.rlike(HEADING_LINE)).alias("headings"), count(lambda s: s.startswith("|")).alias("table_lines"),
        count(lambda s: s.startswith("```")).alias("fences"), count(lambda s: F.trim(s) == "").alias("blanks"), count(lambda s: s.startswith("[FIGURE:")).alias("figures"), F.octet_length(text).cast("long").alias("n_bytes"),
    )


def known_bad_terms(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, hits, line): each listed term that occurs, and the line of its first place. Terms are a short literal list."""
    if not terms:
        return docs.where("false").select(key, F.lit("").alias("term"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("line"))
    each = F.array(*[F.struct(F.lit(t).alias("term"), count_of(F.col(text), t).alias("hits"), F.instr(text, F.lit(t)).alias("at")) for t in terms])
    hit = docs.where(F.col(text).isNotNull()).select(key, text, F.explode(F.filter(each, lambda x: x["hits"] > 0)).alias("x"))
    before = F.substring(F.col(text), F.lit(1), F.col("x.at") - 1)
    return hit.select(key, "x.term", "x.hits", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line"))


def missing_strings(docs: DataFrame, expected: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, expected): listed strings that a text lacks."""
    each = F.array(*map(F.lit, expected)) if expected else F.array().cast("array<string>")
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.filter(each, lambda s: ~F.contains(F.col(text), s))).alias("expected"))


def continuity(docs: DataFrame, expected_pages: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, observed, continuous): the page numbers of a document as they stand, against 1 to N; 0 stands for 30, less than 0 asks for none."""
    n = expected_pages or 30
    observed = F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARKER), 1), lambda s: s.try_cast("int"))
    out = docs.where(F.col(text).isNotNull()).select(key, observed.alias("observed"))
    return out.withColumn("continuous", F.lit(True) if n < 0 else F.col("observed") == F.sequence(F.lit(1), F.lit(n)))


def book_continuity(pages: DataFrame, book: str = "book_id", page: str = "page_number") -> DataFrame:
    """(book, n_pages, first_page, last_page, missing, continuous) by partial aggregates: no book is collected."""
    d = pages.select(book, page).distinct()
    a = d.groupBy(book).agg(F.count("*").alias("n_pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))
    return a.withColumn("missing", F.col("last_page").cast("long") - F.col("n_pages")).withColumn("continuous", (F.col("first_page") == 1) & (F.col("missing") == 0))


def list_style(docs: DataFrame, list_pages: Sequence[int] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bullet and heading lines of the pages that list contents (None: of every page), with the first three of each."""
    lines = F.split("body", "\n")
    bullets, heads = F.filter(lines, lambda s: s.rlike(BULLET_LINE)), F.filter(lines, lambda s: s.rlike(HEADING_LINE))
    first = lambda a: F.transform(F.slice(a, 1, 3), lambda s: trim_all(s))
    p = split_pages(docs, key, text).where(F.lit(True) if list_pages is None else F.col("page").isin(list(list_pages)))
    return p.select(key, "page", F.size(bullets).cast("long").alias("bullets"), F.size(heads).cast("long").alias("headings"), first(bullets).alias("bullet_samples"), first(heads).alias("heading_samples"))


def diagram_cues(pages: DataFrame, *keys: str, text: str = "body") -> DataFrame:
    """Per page: lines with diagram cues, prose lines, and whether it looks like a diagram; the caption line doesn't count."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: trim_all(s)), lambda s: (s != "") & ~s.rlike(r"(?i)^\s*Figure\s+\d+(?:[-.]\d+)?\s*:"))
    letters = lambda s: F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    upper = lambda s: F.length(F.regexp_replace(s, "[^A-Z]", ""))

    def cue(s):
        test = (letters(s) >= 4) & (upper(s) * 2 >= letters(s))
        for c in DIAGRAM_CUES:
            test = test | F.contains(s, F.lit(c))
        return test

    prose = F.size(F.filter(lines, lambda s: (F.size(F.split(s, r"\s+")) >= 9) & s.rlike("[.,;:]"))).cast("long")
    cues = F.size(F.filter(lines, cue)).cast("long")
    return pages.select(*keys, cues.alias("cue_lines"), prose.alias("prose_lines"), ((cues >= 2) & (prose < 3)).alias("diagram"))


def findings_of(t: Column, expected_pages: int, bad: Sequence[str], expected: Sequence[str], list_pages: Sequence[int] | None) -> Column:
    """The findings of one text as an array."""
    pages = pages_of(t)
    lines = lambda p: F.split(p["body"], "\n")
    count = lambda p, pattern: F.size(F.filter(lines(p), lambda s: s.rlike(pattern)))
    null = F.lit(None).cast("int")
    one = lambda severity, code, page, line, message: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), page.cast("int").alias("page"), line.cast("int").alias("line"), message.alias("message"))
    none = F.array().cast("array<struct<severity:string,code:string,page:int,line:int,message:string>>")
    n = expected_pages or 30
    observed = F.transform(pages, lambda p: p["page"])
    found = [F.array_compact(F.array(F.when(observed != F.sequence(F.lit(1), F.lit(n)), one("error", "page_continuity", null, null, F.format_string(f"observed pages %s do not match expected 1..{n}", F.array_join(observed, " "))))))] if n > 0 else []
    for term in (b for b in bad if b):
        before = F.substring(t, F.lit(1), F.instr(t, F.lit(term)) - 1)
        at = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        found.append(F.array_compact(F.array(F.when(count_of(t, term) > 0, one("error", "known_bad_term", null, at, F.format_string('known bad term "%s" found %d time(s)', F.lit(term), count_of(t, term)))))))
    found += [F.array_compact(F.array(F.when(~F.contains(t, F.lit(e)), one("error", "expected_string_missing", null, null, F.lit(f'expected string "{e}" is missing'))))) for e in expected]
    found.append(F.flatten(F.transform(pages, lambda p: F.transform(doubled_lines(lines(p)), lambda x: one("error", "adjacent_duplicate_line", p["page"], x["line_no"], F.concat(F.lit("adjacent duplicate non-empty line: "), x["line"]))))))
    listed = pages if list_pages is None else F.filter(pages, lambda p: p["page"].isin(list(list_pages)))
    style = lambda p, what, pattern: F.when(count(p, pattern) > 0, one("warning", f"list_page_markdown_{what}s", p["page"], null, F.format_string(f"list page has %d markdown {what} line(s)", count(p, pattern))))
    found.append(F.flatten(F.transform(listed, lambda p: F.array_compact(F.array(style(p, "bullet", BULLET_LINE), style(p, "heading", HEADING_LINE))))))
    return F.concat(*[F.coalesce(x, none) for x in found])


def report(docs: DataFrame, expected_pages: int, bad: Sequence[str], expected: Sequence[str], list_pages: Sequence[int] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All findings of the documents, in one narrow pass; ``list_pages`` None stands for every page."""
    return docs.where(F.col(text).isNotNull()).select(key, F.inline(findings_of(F.col(text), expected_pages, bad, expected, list_pages)))


def verdicts(docs: DataFrame, expected_pages: int, bad: Sequence[str], expected: Sequence[str], list_pages: Sequence[int] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, passed): whether a document has no finding, in the same pass; null texts have none."""
    return docs.select(key, F.coalesce(F.size(findings_of(F.col(text), expected_pages, bad, expected, list_pages)) == 0, F.lit(True)).alias("passed"))


def passed(docs: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, passed): whether a document has no error or warning."""
    bad = findings.where("severity IN ('error', 'warning')").select(key).distinct().withColumn("bad", F.lit(True))
    return docs.select(key).join(bad, key, "left").select(key, F.col("bad").isNull().alias("passed"))
