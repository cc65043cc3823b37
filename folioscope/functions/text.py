"""Column functions on text that the document operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the document format. The flag d makes the line feed the only line end.
PAGE_MARKER = r"(?md)^<!-- page:(\d+) -->\s*$"
CAPTION_LINE = r"(?imd)^[ \t]*(Figure\s+\d+(?:[-.]\d+)?\s*:[ \t]*.+?)[ \t]*$"
CAPTION_START = r"(?i)^\s*Figure\s+\d+(?:[-.]\d+)?\s*:"
BULLET_LINE = r"^[ \t\n\f\r]*[-*][ \t\n\f\r]+"
HEADING_LINE = r"^[ \t\n\f\r]*#{1,6}[ \t\n\f\r]+"
LEADER_LINE = r"(?d)^(\S.*?)(?:\s*\.\s*){3,}\s*(\d{1,3})\s*$"
SPACED_PAGE_LINE = r"(?d)^(\S.*?\S)\s{2,}(\d{1,3})\s*$"


def normalize_space(c: Column) -> Column:
    """Lower case, runs of white space (of any script) as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def rtrim_blank(c: Column) -> Column:
    """Without spaces and tabs at the end."""
    return F.regexp_replace(c, r"[ \t]+\z", "")


def trim_all(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def list_line(line: Column) -> Column:
    """A line of a contents page with its leader dots or gap written as ``label ... page``; other lines lose blanks at the end."""
    s = rtrim_blank(line)

    def rewritten(pattern: str) -> Column:
        label = collapse(F.regexp_extract(s, pattern, 1))
        return F.when(F.octet_length(label) < 3, s).otherwise(F.concat(label, F.lit(" ... "), F.regexp_extract(s, pattern, 2)))

    return F.when(trim_all(s) == "", "").when(s.rlike(LEADER_LINE), rewritten(LEADER_LINE)).when(s.rlike(SPACED_PAGE_LINE), rewritten(SPACED_PAGE_LINE)).otherwise(s)


def count_of(text: Column, term: str) -> Column:
    """How often a term occurs without overlaps, case and all."""
    return F.when(F.lit(term == ""), 0).otherwise(((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / max(1, len(term))).cast("long"))


def last_number(name: Column) -> Column:
    """The last run of digits of a file name as an int, null without digits."""
    return F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), F.lit(-1)).try_cast("int")


def wrap(text: str | None, width: int) -> str:
    """Words on lines of at most ``width`` bytes; a longer word has a line of its own; no width gives one line."""
    lines: list[str] = []
    size = 0
    for word in (text or "").split():
        n = len(word.encode())
        if lines and (width <= 0 or size + 1 + n <= width):
            lines[-1] += " " + word
            size += 1 + n
        else:
            lines.append(word)
            size = n
    return "\n".join(lines)


def page_list(text: str, presets: dict[str, list[int]] | None = None, preset: str = "") -> list[int]:
    """Page numbers of ``13,12,31-32``, sorted and distinct; an empty text takes the preset of that name."""
    if not text.strip():
        known = presets or {}
        if preset not in known:
            raise ValueError(f"unknown preset {preset!r} and no pages given")
        return list(known[preset])
    pages: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m or (m[2] and int(m[2]) < int(m[1])):
            raise ValueError(f"no page or range: {part!r}")
        pages.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(pages)
