"""Structured pages to deterministic Markdown."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import wrap
from folioscope.operators.answers import as_int, as_text, coerced_items


@dataclass(frozen=True)
class Policy:
    """How a book is rendered; the defaults are generic, a profile sets its own cues."""

    wrap_width: int = 88
    code_language: str = ""
    text_cues: tuple[str, ...] = ()
    table_cues: tuple[str, ...] = ()
    boxed_sets: bool = False
    diagram_text: bool = False
    footers: bool = False


#: The pattern of the items that a description names.
_boxed = re.compile(r"items?\s+([A-Z0-9_ -]+(?:,\s*[A-Z0-9_ -]+)*(?:,?\s+and\s+[A-Z0-9_ -]+)?)", re.IGNORECASE)


def cued(block: Mapping, cues: tuple[str, ...]) -> bool:
    text = f"{as_text(block.get('caption'))} {as_text(block.get('description'))}".lower()
    return any(c and c.lower() in text for c in cues)


def fence(text: str, language: str) -> str:
    text = text.rstrip("\n")
    return f"```{language}\n{text}\n```\n\n" if text.strip() else ""


def bullets(items: object) -> str:
    """Items as a nested list, two blanks a level, without recursion."""
    out, stack = [], [(x, 0) for x in reversed(coerced_items(items))]
    while stack:
        item, depth = stack.pop()
        out.append(f"{'  ' * depth}- {item['text']}\n")
        stack.extend((c, depth + 1) for c in reversed(item["children"]))
    return "".join(out)


def grid(table: Mapping | None) -> str:
    if not table:
        return ""
    head, rows = list(table.get("headers") or []), [r or [] for r in table.get("rows") or []]
    n = max([len(head), *map(len, rows)])
    if n == 0:
        return ""
    line = lambda cells: "| " + " | ".join([*map(as_text, cells), *[""] * (n - len(cells))]) + " |\n"
    return line(head or [f"Column {i + 1}" for i in range(n)]) + line(["---"] * n) + "".join(map(line, rows))


def figure(block: Mapping, ref: Mapping | None, policy: Policy, hidden: bool) -> str:
    caption, description = as_text(block.get("caption")), as_text(block.get("description"))
    out = f"{caption}\n\n" if caption else ""
    if hidden:
        m = _boxed.search(description) if policy.boxed_sets else None
        if m:
            out += fence("{" + m[1].strip().replace(" and ", ", ").removesuffix(".") + "}", policy.code_language)
    elif ref:
        out += f"![{as_text(ref.get('alt')) or description or caption}]({ref['path']})\n\n"
    elif description:
        out += f"[FIGURE: {description}]\n\n"
    lines = block.get("diagram_text") or []
    if policy.diagram_text and len(lines):
        out += "```text\n" + "".join(f"{s}\n" for s in lines) + "```\n\n"
    return out


def block_markdown(block: Mapping, ref: Mapping | None, policy: Policy, hidden: bool) -> str:
    kind, text = block.get("type"), as_text(block.get("text"))
    match kind:
        case "heading":
            return f"{'#' * max(1, min(6, as_int(block.get('level'))))} {text}\n\n"
        case "paragraph":
            return wrap(text, policy.wrap_width) + "\n\n"
        case "list":
            return bullets(block.get("items")) + "\n"
        case "table":
            return grid(block.get("table")) + "\n"
        case "code":
            return fence(block.get("text") or "", policy.code_language)
        case "figure":
            return figure(block, ref, policy, hidden)
        case "footnote":
            return f"[^{as_text(block.get('id'))}]: {text}\n\n"
        case "page_footer":
            return f"<!-- footer: {text} -->\n\n" if policy.footers and text else ""
        case "blank":
            return "[BLANK PAGE]\n\n"
    return wrap(text, policy.wrap_width) + "\n\n" if text else ""


def page_markdown(page: Mapping, figures: Mapping[str, Mapping] | None = None, policy: Policy = Policy()) -> str:
    """One page; figures are references by block id, each with path and alt."""
    blocks = [b for b in page.get("blocks") or [] if b is not None]
    out = f"<!-- page:{as_int(page.get('page_number')):03d} -->\n\n"
    if page.get("page_type") == "blank" or not blocks:
        return out + "[BLANK PAGE]\n"
    for b, after in zip(blocks, [*blocks[1:], None], strict=True):
        hidden = b.get("type") == "figure" and (cued(b, policy.text_cues) or (after is not None and after.get("type") == "table" and cued(b, policy.table_cues)))
        out += block_markdown(b, (figures or {}).get(as_text(b.get("id"))), policy, hidden)
    return out.rstrip("\n") + "\n"


def markdown(page: Column, policy: Policy = Policy(), figures: Column | None = None) -> Column:
    """Markdown of a page struct (page_number, page_type, blocks with items as JSON text) and, if given, its map of figures by block id."""

    def plain(v: object) -> object:
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, dict):
            return {k: json.loads(x) if k == "items" and isinstance(x, str) and x.strip() else plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else None if isinstance(v, float) and v != v else v

    if figures is None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series([page_markdown(plain(r), None, policy) for r in b.to_dict("records")])

        return F.pandas_udf(run, "string")(page)

    def run_with(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        for b, f in batches:
            yield pd.Series([page_markdown(plain(r), dict(x or {}), policy) for r, x in zip(b.to_dict("records"), f, strict=True)])

    return F.pandas_udf(run_with, "string")(page, figures)
