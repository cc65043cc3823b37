"""Model answers to structured values: extraction of JSON from prose, repair, coercion of types, and scoring of trials.

Everything row-wise that SQL can't say is here as plain functions, run over Arrow batches; an answer is parsed once and
all its columns come from that.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import CAPTION_START

#: The names under which answers give a field, the first that is there counts.
ALIASES = {
    "target_page": ("target_page", "page_number", "page"), "transcription": ("transcription", "text", "ocr", "ocr_text", "markdown", "content"), "identity": ("transcribed_page_identity", "page_identity", "identity"),
    "visible": ("page_number_visible", "visible_page_number"), "title_lines": ("title_or_caption_lines", "title_lines", "caption_lines"), "markers": ("content_markers", "markers"),
    "captions": ("figure_captions", "captions"), "headings": ("section_headings", "headings"), "phrases": ("unique_phrases", "phrases"),
}
_figure = re.compile(CAPTION_START)


def unfenced(raw: str | None) -> str:
    s = (raw or "").strip()
    s = re.sub(r"^```(?:json|JSON)?", "", s)
    return re.sub(r"```$", "", s).strip()


def first_object(text: str) -> str:
    """The first object with balanced braces, outside of strings; the trimmed text if there is none."""
    start = text.find("{")
    depth, at = 0, start
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)
    while start >= 0 and (m := token.search(text, at)):
        at = m.end()
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return text[start:at].strip()
    return text.strip()


#: The pattern of a number with leading zeros after a key.
_leading_zeros = re.compile(r"(:\s*)0+(\d)")


def lenient(text: str) -> str:
    """The default repair stage: trailing commas and numbers with leading zeros, outside of strings."""
    parts = re.split(r'("(?:[^"\\]|\\.)*")', text)
    parts[::2] = [_leading_zeros.sub(r"\1\2", re.sub(r",(\s*[}\]])", r"\1", p)) for p in parts[::2]]
    return "".join(parts)


def as_text(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v).strip() if not isinstance(v, (dict, list)) else json.dumps(v)


def as_texts(v: object) -> list[str]:
    return [s for s in map(as_text, v if isinstance(v, list) else [v]) if s]


def as_int(v: object) -> int:
    if isinstance(v, bool) or v is None:
        return 0
    if isinstance(v, (int, float)):
        return int(v)
    m = re.fullmatch(r"\s*([+-]?\d+)\s*", v) if isinstance(v, str) else None
    return int(m[1]) if m else 0


def as_bool(v: object) -> bool | None:
    if isinstance(v, bool):
        return v
    s = v.strip().lower() if isinstance(v, str) else ""
    return True if s in ("true", "yes", "1") else False if s in ("false", "no", "0") else None


def pick(record: dict, name: str) -> object:
    return next((record[k] for k in ALIASES[name] if k in record), None)


def _strict(text: str) -> dict | None:
    """An answer whose fields have the types that they should have."""
    try:
        r = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(r, dict):
        return None
    texts = lambda d, k: isinstance(d.get(k, []), (list, type(None))) and all(isinstance(x, str) for x in d.get(k) or [])
    marks, ident = r.get("content_markers") or {}, r.get("transcribed_page_identity") or {}
    typed = isinstance(marks, dict) and isinstance(ident, dict) and isinstance(r.get("target_page", 0), int) and not isinstance(r.get("target_page"), bool) and isinstance(r.get("transcription", ""), str) and isinstance(r.get("suspected_context_copy", False), bool) and texts(r, "notes")
    if not typed or not all(texts(marks, k) for k in ("figure_captions", "section_headings", "unique_phrases")) or not texts(ident, "title_or_caption_lines") or not isinstance(ident.get("page_number_visible", ""), str):
        return None
    return {
        "target_page": r.get("target_page", 0), "transcription": r.get("transcription", ""), "visible": ident.get("page_number_visible", ""), "title_lines": ident.get("title_or_caption_lines") or [],
        "captions": marks.get("figure_captions") or [], "headings": marks.get("section_headings") or [], "phrases": marks.get("unique_phrases") or [], "suspected": r.get("suspected_context_copy", False), "notes": r.get("notes") or [],
    }


def _flexible(text: str) -> dict | None:
    """An answer with any of the known field names, its values coerced."""
    try:
        r = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(r, dict):
        return None
    ident, marks = pick(r, "identity"), pick(r, "markers")
    out = {"target_page": as_int(pick(r, "target_page")), "transcription": as_text(pick(r, "transcription")), "suspected": False, "notes": []}
    out["visible"] = (as_text(pick(ident, "visible")) if isinstance(ident, dict) else "") or as_text(pick(r, "visible"))
    out["title_lines"] = as_texts(pick(ident, "title_lines")) if isinstance(ident, dict) else as_texts(ident) if isinstance(ident, str) else []
    if isinstance(marks, dict):
        own = {k: as_texts(pick(marks, k)) for k in ("captions", "headings", "phrases")}
    else:
        phrases = as_texts(marks)
        own = {"captions": [p for p in phrases if _figure.search(p)], "headings": [], "phrases": phrases}
    out |= {k: own[k] or as_texts(pick(r, k)) for k in own}
    flag = as_bool(r.get("suspected_context_copy"))
    if flag is not None:
        out["suspected"] = flag
    elif note := as_text(r.get("suspected_context_copy")):
        out["notes"].append(note)
    out["notes"] += as_texts(r.get("notes"))
    out["transcription"] = out["transcription"] or "\n".join(out["phrases"])
    return out


def has_content(p: dict | None) -> bool:
    return bool(p and (p["transcription"].strip() or p["captions"] or p["headings"] or p["phrases"] or p["title_lines"]))


def parse_answer(raw: str | None, sanitize: Callable[[str], str | None] | None = lenient) -> dict:
    """Fields and the strategy that gave them: strict JSON, repaired JSON, coerced fields, or failed.

    sanitize is the repair stage; it returns text or None. A blank answer is a missing response.
    """
    if raw is None or not raw.strip():
        return {"strategy": "missing-response", "sanitized": False, "ok": False}
    text = first_object(unfenced(raw))
    whole = lambda p: p if p and p["target_page"] > 0 and has_content(p) else None
    if p := whole(_strict(text)):
        return p | {"strategy": "strict-json", "sanitized": False, "ok": True}
    mended = sanitize(text) if sanitize else None
    changed = mended is not None and mended != text
    if changed and (p := whole(_strict(mended))):
        return p | {"strategy": "strict-json-sanitized", "sanitized": True, "ok": True}
    p = _flexible(mended if mended is not None else text)
    if has_content(p):
        return p | {"strategy": "sanitize-and-schema-repair" if changed else "schema-repair", "sanitized": changed, "ok": True}
    return {"strategy": "failed", "sanitized": changed, "ok": False}


PARSED = "struct<ok:boolean,strategy:string,sanitized:boolean,schema_repaired:boolean,target_page:int,transcription:string,visible:string,title_lines:array<string>,captions:array<string>,headings:array<string>,phrases:array<string>,suspected:boolean,notes:array<string>>"


def parsed(df: DataFrame, raw: str = "raw_response", into: str = "parsed", sanitize: Callable[[str], str | None] | None = lenient) -> DataFrame:
    """The table with the parsed answer as a struct; text scored is transcription, captions, headings, phrases and title lines."""
    fields = ("target_page", "transcription", "visible", "title_lines", "captions", "headings", "phrases", "suspected", "notes")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            rows = [parse_answer(r, sanitize) for r in column]
            out = pd.DataFrame({"ok": [r["ok"] for r in rows], "strategy": [r["strategy"] for r in rows], "sanitized": [r["sanitized"] for r in rows], "schema_repaired": ["schema-repair" in r["strategy"] for r in rows]})
            for f in fields:
                out[f] = pd.Series([r.get(f) for r in rows], dtype="Int32" if f == "target_page" else "boolean" if f == "suspected" else object)
            yield out

    return df.withColumn(into, F.pandas_udf(run, PARSED)(F.col(raw)))


def scored(parsed_trials: DataFrame, oracle: DataFrame, page: str = "target_page", parsed_col: str = "parsed", raw: str = "raw_response") -> DataFrame:
    """Trials with their metrics against the oracle of their page.

    oracle is a fixed table (page, expected, forbidden, expected_captions, forbidden_captions) of arrays, one row a page,
    at most as many as a book has; a page without one expects ``page NNN``. Forbidden captions count among the forbidden
    hits and by themselves. The score is hits over what was expected, less a half for each forbidden hit and a quarter
    for an answer that can't be parsed, and never below 0.
    """
    from folioscope.functions.text import normalize_space

    none = F.array().cast("array<string>")
    o = oracle.select(F.col(page), *[F.coalesce(c, none).alias(c) for c in ("expected", "forbidden", "expected_captions", "forbidden_captions")], F.lit(True).alias("__known"))
    t = parsed_trials.join(o, page, "left")
    p = F.col(parsed_col)
    text = normalize_space(F.when(p["ok"], F.array_join(F.concat(F.array(p["transcription"]), p["captions"], p["headings"], p["phrases"], p["title_lines"]), "\n")).otherwise(F.coalesce(F.col(raw), F.lit(""))))
    t = t.withColumn("__text", text)
    want = F.when(F.col("__known"), F.concat("expected", "expected_captions")).otherwise(F.array(F.format_string("page %03d", F.col(page))))
    bad = F.coalesce(F.concat("forbidden", "forbidden_captions"), none)
    hits = lambda phrases: F.size(F.filter(phrases, lambda x: (normalize_space(x) != "") & F.contains(F.col("__text"), normalize_space(x)))).cast("long")
    t = t.withColumn("expected_hits", hits(want)).withColumn("expected_total", F.size(want).cast("long")).withColumn("forbidden_hits", hits(bad)).withColumn("caption_hits", hits(F.coalesce("forbidden_captions", none)))
    t = t.withColumn("bleed", F.coalesce(p["suspected"], F.lit(False)) | (F.col("forbidden_hits") > 0))
    score = F.col("expected_hits") / F.greatest(F.lit(1), F.col("expected_total")) - 0.5 * F.col("forbidden_hits") - F.when(p["ok"], 0.0).otherwise(0.25)
    return t.withColumn("score", F.greatest(F.lit(0.0), score)).drop("__text", "__known", "expected", "forbidden", "expected_captions", "forbidden_captions")


# Structured pages ------------------------------------------------------------------------------------------------------


def coerced_page(raw: str | None, sanitize: Callable[[str], str | None] | None = lenient) -> tuple[dict | None, str]:
    """(page, error code) of an answer that should be a structured page; the page is repaired, the code ``''`` if it is good."""
    if raw is None or not raw.strip():
        return None, "empty_response"
    text = first_object(unfenced(raw))
    record = None
    for candidate in (text, sanitize(text) if sanitize else None):
        try:
            record = json.loads(candidate) if candidate is not None else None
        except (ValueError, RecursionError):
            continue
        if isinstance(record, dict):
            break
    if not isinstance(record, dict):
        return None, "parse_failed"
    if not as_text(record.get("schema_version")):
        return None, "missing_schema_version"
    number = as_int(record.get("page_number"))
    if number <= 0:
        return None, "missing_page_number"
    page = {k: v for k, v in record.items() if k != "blocks"} | {"page_number": number}
    page["blocks"] = repaired_blocks([coerced_block(b) for b in record.get("blocks") or [] if isinstance(b, dict)], number)
    return page, ""


def coerced_block(b: dict) -> dict:
    out = {k: b.get(k) for k in ("id", "type", "text", "level", "caption", "description", "confidence", "warnings", "table")}
    inner = b.get("figure") if isinstance(b.get("figure"), dict) else {}
    for k in ("caption", "description"):
        out[k] = out[k] if as_text(out[k]) else inner.get(k)
    lines = b["diagram_text"] if b.get("diagram_text") is not None else inner.get("diagram_text")
    lines = lines.split("\n") if isinstance(lines, str) else lines if isinstance(lines, list) else [] if lines is None else [lines]
    out["diagram_text"] = [s for s in map(as_text, lines) if s]
    out["items"] = coerced_items(b.get("items"))
    return out


def coerced_items(items: object) -> list[dict]:
    """List items as {text, children} at any depth; bare strings have no children."""
    root: list[dict] = []
    todo = [(items, root)]
    while todo:
        source, into = todo.pop()
        for x in source if isinstance(source, list) else []:
            if x is None:
                continue
            node = {"text": as_text(x.get("text")) if isinstance(x, dict) else as_text(x), "children": []}
            into.append(node)
            if isinstance(x, dict) and x.get("children"):
                todo.append((x["children"], node["children"]))
    return root


def repaired_blocks(blocks: list[dict], page_number: int) -> list[dict]:
    """Missing ids by place, captions of figures from the block before or after, and no heading that repeats the next figure's caption."""
    norm = lambda s: " ".join(as_text(s).lower().split())
    for i, b in enumerate(blocks):
        b["id"] = as_text(b["id"]) or f"p{page_number:03d}-b{i + 1:03d}"
        if b["type"] == "figure" and not as_text(b["caption"]):
            near = [as_text(blocks[j]["text"]) for j in (i - 1, i + 1) if 0 <= j < len(blocks)]
            b["caption"] = next((s for s in near if _figure.search(s)), b["caption"])
    twice = lambda i, b: b["type"] == "heading" and _figure.search(as_text(b["text"])) and i + 1 < len(blocks) and blocks[i + 1]["type"] == "figure" and norm(blocks[i + 1]["caption"]) == norm(b["text"])
    return [b for i, b in enumerate(blocks) if not twice(i, b)]


def structured_pages(df: DataFrame, raw: str = "raw_response", sanitize: Callable[[str], str | None] | None = lenient) -> DataFrame:
    """The table with page_json, the repaired page as JSON, and error_code; with an input page_number another one is a mismatch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            got = [coerced_page(r, sanitize) for r in column]
            yield pd.DataFrame({"page_json": [None if p is None else json.dumps(p, ensure_ascii=False) for p, _ in got], "number": pd.Series([None if p is None else p["page_number"] for p, _ in got], dtype="Int32"), "error_code": [e for _, e in got]})

    out = df.withColumn("__p", F.pandas_udf(run, "struct<page_json:string,number:int,error_code:string>")(F.col(raw)))
    code = F.col("__p.error_code")
    if "page_number" in df.columns:
        code = F.when((code == "") & (F.col("__p.number") != F.col("page_number")), "structured_page_mismatch").otherwise(code)
    return out.withColumn("page_json", F.col("__p.page_json")).withColumn("error_code", code).drop("__p")
