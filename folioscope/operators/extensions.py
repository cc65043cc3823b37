"""Seams where callers put their own Python functions into a run. Each runs over Arrow batches; none may stop a task.

A function that raises gives an error code in its row, and whether trying again makes sense; a parser may decline by None.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.answers import coerced_page

SEAMS = ("ocr.page", "prompt.render", "response.parse", "validate.page", "validate.book", "figures.segment", "page.classify")


class Registry:
    """Functions by seam: the first binding of a seam wins, an unknown seam or a second id fails at once."""

    def __init__(self) -> None:
        self.bound: dict[str, tuple[str, Callable]] = {}
        self.ids: set[str] = set()

    def bind(self, name: str, seams: dict[str, Callable]) -> None:
        if not name or name in self.ids:
            raise ValueError(f"no id or one that is taken: {name!r}")
        if unknown := [s for s in seams if s not in SEAMS]:
            raise ValueError(f"unknown seam {unknown[0]!r}")
        self.ids.add(name)
        for seam, fn in seams.items():
            self.bound.setdefault(seam, (name, fn))

    def get(self, seam: str) -> Callable | None:
        return self.bound[seam][1] if seam in self.bound else None

    def provenance(self) -> list[tuple[str, str]]:
        return sorted((seam, name) for seam, (name, _) in self.bound.items())


def retryable(error: Exception) -> bool:
    """Whether an error passes by itself: its own word for it, else its kind or text."""
    own = getattr(error, "retryable", None)
    if own is not None:
        return bool(own)
    text = str(error).lower()
    return isinstance(error, (TimeoutError, ConnectionError)) or not any(s in text for s in ("parse", "mismatch", "no such file", "read image"))


def read_pages(pages: DataFrame, reader: Callable[[dict], str], attempts: int = 3, columns: tuple[str, ...] = ("book_id", "page_number", "image_path")) -> DataFrame:
    """Each page with raw_response, status, attempts, error_message: attempts are made within the task, the answer is kept before it is parsed."""

    def one(row: dict) -> tuple[str | None, str, int, str]:
        for n in range(1, attempts + 1):
            try:
                return reader(row), "succeeded", n, ""
            except Exception as e:  # noqa: BLE001
                if n == attempts or not retryable(e):
                    return None, "failed", n, str(e)
        return None, "failed", attempts, ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(r) for r in b.to_dict("records")]
            out = b.copy()
            out["raw_response"], out["status"], out["attempts"], out["error_message"] = zip(*got, strict=True) if got else ([], [], [], [])
            yield out

    p = pages.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema)
    return p.mapInPandas(run, f"{kinds}, raw_response string, status string, attempts int, error_message string")


def sample_page(row: dict) -> str:
    """The built-in reader of dry runs: a deterministic page of the asked number."""
    n = int(row["page_number"])
    blocks = [{"type": "heading", "level": 1, "text": f"Page {n}"}, {"type": "paragraph", "text": f"Text of page {n}."}]
    return json.dumps({"schema_version": "structured-ocr/v1", "book_id": row.get("book_id"), "page_number": n, "page_type": "body", "blocks": blocks})


def parse_with(raw: Column, parser: Callable[[str], dict | None] | None) -> Column:
    """The page as JSON from a bound parser, or from the built-in one where that declines."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for r in b:
                try:
                    page = parser(r) if parser and r is not None else None
                except Exception:  # noqa: BLE001
                    page = None
                page = page if page is not None else coerced_page(r)[0]
                out.append(None if page is None else json.dumps(page, ensure_ascii=False))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(raw)


def prompts(pages: DataFrame, render: Callable[[dict], tuple[str, str]], contract: str, columns: tuple[str, ...]) -> DataFrame:
    """system and user prompt of each page; the host's contract is appended to the user prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [render(r) for r in b.to_dict("records")]
            out = b.copy()
            out["system_prompt"], out["user_prompt"] = [g[0] for g in got], [f"{g[1]}\n\n{contract}".strip() for g in got]
            yield out

    p = pages.select(*columns)
    return p.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema) + ", system_prompt string, user_prompt string")


def page_warnings(pages: DataFrame, validate: Callable[[dict], list[dict]], name: str, page_json: str = "page_json", keys: tuple[str, ...] = ("book_id", "page_number")) -> DataFrame:
    """Warnings of a bound validator beside the built-in ones, tagged with its id; its error is a warning itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                try:
                    found = validate(json.loads(r[page_json])) or []
                except Exception as e:  # noqa: BLE001
                    found = [{"code": "plugin_error", "message": str(e)}]
                rows += [(*[r[k] for k in keys], str(w.get("code", "")), f"[plugin/{name}] {w.get('message', '')}") for w in found]
            yield pd.DataFrame(rows, columns=[*keys, "code", "message"])

    p = pages.select(*keys, page_json)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.select(*keys).schema)
    return p.mapInPandas(run, f"{kinds}, code string, message string")


def classified(pages: DataFrame, classify: Callable[[dict], tuple[str, str]], strategies: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """page_type and strategy of each page; a strategy that isn't known is an error of that page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [classify(r) for r in b.to_dict("records")]
            out = b.copy()
            out["page_type"], out["strategy"] = [g[0] for g in got], [g[1] for g in got]
            out["error_code"] = ["" if g[1] in strategies else "unknown_strategy" for g in got]
            yield out

    p = pages.select(*columns)
    return p.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema) + ", page_type string, strategy string, error_code string")


def book_warnings(pages: DataFrame, validate: Callable[[dict], list[dict]], name: str, assembled_path: str = "") -> DataFrame:
    """(book_id, code, message, retryable): warnings of a bound book validator, which is given the book's page numbers and the path of its assembly.

    Numbers, not texts, are gathered by book. An error of the validator is a warning ``plugin_error`` that says whether to try again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                try:
                    found = [(w, False) for w in validate({"book_id": r["book_id"], "assembled_path": assembled_path, "page_numbers": [int(n) for n in r["page_numbers"]]}) or []]
                except Exception as e:  # noqa: BLE001
                    found = [({"code": "plugin_error", "message": str(e)}, retryable(e))]
                rows += [(r["book_id"], str(w.get("code", "")), f"[plugin/{name}] {w.get('message', '')}", again) for w, again in found]
            yield pd.DataFrame(rows, columns=["book_id", "code", "message", "retryable"])

    books = pages.groupBy("book_id").agg(F.array_sort(F.collect_set("page_number")).alias("page_numbers"))
    return books.mapInPandas(run, "book_id string, code string, message string, retryable boolean")


def bindings(specs: list[str], known: dict[str, Callable]) -> dict[str, Callable]:
    """Functions by seam from ``seam=name`` texts; an unknown seam, an unknown name or a second binding of a seam is an error."""
    out: dict[str, Callable] = {}
    for spec in specs:
        seam, sep, name = (x.strip() for x in spec.partition("="))
        if not sep or seam not in SEAMS or name not in known or seam in out:
            raise ValueError(f"no binding: {spec!r}")
        out[seam] = known[name]
    return out
