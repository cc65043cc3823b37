"""Figures: markers in Markdown, and their crops from page images by bands of ink."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import CAPTION_START, trim_all
from folioscope.operators.documents import page_lines, split_pages

_caption = re.compile(CAPTION_START + r"\s*\S")


def diagram(lines: list[str], caption_at: int) -> bool:
    """Two lines with signs of a diagram and fewer than three of prose, the caption aside."""
    rest = [s.strip() for i, s in enumerate(lines) if i != caption_at and s.strip()]
    prose = sum(len(s.split()) >= 9 and any(c in s for c in ".,;:") for s in rest)

    def cue(s: str) -> bool:
        ascii_letters = [c for c in s if c.isascii() and c.isalpha()]
        return any(x in s for x in ("->", "<-", "---", "- -")) or (len(ascii_letters) >= 4 and 2 * sum(c.isupper() for c in ascii_letters) >= len(ascii_letters))

    return prose < 3 and sum(map(cue, rest)) >= 2


def with_marker(body: str) -> str:
    """The page with a figure marker after its caption, if it is a diagram without marker, image or table."""
    lines = body.split("\n")
    if "[FIGURE:" in body or "![" in body or any(s.strip().startswith("|") and "---" in s for s in lines):
        return body
    at = next((i for i, s in enumerate(lines) if _caption.search(s) and "..." not in s), None)
    if at is None or not diagram(lines, at):
        return body
    marker = f"[FIGURE: Full-page diagram showing {lines[at].strip().removesuffix('.')}]"
    gap = [""] if at + 1 < len(lines) and lines[at + 1].strip() else []
    return "\n".join([*lines[: at + 1], *gap, marker, *lines[at + 1 :]])


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, page, body) of each page, missing markers added."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(with_marker)

    return split_pages(docs, key, text).withColumn("body", F.pandas_udf(run, "string")("body"))


def markers(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, figure_index, line_no, description, marker_source): figure lines numbered within their page."""
    lines = page_lines(pages, key, "pos", "page").withColumn("s", trim_all(F.col("line")))
    found = lines.where(F.col("s").rlike(r"^\[FIGURE:.*\]$")).withColumn("description", F.trim(F.regexp_extract("s", r"^\[FIGURE:(.*)\]$", 1)))
    w = Window.partitionBy(key, "pos").orderBy("line_no")
    source = F.when(F.col("description").startswith("Full-page diagram showing "), "synthesized-or-explicit").otherwise("explicit")
    return found.select(key, "page", F.row_number().over(w).alias("figure_index"), "line_no", "description", source.alias("marker_source"))


def embedded(pages: DataFrame, folder: str = "figures", key: str = "doc_id") -> DataFrame:
    """(key, pos, page, body): markers replaced by image links, numbered within a page."""

    def link(page: int, body: str) -> str:
        out, n = [], 0
        for s in body.split("\n"):
            m = re.fullmatch(r"\[FIGURE:(.*)\]", s.strip())
            if m:
                n += 1
                alt = m[1].strip().replace("[", "(").replace("]", ")")
                s = f"![{alt}]({folder}/page_{page:03d}_figure_{n:02d}.png)"
            out.append(s)
        return "\n".join(out)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, body in batches:
            yield pd.Series([link(int(p), b) for p, b in zip(page, body, strict=True)])

    return pages.withColumn("body", F.pandas_udf(run, "string")("page", "body"))


@dataclass(frozen=True)
class Ink:
    """What counts as ink, where furniture lies and what a band of ink needs; parts stand for one in so many of the page."""

    light: int = 245
    margin: int = 24
    least_ink: int = 200
    left_part: int = 10
    right_part: int = 20
    row_part: int = 250
    row_least: int = 8
    head_part: int = 25
    foot_part: int = 6
    band_part: int = 180
    band_least: int = 12
    crop_left_part: int = 12
    most_share: float = 0.85
    least_share: float = 0.02
    furniture_part: int = 10
    frame: int = 4


def ink_mask(image: np.ndarray, ink: Ink = Ink()) -> np.ndarray:
    """Which pixels of a gray, RGB or RGBA image are dark in any channel and not fully clear."""
    a = image if image.ndim == 3 else image[:, :, None]
    dark = (a[:, :, : min(3, a.shape[2])] < ink.light).any(axis=2)
    return dark & (a[:, :, 3] != 0) if a.shape[2] == 4 else dark


def crop(image: np.ndarray, ink: Ink = Ink()) -> tuple[int, int, int, int]:
    """(x, y, width, height) of the figure: the union of bands of inked rows away from head and foot; the whole page if there is no ink."""
    mask = ink_mask(image, ink)
    h, w = mask.shape
    rows = mask[:, w // ink.left_part : w - w // ink.right_part].sum(axis=1)
    least = max(ink.row_least, w // ink.row_part)
    on = np.concatenate([[False], rows >= least, [False]])
    begins, ends = np.flatnonzero(~on[:-1] & on[1:]), np.flatnonzero(on[:-1] & ~on[1:]) - 1
    if not len(begins):
        return 0, 0, w, h
    total = np.add.reduceat(np.where(on[1:-1], rows, 0), begins)
    body = (ends >= h // ink.head_part) & (begins <= h - h // ink.foot_part) & ((ends - begins + 1 >= max(ink.band_least, h // ink.band_part)) | (total >= ink.least_ink))
    if body.any():
        top, bottom = int(begins[body].min()), int(ends[body].max())
    else:
        best = int(np.argmax(total + (ends - begins) * least))
        top, bottom = int(begins[best]), int(ends[best])
    left = w // ink.crop_left_part
    columns = np.flatnonzero(mask[top : bottom + 1, left : w - w // ink.right_part].any(axis=0))
    if not len(columns):
        return 0, 0, w, h
    x0, x1 = max(0, left + int(columns[0]) - ink.margin), min(w, left + int(columns[-1]) + ink.margin + 1)
    y0, y1 = max(0, top - ink.margin), min(h, bottom + ink.margin + 1)
    return x0, y0, x1 - x0, y1 - y0


def crop_warnings(width: int, height: int, rect: tuple[int, int, int, int], ink: Ink = Ink()) -> list[str]:
    x, y, w, h = rect
    if w <= 0 or h <= 0:
        return ["empty crop"]
    share = w * h / (width * height)
    out = ["crop covers more than 85 percent of page"] if share > ink.most_share else ["crop covers less than 2 percent of page"] if share < ink.least_share else []
    return out + (["crop extends into bottom page-furniture zone"] if y + h > height - height // ink.furniture_part else [])


def png(image: np.ndarray) -> bytes:
    """An 8-bit gray, RGB or RGBA array as PNG."""
    a = image if image.ndim == 3 else image[:, :, None]
    h, w, c = a.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * c).astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def overlay(image: np.ndarray, rect: tuple[int, int, int, int], ink: Ink = Ink()) -> np.ndarray:
    """The page in colour with a red frame along the inside of a crop."""
    a = image if image.ndim == 3 else image[:, :, None]
    out = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3].copy()
    x, y, w, h = rect
    inside = out[max(0, y) : y + h, max(0, x) : x + w]
    frame = np.ones(inside.shape[:2], dtype=bool)
    frame[ink.frame : -ink.frame or None, ink.frame : -ink.frame or None] = False
    inside[frame] = (255, 0, 0)
    return out


def sidecars(cropped: DataFrame) -> DataFrame:
    """(page, value): what is known of each crop, without its pixels, as JSON."""
    return cropped.select("page", F.to_json(F.struct(*[c for c in cropped.columns if c != "content"])).alias("value"))


#: Segmenters by name; others may be added. Each takes an image array and gives a rectangle.
SEGMENTERS: dict[str, Callable[[np.ndarray], tuple[int, int, int, int]]] = {"ink-band": crop}


def crops(images: DataFrame, segmenter: str = "ink-band") -> DataFrame:
    """(page, x, y, width, height, method, warnings, content) from (page, width, height, channels, data) of raw pixels, as Spark's image source gives them."""
    find = SEGMENTERS[segmenter]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                a = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels)
                x, y, w, h = find(a)
                x0, y0, x1, y1 = max(0, x), max(0, y), min(r.width, x + w), min(r.height, y + h)
                if x1 <= x0 or y1 <= y0:
                    x0, y0, x1, y1 = 0, 0, r.width, r.height
                rows.append((r.page, x0, y0, x1 - x0, y1 - y0, segmenter, crop_warnings(r.width, r.height, (x0, y0, x1 - x0, y1 - y0)), png(a[y0:y1, x0:x1])))
            yield pd.DataFrame(rows, columns=["page", "x", "y", "width", "height", "method", "warnings", "content"])

    return images.select("page", "width", "height", "channels", "data").mapInPandas(run, "page int, x int, y int, width int, height int, method string, warnings array<string>, content binary")
