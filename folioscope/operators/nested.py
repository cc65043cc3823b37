"""Problem 1: nested page records into related flat tables.

Every element below a page gets a path of 0-based array positions (``node``) and the path one level up (``parent``,
``''`` for the page). A bottom-up tree automaton gives each its state: over the typed structs of blocks, table rows and
warnings it is compiled into Catalyst expressions, over list items, which come as JSON text nested to any depth, it runs
in Arrow batches. The state names the variant, and the variant the table that the element is routed to
(``ROUTES``); all tables keep page_id, node and parent, and :func:`elements` is their common supertype.

Defined results: a null or empty array has no rows; a null element is no row but keeps its position; ``items`` that is
null, blank or no JSON has no items; a JSON object or scalar in place of the array counts as its only element; an array
inside an array is an item itself. Null cells of table rows are kept as nulls at their place. Repeated page rows count
once, by page_id (the copy ingested first). Columns beyond those used are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.tree_automaton import BLOCKS, ITEMS, ROUTES, ROWS, WARNINGS
from folioscope.sources.tables import one_per_key

ITEM_ROWS = "array<struct<node:string,parent:string,depth:int,variant:string,text:string>>"
ELEMENTS = "array<struct<variant:string,node:string,parent:string>>"
_token = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*"|[^\s{}\[\],:"]+))')


def deep_json(text: str) -> object:
    """A JSON text that is nested deeper than the parser's recursion goes, read with a stack; ValueError if it is none."""
    root: list = []
    stack: list[tuple[list | dict, str | None]] = [(root, None)]
    at, key, state = 0, None, "value"  # state: what may come next
    while at < len(text):
        m = _token.match(text, at)
        if m is None:
            if text[at:].strip():
                raise ValueError(f"no JSON at {at}")
            break
        at, mark = m.end(), m[1]
        top = stack[-1][0]
        if mark in ("{", "[") or m[2] is not None:
            if state == "key" or state == "first key":
                key = json.loads(m[2]) if m[2] is not None else None
                if not isinstance(key, str):
                    raise ValueError("key is no string")
                state = "colon"
                continue
            if state not in ("value", "first"):
                raise ValueError(f"unexpected value before {at}")
            new: object = {} if mark == "{" else [] if mark == "[" else json.loads(m[2])
            if isinstance(top, dict):
                top[key] = new
            else:
                top.append(new)
            if mark:
                stack.append((new, None))
                state = "first key" if mark == "{" else "first"
            else:
                state = "next"
        elif mark in ("}", "]"):
            if isinstance(top, dict) != (mark == "}") or len(stack) == 1 or state not in ("next", "first", "first key"):
                raise ValueError(f"unexpected {mark} before {at}")
            stack.pop()
            state = "next"
        elif mark == "," and state == "next" and len(stack) > 1:
            state = "key" if isinstance(top, dict) else "value"
        elif mark == ":" and state == "colon":
            state = "value"
        else:
            raise ValueError(f"unexpected {mark} before {at}")
    if len(stack) != 1 or len(root) != 1 or state != "next":
        raise ValueError("JSON ends too soon")
    return root[0]


def walk_items(text: str | None, prefix: str) -> list[dict]:
    """The items of one block's JSON text in reading order."""
    if text is None or not text.strip():
        return []
    try:
        root = json.loads(text)
    except RecursionError:
        try:
            root = deep_json(text)
        except ValueError:
            return []
    except ValueError:
        return []
    if root is None:
        return []
    if not isinstance(root, list):
        root = [root]
    _, states = ITEMS.state(root)
    out: list[dict] = []
    stack = [(root, prefix, 1)]
    while stack:
        nodes, parent, depth = stack.pop()
        for i, x in enumerate(nodes):
            if x is None:
                continue
            node = f"{parent}.i{i}"
            below = x.get("children") if isinstance(x, dict) else x if isinstance(x, list) else None
            text_of = x.get("text") if isinstance(x, dict) else None if isinstance(x, list) else x
            variant = states[id(x)] if isinstance(x, (dict, list)) else ITEMS.leaf(x)
            out.append({"node": node, "parent": parent, "depth": depth, "variant": variant, "text": None if text_of is None else text_of if isinstance(text_of, str) else json.dumps(text_of)})
            if isinstance(below, list) and below:
                stack.append((below, node, depth + 1))
    return out


def _items(texts: Column) -> Column:
    """The items of all blocks of a page, from the array of their JSON texts."""

    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([[] if texts is None else [row for i, t in enumerate(texts) if t is not None for row in walk_items(t, f"b{i}")] for texts in column])

    return F.pandas_udf(walk, ITEM_ROWS)(texts)


def _deduped(pages: DataFrame) -> DataFrame:
    used = [c for c in ("page_id", "book_id", "page_number", "blocks", "warnings", "ingested_at") if c in pages.columns]
    order = [F.col("ingested_at").asc_nulls_last()] if "ingested_at" in used else [F.lit(1)]
    return one_per_key(pages.select(*used), ["page_id"], order)


def _numbered(array, fn):
    """fn(element, position) of each element that is not null."""
    return F.filter(F.transform(array, lambda x, i: F.when(x.isNotNull(), fn(x, i))), lambda x: x.isNotNull())


def row_state(cells: Column) -> Column:
    """The state of a table row from the states of its cells."""
    leaves = F.transform(cells, lambda c: F.when(c.isNull(), ROWS.scalars["null"]).otherwise(ROWS.scalars["string"]))
    return ROWS.column(cells, {"cells": leaves})


def block_state(block: Column) -> Column:
    return BLOCKS.column(block)


def _element(variant, node, parent):
    return F.struct(variant.alias("variant"), node.alias("node"), parent.alias("parent"))


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, kind, node, parent, variant) of every nested element: the supertype of all tables, one narrow pass after the copies are dropped."""
    none = F.array().cast(ELEMENTS)
    pages = _deduped(pages)

    def below(block, i):
        path = F.concat(F.lit("b"), i.cast("string"))
        rows = _numbered(block["table"]["rows"], lambda cells, r: _element(row_state(cells), F.concat(path, F.lit(".r"), r.cast("string")), path))
        warns = _numbered(block["warnings"], lambda w, k: _element(WARNINGS.column(w), F.concat(path, F.lit(".w"), k.cast("string")), path))
        own = F.array(_element(block_state(block), path, F.lit("")))
        return F.when(block.isNull(), none).otherwise(F.concat(own, F.coalesce(rows, none), F.coalesce(warns, none)))

    blocks = F.coalesce(F.flatten(F.transform("blocks", below)), none)
    top = F.coalesce(_numbered(F.col("warnings"), lambda w, k: _element(WARNINGS.column(w), F.concat(F.lit("w"), k.cast("string")), F.lit(""))), none)
    items = F.coalesce(F.transform(_items(F.transform("blocks", lambda b: b["items"])), lambda x: _element(x["variant"], x["node"], x["parent"])), none)
    routes = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    e = pages.select("page_id", F.explode(F.concat(blocks, top, items)).alias("e"))
    return e.select("page_id", routes[F.col("e.variant")].alias("kind"), "e.node", "e.parent", "e.variant")


def found(pages: DataFrame) -> DataFrame:
    """(page_id, kind, node, parent) of every nested element, its kind by the table that its state is routed to."""
    return elements(pages).select("page_id", "kind", "node", "parent")


def blocks_table(pages: DataFrame) -> DataFrame:
    """The supertype table of blocks with the variant that names each one's subtype table."""
    b = _deduped(pages).select("page_id", "book_id", "page_number", F.posexplode("blocks").alias("block_no", "b")).where("b is not null")
    return b.select(
        "page_id", "book_id", "page_number", "block_no", F.concat(F.lit("b"), F.col("block_no").cast("string")).alias("node"), F.lit("").alias("parent"), block_state(F.col("b")).alias("variant"),
        F.col("b.id").alias("block_id"), F.col("b.type").alias("block_type"), F.col("b.text").alias("text"), F.col("b.level").alias("level"), F.col("b.caption").alias("caption"),
        F.col("b.description").alias("description"), F.array_join("b.diagram_text", "\n").alias("diagram_text"), F.array_join("b.table.headers", "|").alias("headers"), F.col("b.confidence").alias("confidence"),
    )


#: The columns of each subtype table beside the links that all keep.
SUBTYPES = {"text_block": ("text",), "heading_block": ("text", "level"), "list_block": (), "table_block": ("caption",), "figure_block": ("caption", "description", "diagram_text"), "bare_block": ("block_type",)}


def subtype(pages: DataFrame, variant: str) -> DataFrame:
    """The table of one variant of blocks: its own columns beside the links."""
    return blocks_table(pages).where(F.col("variant") == variant).select("page_id", "node", "parent", "block_no", "block_id", *SUBTYPES[variant])


def subtype_tables(pages: DataFrame) -> dict[str, DataFrame]:
    """The flat tables: the subtypes of blocks, and the children of lists, tables and warnings."""
    return {v: subtype(pages, v) for v in SUBTYPES} | {"items": items_table(pages), "table_rows": rows_table(pages), "cells": cells_table(pages), "warnings": warnings_table(pages)}


def items_table(pages: DataFrame) -> DataFrame:
    x = _deduped(pages).select("page_id", F.explode(_items(F.transform("blocks", lambda b: b["items"]))).alias("x"))
    return x.select("page_id", "x.node", "x.parent", "x.depth", "x.variant", F.col("x.text").alias("text"))


def _table_rows(pages: DataFrame) -> DataFrame:
    b = _deduped(pages).select("page_id", F.posexplode("blocks").alias("block_no", "b"))
    r = b.select("page_id", "block_no", F.posexplode("b.table.rows").alias("row_no", "cells")).where("cells is not null")
    return r.select("page_id", F.format_string("b%d.r%d", "block_no", "row_no").alias("node"), F.format_string("b%d", "block_no").alias("parent"), "cells")


def rows_table(pages: DataFrame) -> DataFrame:
    """Table rows with the number of their cells; the cells as text for reading only, since null ones don't show in it (see :func:`cells_table`)."""
    return _table_rows(pages).select("page_id", "node", "parent", F.size("cells").cast("long").alias("n_cells"), F.array_join("cells", "|").alias("cells"))


def cells_table(pages: DataFrame) -> DataFrame:
    """(page_id, node, parent, column_no, header, value): every cell of header and body rows at its place, null ones too.

    ``parent`` is the row's node; header cells are those of the row ``bN.h``, whose parent is the block. A body cell has
    the header of its column, null where there is none.
    """
    b = _deduped(pages).select("page_id", F.posexplode("blocks").alias("block_no", "b")).select("page_id", "block_no", F.col("b.table.headers").alias("headers"), F.col("b.table.rows").alias("rows"))
    head = b.select("page_id", F.format_string("b%d.h", "block_no").alias("parent"), F.posexplode("headers").alias("column_no", "value")).select("page_id", "parent", "column_no", F.lit(None).cast("string").alias("header"), "value")
    body = b.select("page_id", "block_no", "headers", F.posexplode("rows").alias("row_no", "cells")).select("page_id", F.format_string("b%d.r%d", "block_no", "row_no").alias("parent"), "headers", F.posexplode("cells").alias("column_no", "value"))
    body = body.select("page_id", "parent", "column_no", F.get("headers", F.col("column_no")).alias("header"), "value")
    cells = head.unionByName(body)
    return cells.select("page_id", F.concat("parent", F.lit(".c"), F.col("column_no").cast("string")).alias("node"), "parent", "column_no", "header", "value")


def warnings_table(pages: DataFrame) -> DataFrame:
    p = _deduped(pages)
    top = p.select("page_id", F.lit(None).cast("int").alias("block_no"), F.posexplode("warnings").alias("w_no", "w"))
    own = p.select("page_id", F.posexplode("blocks").alias("block_no", "b")).select("page_id", "block_no", F.posexplode("b.warnings").alias("w_no", "w"))
    parent = F.when(F.col("block_no").isNull(), "").otherwise(F.format_string("b%d", "block_no"))
    return top.unionByName(own).where("w is not null").select(
        "page_id", F.concat(F.when(parent == "", "").otherwise(F.concat(parent, F.lit("."))), F.lit("w"), F.col("w_no").cast("string")).alias("node"), parent.alias("parent"), F.col("w.code").alias("code"), F.col("w.message").alias("message"), F.col("w.block_id").alias("block_id"),
    )


def variant_counts(pages: DataFrame) -> DataFrame:
    """How many elements fall into each structural variant."""
    return elements(pages).groupBy("kind", "variant").agg(F.count("*").alias("n"))
