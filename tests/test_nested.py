import json
from datetime import datetime

from folioscope.operators import nested
from folioscope.operators.tree_automaton import BLOCKS, ITEMS
from tests.conftest import rows

WARN = "struct<code:string,message:string,block_id:string>"
BLOCK = f"struct<id:string,type:string,text:string,level:int,items:string,table:struct<headers:array<string>,rows:array<array<string>>>,caption:string,description:string,diagram_text:array<string>,confidence:string,warnings:array<{WARN}>>"
SCHEMA = f"page_id long, book_id string, page_number int, blocks array<{BLOCK}>, warnings array<{WARN}>, ingested_at timestamp, node string, kind int"


def block(**k):
    return tuple(k.get(c) for c in ("id", "type", "text", "level", "items", "table", "caption", "description", "diagram_text", "confidence", "warnings"))


def page(i, blocks, warnings=None, at=1):
    return (i, "b", i, blocks, warnings, datetime(2026, 1, at), "clash", 7)


def test_paths_of_every_kind(spark):
    items = json.dumps(["a", None, {"text": "b", "children": [{"text": "c", "children": [None, "d"]}, 5]}, ["e"]])
    b = [block(text="x", warnings=[None, ("c", "m", None)]), None, block(items=items, type="list"), block(table=(["h"], [["1"], None, []]), type="table")]
    got = rows(nested.found(spark.createDataFrame([page(1, b, [("w", "m", "b")])], SCHEMA)), "kind", "node", "parent")
    want = [("block", "b0", ""), ("block", "b2", ""), ("block", "b3", ""), ("warning", "b0.w1", "b0"), ("warning", "w0", ""), ("table_row", "b3.r0", "b3"), ("table_row", "b3.r2", "b3")]
    want += [("item", f"b2.{n}", f"b2.{p}" if p else "b2") for n, p in (("i0", ""), ("i2", ""), ("i2.i0", "i2"), ("i2.i0.i1", "i2.i0"), ("i2.i1", "i2"), ("i3", ""), ("i3.i0", "i3"))]
    assert got == sorted(want, key=repr)


def test_nulls_repeats_and_empty(spark):
    data = [page(1, None), page(2, []), page(3, [block(items="no json"), block(items=""), block(items="null")]), page(4, [block(text="y")]), page(4, [block(text="y")], at=2), page(5, [None], [None])]
    got = rows(nested.found(spark.createDataFrame(data, SCHEMA)))
    assert got == [(3, "block", f"b{i}", "") for i in range(3)] + [(4, "block", "b0", "")]
    assert nested.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_items_and_json_in_place_of_an_array(spark):
    deep = "x"
    for _ in range(200):
        deep = {"text": "t", "children": [deep]}
    got = nested.walk_items(json.dumps([deep]), "b0")
    assert len(got) == 201 and got[-1]["depth"] == 201
    assert [r["node"] for r in nested.walk_items('{"text": "one"}', "b1")] == ["b1.i0"]


def test_variants_route_to_subtype_tables(spark):
    df = spark.createDataFrame([page(1, [block(text="t"), block(text="h", level=2), block(items='["a"]'), block(table=([], [])), block(description="d"), block(type="blank")])], SCHEMA)
    tables = nested.subtype_tables(df)
    assert {k: tables[k].count() for k in nested.SUBTYPES} == dict.fromkeys(nested.SUBTYPES, 1)
    assert rows(nested.variant_counts(df)) == sorted([("block", v, 1) for v in nested.SUBTYPES] + [("item", "item_text", 1)], key=repr)


def test_states_of_rows_and_warnings(spark):
    b = [block(table=(["h", None], [["1", "2"], [None, "3"], [None], []])), block(text="t", warnings=[("c", None, "x"), (None, None, None)])]
    df = spark.createDataFrame([page(1, b, [("c", None, None)])], SCHEMA)
    assert rows(nested.elements(df), "node", "variant") == sorted([("b0", "table_block"), ("b0.r0", "row_full"), ("b0.r1", "row_gapped"), ("b0.r2", "row_empty"), ("b0.r3", "row_empty"), ("b1", "text_block"), ("b1.w0", "warning_of_block"), ("b1.w1", "warning_bare"), ("w0", "warning_plain")], key=repr)
    cells = [("b0.h", 0, None, "h"), ("b0.h", 1, None, None), ("b0.r0", 0, "h", "1"), ("b0.r0", 1, None, "2"), ("b0.r1", 0, "h", None), ("b0.r1", 1, None, "3"), ("b0.r2", 0, "h", None)]
    assert rows(nested.cells_table(df), "parent", "column_no", "header", "value") == sorted(cells, key=repr)


def test_json_deeper_than_recursion_goes():
    n = 200_000
    text = '[{"text": "t", "children": ' * n + "[]" + "}]" * n
    got = nested.deep_json(text)
    depth = 0
    while got:
        depth, got = depth + 1, got[0]["children"]
    assert depth == n
    for good in ('[1, "a\\"b", null, {"k": [true, -2.5e3]}, [], {}]', ' "x" ', "7"):
        assert nested.deep_json(good) == json.loads(good)
    for bad in ("[", "[1,]", '{"a" 1}', "{1: 2}", "[1 2]", "]", "", '{"a":}', "[}", "{,}", "nul", "1 2"):
        try:
            nested.deep_json(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert len(nested.walk_items("[" * 3000 + '"x"' + "]" * 3000, "b0")) == 3000


def test_automaton_states():
    assert ITEMS.state({"text": "a", "children": [{"text": "b"}]})[0] == "item_branch"
    assert ITEMS.state({"text": "a", "odd": 1})[0] == "item_other"
    assert BLOCKS.object_state({}, {"text", "level"}) == "heading_block"


def test_same_as_a_plain_walk(spark, data):
    pages = spark.read.parquet(f"{data}/ocr_pages.parquet")
    want = set()
    for p in pages.select("page_id", "blocks", "warnings").collect():
        want |= {(p.page_id, "warning", f"w{i}", "") for i, w in enumerate(p.warnings or []) if w}
        for i, b in enumerate(p.blocks or []):
            if b is None:
                continue
            want.add((p.page_id, "block", f"b{i}", ""))
            want |= {(p.page_id, "warning", f"b{i}.w{k}", f"b{i}") for k, w in enumerate(b.warnings or []) if w}
            want |= {(p.page_id, "table_row", f"b{i}.r{k}", f"b{i}") for k, r in enumerate((b.table and b.table.rows) or []) if r is not None}

            def walk(xs, parent):
                for k, x in enumerate(xs):
                    if x is not None:
                        want.add((p.page_id, "item", f"{parent}.i{k}", parent))
                        if isinstance(x, dict):
                            walk(x.get("children") or [], f"{parent}.i{k}")

            walk(json.loads(b["items"]) or [] if b["items"] else [], f"b{i}")
    assert {tuple(r) for r in nested.found(pages).collect()} == want
