import json
from datetime import datetime

from folioscope.operators import drift
from tests.conftest import rows

SCHEMA = "feed string, file_name string, written_at timestamp, line_no int, payload string, received_at timestamp, field string, types int"


def line(name, day, n, payload, feed="f"):
    return (feed, name, datetime(2026, 1, day), n, payload if payload is None or isinstance(payload, str) else json.dumps(payload), datetime(2026, 2, day), "clash", 1)


def test_changes_between_files(spark):
    a = {"schema_version": "v1", "page_number": 1, "warnings": [], "blocks": [{"id": "x", "text": "t", "level": 1}]}
    b = {"schema": 2, "page_number": None, "cost": 0.1, "blocks": [{"id": "x", "body": "t", "level": "1"}, None, 3]}
    data = [line("a", 1, 1, a), line("b", 2, 1, b), line("b", 2, 2, {"schema": 2, "page_number": 3}), line("b", 2, 2, {"schema": 2, "page_number": 3}), line("b", 2, 3, "{broken"), line("b", 2, 4, None), line("b", 2, 5, "[1]")]
    want = [("added", "cost", ""), ("removed", "warnings", ""), ("renamed", "blocks[].text", "blocks[].body"), ("renamed", "schema_version", "schema"), ("type_changed", "blocks[].level", ""), ("type_changed", "schema", "")]
    assert rows(drift.found(spark.createDataFrame(data, SCHEMA)), "change", "field", "new_field") == sorted(want, key=repr)


def test_unknown_names_pair_by_spelling_and_files_without_records(spark):
    data = [line("a", 1, 1, {"newField": 1, "gone": 1}), line("b", 2, 1, {"new_field": 1}), line("c", 3, 1, "x"), line("d", 4, 1, {"new_field": 1})]
    got = rows(drift.found(spark.createDataFrame(data, SCHEMA)), "file_name", "change", "field", "new_field")
    assert got == [("b", "removed", "gone", ""), ("b", "renamed", "newField", "new_field"), ("c", "removed", "new_field", ""), ("d", "added", "new_field", "")]


def test_ties_and_empty(spark):
    data = [line("b", 1, 1, {"x": 1}), line("a", 1, 1, {"y": 1})]
    assert rows(drift.found(spark.createDataFrame(data, SCHEMA)), "file_name", "change", "field") == [("b", "added", "x"), ("b", "removed", "y")]
    assert drift.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_table_of_all_pages(spark):
    data = [
        line("a", 1, 1, {"schema_version": "v1", "page_number": "004", "warnings": 3, "blocks": [{"id": "i", "text": "t", "level": "2", "diagram_text": {"lines": ["A", "B"]}}]}),
        line("b", 2, 1, {"schema": 2, "pageNumber": 5, "warnings": [{}, {}], "blocks": [{"block_id": "j", "body": "u", "labels": ["C"], "conf": 0.5}]}),
        line("b", 2, 1, {"schema": 2, "pageNumber": 5, "warnings": [{}, {}], "blocks": [{"block_id": "j", "body": "u", "labels": ["C"], "conf": 0.5}]}),
        line("c", 3, 1, {}),
        line("c", 3, 2, "no"),
    ]
    got = {r.file_name: r for r in drift.pages(spark.createDataFrame(data, SCHEMA)).collect()}
    assert (got["a"].page_number, got["a"].n_warnings, got["a"].blocks[0].level, got["a"].blocks[0].diagram_text) == (4, 3, 2, "A\nB")
    assert (got["b"].schema_version, got["b"].page_number, got["b"].n_warnings, got["b"].blocks[0].id, got["b"].blocks[0].text, got["b"].blocks[0].diagram_text) == ("2", 5, 2, "j", "u", "C")
    assert (got["c"].schema_version, got["c"].page_number, got["c"].blocks) == ("structured-ocr/v1", None, None)


def test_fingerprints_repeat_where_shapes_do(spark):
    data = [line("a", 1, 1, {"x": 1}), line("b", 2, 1, {"x": 2}), line("c", 3, 1, {"x": "s"}), line("d", 4, 1, None)]
    got = {r.file_name: r for r in drift.fingerprints(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got["a"].fingerprint == got["b"].fingerprint != got["c"].fingerprint
    assert [got[k].version for k in "abcd"] == [1, 2, 3, 4] and got["d"].n_fields == 0


def test_fields_without_a_rule_and_warnings_are_kept(spark):
    data = [
        line("a", 1, 1, {"page": 1, "cost": 0.5, "retry": False, "warns": [{"code": "c", "message": "m", "block_id": "x", "at": 3}, "plain"], "blocks": [{"id": "x", "bbox": [1, 2], "font": None}, None, 7]}),
        line("a", 1, 2, {"page": 2, "warning_list": 4}),
    ]
    one, two = drift.pages(spark.createDataFrame(data, SCHEMA)).orderBy("line_no").collect()
    assert (one.n_warnings, [tuple(w) for w in one.warnings]) == (2, [("c", "m", "x", {"at": "3"}), (None, "plain", None, None)])
    assert {k: json.loads(x) for k, x in one.other_fields.items()} == {"cost": 0.5, "retry": False}
    assert one.blocks[0].other_fields.keys() == {"bbox", "font"} and json.loads(one.blocks[0].other_fields["bbox"]) == [1, 2]
    assert (two.n_warnings, two.warnings, two.other_fields) == (4, None, {})


def test_renames_by_values_without_a_rule(spark):
    a = [line("a", 1, i, {"engine_kind": f"e{i % 3}", "price": i, "x": "s"}) for i in range(30)]
    b = [line("b", 2, i, {"kindOfEngine": f"e{i % 3}", "retry": i, "y": "s", "x": "s"}) for i in range(30)]
    got = rows(drift.found(spark.createDataFrame(a + b, SCHEMA)), "change", "field", "new_field")
    assert got == [("added", "retry", ""), ("added", "y", ""), ("removed", "price", ""), ("renamed", "engine_kind", "kindOfEngine")]


def test_migration_steps_and_their_chain(spark):
    data = [line("a", 1, 1, {"page": 1, "shelfMark": "q"}), line("b", 2, 1, {"pageNumber": "2", "shelf_mark": "r"}), line("c", 3, 1, {"pageNumber": "3", "ShelfMark": "s", "schema": "v2"})]
    df = spark.createDataFrame(data, SCHEMA)
    steps = rows(drift.migrations(df), "version", "step", "op", "field", "new_field", "argument")
    assert steps == [(2, 1, "rename", "page", "pageNumber", None), (2, 2, "rename", "shelfMark", "shelf_mark", None), (2, 3, "cast", "pageNumber", "", "int"), (3, 1, "rename", "shelf_mark", "ShelfMark", None), (3, 2, "default", "schema", "", "structured-ocr/v1")]
    got = drift.pages(df).orderBy("file_name").collect()
    assert [(r.page_number, r.schema_version, r.other_fields) for r in got] == [(1, "structured-ocr/v1", {"ShelfMark": '"q"'}), (2, "structured-ocr/v1", {"ShelfMark": '"r"'}), (3, "v2", {"ShelfMark": '"s"'})]
    assert drift.pages(df.where("false")).count() == 0 and drift.migrations(df.where("false")).count() == 0


def test_a_valid_copy_counts_before_a_broken_one(spark):
    data = [line("a", 1, 1, "{!"), line("a", 1, 1, {"page": 4}), line("a", 1, 2, None)]
    assert rows(drift.pages(spark.createDataFrame(data, SCHEMA)), "line_no", "page_number") == [(1, 4)]
