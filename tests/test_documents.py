from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.functions.text import page_list, wrap
from folioscope.operators import documents, figures, normalize, profiles, projection, qa, validate
from tests.conftest import rows

DOC = "doc_id long, text string, line string, page int"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "clash", 9) for i, t in enumerate(texts, 1)], DOC)


MD = "before\n<!-- page:001 -->\n\nA\nA\n\nA\n<!-- page:1000 -->\nB\r\n"


def test_pages_lines_and_duplicates(spark):
    d = docs(spark, MD, None, "", "no marker")
    assert rows(documents.split_pages(d), "doc_id", "page", "body") == [(1, 1, "A\nA\n\nA"), (1, 1000, "B\r")]
    assert rows(qa.adjacent_duplicates(d)) == [(1, 1, 2, "A")]
    assert rows(qa.duplicate_lines(d), "doc_id", "line_no") == [(1, 5)]


def test_findings_and_verdict(spark):
    good = "<!-- page:001 -->\nkeep\n<!-- page:002 -->\nx"
    d = docs(spark, good, "<!-- page:002 -->\n- bad [X] [X]\n# h")
    f = qa.report(d, 2, ["[X]", ""], ["keep"], [2])
    codes = sorted((r.doc_id, r.code) for r in f.collect())
    assert codes == [(2, "expected_string_missing"), (2, "known_bad_term"), (2, "list_page_markdown_bullets"), (2, "list_page_markdown_headings"), (2, "page_continuity")]
    assert rows(qa.passed(d, f)) == [(1, True), (2, False)]
    assert rows(qa.known_bad_terms(d, ["[X]"])) == [(2, "[X]", 2, 2)]
    assert qa.report(docs(spark), 2, [], [], []).count() == 0


def test_normalize(spark):
    text = "<!-- page:006 -->\nOne . . . . 3\nTwo words    12\nab....4\n\n\n\n\nEnd \t\n<!-- page:010 -->\nOne . . . . 3"
    r = normalize.documents(docs(spark, text, "plain", None), [6]).orderBy("doc_id").collect()
    assert r[0].markdown == "<!-- page:006 -->\n\nOne ... 3\nTwo words ... 12\nab....4\n\n\nEnd\n\n<!-- page:010 -->\n\nOne . . . . 3\n"
    assert (r[0].changed_lines, r[0].changed_pages, r[1].markdown) == (2, [6], "plain") and len(r) == 2
    again = normalize.documents(spark.createDataFrame([(1, r[0].markdown)], "doc_id long, text string"), [6]).collect()[0]
    assert (again.markdown, again.changed_lines) == (r[0].markdown, 0)
    d = normalize.positional_diff(spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string"), spark.createDataFrame([(1, "a\nB\nc\nd")], "doc_id long, text string"))
    assert rows(d, "line_no", "op") == [(2, "~"), (4, "+")]
    assert normalize.unified(d).collect()[0].diff == "-b\n+B\n+d"


def test_captions_and_neighbours(spark):
    c = spark.createDataFrame([("b", 1, "Figure 1-1: A x\nFigure 1-1:  a X\nprose Figure 2: no"), ("b", 2, "  Figure 1-1: A X "), ("b", 4, None)], "book_id string, page_number int, text string")
    caps = documents.distinct_captions(c, "book_id", "page_number")
    assert rows(caps, "page_number", "caption") == [(1, "Figure 1-1: A x"), (2, "Figure 1-1: A X")]
    assert rows(documents.adjacent_keys(caps, "book_id", "page_number", "norm"), "page_number", "next_page") == [(1, 2)]
    assert rows(documents.neighbours(c, 99), "page_number", "side", "neighbour") == [(1, "next", 2), (2, "next", 4), (2, "previous", 1), (4, "previous", 2)]
    assert documents.neighbours(c, 0).count() == 0


def test_discovery(spark):
    f = spark.createDataFrame([("/a/page_010.png",), ("/a/page_002.png",), ("/a/v2/page_001.png",), ("/a/x.png",), ("/b/page_2.png",)], "path string")
    assert rows(documents.discovered(f, 2, 10), "page") == [(10,), (2,), (2,)]
    assert rows(documents.image_index(f)) == [(1, "/a/v2/page_001.png"), (10, "/a/page_010.png"), (2, "/a/page_002.png")]


def test_assembly_in_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(documents, "PART_PAGES", 2)
    p = spark.createDataFrame([("b", 3, "c"), ("b", 1, "a"), ("b", 2, "b")], "book_id string, page_number int, t string")
    assert rows(documents.assembled(p, "book_id", "page_number", F.col("t"))) == [("b", 0, 2, "a\nb"), ("b", 1, 1, "c")]


def test_anchors_and_page_warnings(spark):
    p = spark.createDataFrame([("one  two", "expected"), ("gone", "expected"), ("Bad", "forbidden"), ("Figure 1: x", "forbidden_caption"), (" ", "expected")], "phrase string, kind string")
    r = validate.anchors(docs(spark, "One\ntwo bad", None), p, "doc_id").orderBy("doc_id").collect()
    assert (r[0].expected_hits, r[0].expected_total, r[0].missing, r[0].forbidden_hits, r[0].bleed) == (1, 3, ["gone"], 1, True)
    assert (r[1].expected_hits, r[1].bleed) == (0, False)
    s = "page_id long, blocks array<struct<id:string,type:string,text:string,items:string,caption:string,table:struct<headers:array<string>,rows:array<array<string>>>>>"
    b = [("f", "figure", None, None, " ", None), ("t", "table", None, None, None, None), ("u", "table", None, None, None, ([], None)), ("c", "code", "", None, None, None), ("l", "list", None, "[ ]", None, None), None, ("k", "list", None, '["a"]', None, None)]
    assert [r.code for r in validate.block_warnings(spark.createDataFrame([(1, b), (2, None)], s)).orderBy("block_no").collect()] == ["figure_missing_caption", "table_missing_payload", "table_empty", "code_empty", "list_empty"]


def test_projection(spark):
    t = lambda d: datetime(2026, 1, d)
    s = "book_id string, page_num int, status string, updated_at timestamp, rendered_bytes int, warning_count int, table_count int, figure_count int, error_code string, error_message string"
    x = [("b", 1, "running", t(2), None, 0, 0, 0, None, None), ("b", 1, "succeeded", t(2), 10, 1, 2, 3, None, None), ("b", 2, "failed", t(3), None, None, None, None, None, "TLS handshake"), ("b", 2, "pending", t(1), None, None, None, None, None, None), ("b", 3, "succeeded", t(1), 500, 0, 0, 0, None, None)]
    latest = projection.latest(spark.createDataFrame(x + x[:2], s))
    assert rows(latest, "page_num", "status") == [(1, "succeeded"), (2, "failed"), (3, "succeeded")]
    assert rows(projection.totals(latest)) == [(3, 1, 2, 3, 510)]
    assert rows(projection.totals(latest.where("false"))) == [(0, 0, 0, 0, 0)]
    assert rows(validate.short_pages(latest, 100), "page_num") == [(1,)] and validate.short_pages(latest, 0).count() == 0
    assert rows(projection.errors(latest)) == [("", True, 1)]
    reset, missing = projection.rerun(latest, spark.createDataFrame([("b", 2), ("b", 9)], "book_id string, page_num int"))
    assert rows(reset, "page_num", "status") == [(2, "pending")] and rows(missing) == [("b", 9)]


def test_type_patch_and_profiles(spark, tmp_path):
    o = spark.createDataFrame([("b", 1, "toc", 1), ("b", 1, "body", 2), ("b", 2, "figure", 1), ("b", 3, None, 1)], "book_id string, page int, inferred string, seq int")
    k = spark.createDataFrame([("b", 1, "body"), ("b", 2, "body")], "book_id string, page int, known string")
    assert rows(profiles.type_patch(o, k)) == [("b", 2, "body", "figure")]
    path = str(tmp_path / "p.yaml")
    profiles.save(path, {"id": "x", "qa": {"expected_pages": 7}, "rendering": {"code_language": "py"}})
    p = profiles.load(path)
    assert profiles.resolved({"context_window": 5}, p) | {} == profiles.DEFAULTS | {"expected_pages": 7, "context_window": 2}
    assert profiles.policy(p).code_language == "py" and profiles.figure_count_patch(3, 2) == {"expected_figure_count": 3}


def test_figures(spark):
    import numpy as np

    page = "Figure 1-1: A drawing.\nBOX ONE -> BOX TWO\nEND NODE"
    d = docs(spark, f"<!-- page:001 -->\n{page}\n<!-- page:002 -->\n[FIGURE: old [x]]\n<!-- page:003 -->\n| a |\n|---|\n{page}")
    m = figures.marked(d)
    assert rows(figures.markers(m), "page", "figure_index", "description", "marker_source") == [(1, 1, "Full-page diagram showing Figure 1-1: A drawing", "synthesized-or-explicit"), (2, 1, "old [x]", "explicit")]
    assert "![old (x)](figures/page_002_figure_01.png)" in [r.body for r in figures.embedded(m).collect()][1]
    a = np.full((100, 100), 255, np.uint8)
    a[30:70, 25:75] = 0
    assert figures.crop(a) == (1, 6, 98, 88)
    assert figures.crop(np.full((50, 50), 255, np.uint8)) == (0, 0, 50, 50)
    assert figures.crop_warnings(100, 100, (0, 0, 100, 100)) == ["crop covers more than 85 percent of page", "crop extends into bottom page-furniture zone"]
    df = spark.createDataFrame([(1, 100, 100, 1, bytearray(a.tobytes()))], "page int, width int, height int, channels int, data binary")
    r = figures.crops(df).collect()[0]
    assert (r.x, r.y, r.width, r.height) == (1, 6, 98, 88) and bytes(r.content)[:4] == b"\x89PNG"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=80), st.integers(1, 20))
def test_wrap_keeps_words_and_width(text, width):
    out = wrap(text, width)
    assert out.split() == text.split()
    assert all(len(s.encode()) <= width or " " not in s for s in out.split("\n"))


def test_page_lists():
    assert page_list("13,12,31-32, 12") == [12, 13, 31, 32]
    assert page_list("", {"p": [1]}, "p") == [1]


def test_list_pages_of_every_number(spark, tmp_path):
    import __spark_entry__ as entry

    text = "".join(f"<!-- page:{n:03d} -->\n\n- one ..... {n}\n\n" for n in (1, 2, 400, 401))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["qa_findings"](spark, str(tmp_path)).where("code = 'list_page_markdown_bullets'")
    assert [r[0] for r in rows(found, "page")] == [1, 2, 400, 401]
    assert entry.queries()["normalized_documents"](spark, str(tmp_path)).collect()[0].changed_pages == [1, 2, 400, 401]
