import json

import pytest

from folioscope.operators import answers, extensions, render, trials
from tests.conftest import rows

GOOD = {"target_page": 12, "transcription": "Text", "notes": []}


@pytest.mark.parametrize(
    ("raw", "strategy"),
    [
        (json.dumps(GOOD), "strict-json"),
        ("Here:\n```json\n" + json.dumps(GOOD) + "\n```", "strict-json"),
        ('{"target_page": 012, "transcription": "10:05",}', "strict-json-sanitized"),
        ('{"target_page": "012", "content_markers": ["Figure 1: x", "y"], "transcribed_page_identity": "Title", "suspected_context_copy": "not that I see"}', "schema-repair"),
        ('{"page": 3, "ocr": "t",}', "sanitize-and-schema-repair"),
        ("no json", "failed"),
        ("[1]", "failed"),
        ("", "missing-response"),
        (None, "missing-response"),
        ("{" * 3000, "failed"),
    ],
)
def test_strategies(raw, strategy):
    assert answers.parse_answer(raw)["strategy"] == strategy


def test_repair_leaves_strings_alone():
    assert json.loads(answers.lenient('{"a": "x: 05, ]", "b": 007, "c": [1,],}')) == {"a": "x: 05, ]", "b": 7, "c": [1]}
    got = answers.parse_answer('{"target_page": "012", "content_markers": ["Figure 1: x", "y"], "transcribed_page_identity": "Title", "suspected_context_copy": "not that I see"}')
    assert (got["target_page"], got["captions"], got["title_lines"], got["suspected"], got["notes"], got["transcription"]) == (12, ["Figure 1: x"], ["Title"], False, ["not that I see"], "Figure 1: x\ny")


def test_scores(spark):
    df = spark.createDataFrame([(1, 1, json.dumps({"target_page": 1, "transcription": "one\ntwo Bad"})), (2, 1, "one two"), (3, 5, json.dumps({"target_page": 5, "transcription": "page 005"})), (4, 1, None)], "k int, target_page int, raw_response string")
    oracle = spark.createDataFrame([(1, ["one two"], ["bad"], None, None)], "target_page int, expected array<string>, forbidden array<string>, expected_captions array<string>, forbidden_captions array<string>")
    got = rows(answers.scored(answers.parsed(df), oracle), "k", "expected_hits", "forbidden_hits", "bleed", "score")
    assert got == [(1, 1, 1, True, 0.5), (2, 1, 0, False, 0.75), (3, 1, 0, False, 1.0), (4, 0, 0, False, 0.0)]


def page(**k):
    return json.dumps({"schema_version": "structured-ocr/v1", "page_number": "032", "blocks": [], **k})


def test_pages_are_repaired():
    blocks = [{"type": "heading", "text": "Figure 1-1: A Box"}, {"type": "figure", "figure": {"caption": "figure 1-1:  a box", "diagram_text": "A\n\n B "}}, {"type": "figure", "caption": ""}, {"type": "paragraph", "text": "Figure 2: after"}, {"type": "list", "items": ["x", {"text": "y", "children": ["z"]}]}]
    p, code = answers.coerced_page(page(blocks=blocks))
    assert code == "" and p["page_number"] == 32
    assert [b["id"] for b in p["blocks"]] == ["p032-b002", "p032-b003", "p032-b004", "p032-b005"]
    assert p["blocks"][0]["diagram_text"] == ["A", "B"] and p["blocks"][1]["caption"] == "Figure 2: after"
    assert p["blocks"][3]["items"] == [{"text": "x", "children": []}, {"text": "y", "children": [{"text": "z", "children": []}]}]
    assert [answers.coerced_page(r)[1] for r in ("{}", "", "nothing", '{"schema_version": "v"}', page(page_number=0))] == ["missing_schema_version", "empty_response", "parse_failed", "missing_page_number", "missing_page_number"]


def test_mismatch_is_an_error(spark):
    df = spark.createDataFrame([(32, page()), (31, page()), (1, None)], "page_number int, raw_response string")
    assert rows(answers.structured_pages(df), "page_number", "error_code") == [(1, "empty_response"), (31, "structured_page_mismatch"), (32, "")]


RENDERED = [
    ({"page_type": "blank"}, {}, "[BLANK PAGE]\n"),
    ({"blocks": [{"type": "heading", "level": 0, "text": " A "}, {"type": "heading", "level": 9, "text": "B"}]}, {}, "# A\n\n###### B\n"),
    ({"blocks": [{"type": "paragraph", "text": "one two  three"}, {"type": "odd", "text": "x"}]}, {"wrap_width": 8}, "one two\nthree\n\nx\n"),
    ({"blocks": [{"type": "list", "items": ["a", {"text": "b", "children": [{"text": "c", "children": ["d"]}]}]}]}, {}, "- a\n- b\n  - c\n    - d\n"),
    ({"blocks": [{"type": "table", "table": {"headers": None, "rows": [["1"], ["2", " 3 "]]}}]}, {}, "| Column 1 | Column 2 |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |\n"),
    ({"blocks": [{"type": "code", "text": "  x\n\n"}, {"type": "code", "text": " "}]}, {"code_language": "lisp"}, "```lisp\n  x\n```\n"),
    ({"blocks": [{"type": "figure", "caption": "C", "description": "D", "diagram_text": ["a"]}]}, {"diagram_text": True}, "C\n\n[FIGURE: D]\n\n```text\na\n```\n"),
    ({"blocks": [{"type": "figure", "caption": "C", "description": "Code listing of items A, B and C."}]}, {"text_cues": ("code listing",), "boxed_sets": True}, "C\n\n```\n{A, B, C}\n```\n"),
    ({"blocks": [{"type": "figure", "description": "a grid"}, {"type": "table", "table": {"headers": ["h"], "rows": []}}]}, {"table_cues": ("grid",)}, "| h |\n| --- |\n"),
    ({"blocks": [{"type": "figure", "description": "a grid"}, {"type": "paragraph", "text": "p"}]}, {"table_cues": ("grid",)}, "[FIGURE: a grid]\n\np\n"),
    ({"blocks": [{"type": "footnote", "id": "n", "text": "t"}, {"type": "page_footer", "text": "f"}, {"type": "blank"}]}, {}, "[^n]: t\n\n[BLANK PAGE]\n"),
    ({"blocks": [{"type": "page_footer", "text": "f"}]}, {"footers": True}, "<!-- footer: f -->\n"),
]


@pytest.mark.parametrize(("body", "policy", "want"), RENDERED)
def test_rendering(body, policy, want):
    assert render.page_markdown({"page_number": 7, **body}, None, render.Policy(**policy)) == "<!-- page:007 -->\n\n" + want


def test_figure_references():
    p = {"page_number": 1, "blocks": [{"id": "x", "type": "figure", "description": "D"}, {"id": "y", "type": "figure", "description": "E"}]}
    assert render.page_markdown(p, {"x": {"path": "f.png", "alt": ""}}) == "<!-- page:001 -->\n\n![D](f.png)\n\n[FIGURE: E]\n"


def test_trials(spark):
    s = "run_id string, id string, target_page int, scenario string, status string, error string, seq long, started_at timestamp"
    t = [("r1", "t1", 1, "a", "failed", "x", 1, None), ("r2", "t1", 1, "a", "succeeded", None, 1, None), ("r2", "t1", 1, "a", "succeeded", None, 1, None), ("r1", "t2", 2, "a", "succeeded", None, 2, None), ("r2", "t2", 2, "a", "succeeded", None, 2, None)]
    m = [("r2", "t1", True, False, 1.0, 0, 0, False), ("r1", "t2", True, False, 0.5, 0, 0, False), ("r2", "t2", True, False, 0.5, 1, 1, True)]
    ms = "run_id string, trial_id string, json_parse_ok boolean, suspected_bleed boolean, target_only_score double, forbidden_phrase_hits int, forbidden_caption_hits int, schema_repaired boolean"
    x = trials.with_metrics(spark.createDataFrame(t, s), spark.createDataFrame(m, ms))
    assert x.count() == 4
    best = trials.logical(x, ["target_page", "scenario"], ["run_id", "seq"], trials.rank())
    assert rows(best, "target_page", "run_id") == [(1, "r2"), (2, "r1")]
    assert rows(trials.replacements(x, ["target_page", "scenario"], ["run_id", "seq"], trials.rank())) == [(1, "a", 2, 1, 1), (2, "a", 2, 1, 0)]
    assert rows(trials.notable(x), "run_id", "id") == [("r1", "t1"), ("r1", "t2"), ("r2", "t2")]
    r = trials.grouped_report(x, "scenario").collect()[0]
    assert (r.trials, r.succeeded, r.parse_ok, r.forbidden_hits, r.avg_score, r.min_score) == (4, 3, 3, 1, 0.5, 0.0)
    assert trials.run_summary(x).count() == 4
    assert rows(trials.plan(spark, [1, 2], ["a", "b"], 3)) == [("trial-0001", 1, "a"), ("trial-0002", 1, "b"), ("trial-0003", 2, "a")]
    with pytest.raises(ValueError, match="unknown"):
        trials.scenarios(["nope"])
    assert trials.scenarios([]) == ["target-only"]


def test_extensions(spark):
    reg = extensions.Registry()
    reg.bind("a", {"ocr.page": extensions.sample_page})
    reg.bind("b", {"ocr.page": len, "validate.page": len})
    assert reg.provenance() == [("ocr.page", "a"), ("validate.page", "b")]
    for bad in ("a", ""):
        with pytest.raises(ValueError):
            reg.bind(bad, {})
    with pytest.raises(ValueError):
        reg.bind("c", {"nope": len})
    pages = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "book_id string, page_number int, image_path string")

    def fails_once():
        seen = set()

        def read(row):
            n = row["page_number"]
            if n == 2:
                raise ValueError("read image: no such file")
            if n not in seen:
                seen.add(n)
                raise TimeoutError("busy")
            return extensions.sample_page(row)

        return read

    got = rows(extensions.read_pages(pages, fails_once()), "page_number", "status", "attempts")
    assert got == [(1, "succeeded", 2), (2, "failed", 1)]
    parsed = extensions.read_pages(pages, extensions.sample_page).withColumn("page_json", extensions.parse_with("raw_response", lambda r: None))
    w = extensions.page_warnings(parsed, lambda p: [{"code": "c", "message": "m"}] if p["page_number"] == 1 else 1 / 0, "v")
    assert rows(w, "page_number", "code", "message") == [(1, "c", "[plugin/v] m"), (2, "plugin_error", "[plugin/v] division by zero")]
    c = extensions.classified(pages, lambda r: ("body", "fast" if r["page_number"] == 1 else "odd"), ("fast",), ("page_number",))
    assert rows(c, "page_number", "error_code") == [(1, ""), (2, "unknown_strategy")]
    p = extensions.prompts(pages, lambda r: ("s", f"u{r['page_number']}"), "contract", ("page_number",))
    assert rows(p, "user_prompt") == [("u1\n\ncontract",), ("u2\n\ncontract",)]
