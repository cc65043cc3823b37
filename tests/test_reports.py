import json

from pyspark.sql import functions as F

from folioscope.operators import documents, extensions, normalize, qa, reports, trials
from folioscope.sources import sinks
from tests.conftest import rows

TRIALS = "run_id string, seq long, id string, book_id string, target_page int, scenario string, status string, error string, json_parse_ok boolean, suspected_bleed boolean, schema_repaired boolean, forbidden_phrase_hits int, forbidden_caption_hits int, target_only_score double, forbidden int"


def trial(run, n, page, scenario, score, status="succeeded", book="b", phrases=0, captions=0, bleed=False):
    return (run, n, f"t{n}", book, page, scenario, status, None, status == "succeeded", bleed, False, phrases, captions, score, 7)


def test_a_retry_takes_the_place_of_a_failed_attempt(spark):
    data = [trial("a", 1, 12, "s", 0.0, "failed"), trial("b", 1, 12, "s", 1.0), trial("b", 2, 13, "s", 0.5, phrases=2, captions=1, bleed=True), trial("b", 3, 12, "s", None, "failed", book="c")]
    df = spark.createDataFrame(data, TRIALS)
    best = reports.logical(df)
    assert rows(best, "run_id", "book_id", "target_page") == [("b", "b", 12), ("b", "b", 13), ("b", "c", 12)]
    assert rows(reports.totals(best)) == [(3, 2, 2, 1, 3, 0.5)]
    assert rows(reports.by_group(best, "book_id", "target_page"), "book_id", "target_page", "trials", "min_score") == [("b", 12, 1, 1.0), ("b", 13, 1, 0.5), ("c", 12, 1, 0.0)]
    assert [(r.book_id, r.target_page) for r in reports.low(best).collect()] == [("b", 13), ("c", 12)]
    text = [r.line for r in reports.report_markdown(df).collect()]
    assert text[0] == "# Benchmark report" and "- Duplicate logical cells: 1" in text and "- Raw trials: 4" in text and "| `b` | 13 | 1 | 1 | 1 | 1 | 3 | 0.500 | 0.500 |" in text
    assert [x for x in text if x.startswith("| t")] == ["| t2 | `b` | 13 | `s` | succeeded | 3 | true | 0.500 |", "| t3 | `c` | 12 | `s` | failed | 0 | false | 0.000 |"]
    assert rows(reports.totals(reports.logical(df.where("false")))) == [(0, 0, 0, 0, 0, 0.0)]


def test_rescoring_fills_the_target_page(spark):
    oracle = spark.createDataFrame([(3, ["kiln"], ["sextant"], [], [])], "target_page int, expected array<string>, forbidden array<string>, expected_captions array<string>, forbidden_captions array<string>")
    raw = [(1, 3, json.dumps({"transcription": "the kiln"})), (2, 3, "  "), (3, 3, "{"), (4, 3, json.dumps({"target_page": 3, "transcription": "a sextant"})), (5, 3, None)]
    got = rows(reports.rescored(spark.createDataFrame(raw, "n int, target_page int, raw_response string"), oracle), "n", "status", "parsed.target_page", "parsed.schema_repaired", "parsed.strategy", "bleed", "score")
    assert got == [(1, "succeeded", 3, True, "schema-repair", False, 1.0), (2, "failed", None, False, "missing-response", False, 0.0), (3, "parse_failed", None, False, "failed", False, 0.0), (4, "succeeded", 3, False, "strict-json", True, 0.0), (5, "failed", None, False, "missing-response", False, 0.0)]


def test_dry_runs_bleed_in_the_negative_control_only(spark):
    oracle = spark.createDataFrame([(12, ["kiln"], [], ["Figure 1-1: A"], ["Figure 1-2: B"])], "target_page int, expected array<string>, forbidden array<string>, expected_captions array<string>, forbidden_captions array<string>")
    plan = trials.plan(spark, [12, 13], trials.SCENARIOS)
    got = rows(reports.rescored(reports.dry_answers(plan, oracle), oracle).where("target_page = 12"), "scenario", "bleed")
    assert got == sorted([(s, s == "context-first-negative-control") for s in trials.SCENARIOS], key=repr)
    p = {r.scenario: r for r in reports.prompt_texts(plan, ["a", "b", "c"]).where("target_page = 12").collect()}
    assert p["context-first-negative-control"].images == ["previous", "next", "target"] and p["target-only"].images == ["target"] and all("page 012" in r.user_prompt and '"a", "b", and "c"' in r.user_prompt for r in p.values())
    assert reports.quoted_list([]) == "" and reports.quoted_list(["x"]) == '"x"'


PAGE = "<!-- page:001 -->\n\n- one\nsame \n same\n\n<!-- page:002 -->\n\n[FIGURE: x]\nbad bad\n"


def test_findings_and_reports_of_documents(spark):
    df = spark.createDataFrame([(1, PAGE, 1), (2, None, 1), (3, "", 1), (4, "<!-- page:001 -->\nfine good", 1)], "doc_id long, text string, page int")
    got = rows(qa.report(df, 1, ["bad"], ["good"], None), "doc_id", "code", "page", "line")
    assert got == sorted([(1, "page_continuity", None, None), (1, "known_bad_term", None, 10), (1, "expected_string_missing", None, None), (1, "adjacent_duplicate_line", 1, 3), (1, "list_page_markdown_bullets", 1, None), (3, "page_continuity", None, None), (3, "expected_string_missing", None, None)], key=repr)
    assert rows(qa.verdicts(df, 1, ["bad"], ["good"], None)) == [(1, False), (2, True), (3, False), (4, True)]
    assert rows(qa.adjacent_duplicates(df)) == [(1, 1, 3, "same")] and rows(qa.duplicate_lines(df)) == [(1, 5, "same")]
    md = dict(rows(reports.qa_markdown(df, 1, ["bad"], ["good"])))
    assert sorted(md) == [1, 3, 4] and md[4].endswith("PASS for automated checks.") and md[1].endswith("produced findings.")
    assert "- `bad`: 2 hit(s)" in md[1] and "- MISSING: `good`" in md[1] and "- page 001, local line 3: adjacent duplicate non-empty line: same" in md[1] and "- Figure markers: 1" in md[1]
    assert qa.report(df.where("false"), 1, ["bad"], ["good"], None).count() == 0


def test_captions_on_neighbouring_pages_and_failed_pages(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("b", 2, "x"), ("b", 4, "x"), ("c", 2, "x")], "book_id string, page int, norm string")
    assert rows(documents.adjacent_keys(df, "book_id", "page", "norm")) == [("b", 1, "x", 2)]
    s = spark.createDataFrame([("failed", "TLS handshake", None), ("failed", "HTTP 429", None), ("failed", "Page mismatch", None), ("failed", None, None), ("failed", "tls", False), ("succeeded", "tls", None)], "status string, error_message string, hint boolean")
    assert rows(reports.error_classes(s, hint="hint"), "class", "retryable") == [("structured_page_failed", True), ("structured_page_mismatch", False), ("structured_plugin_permanent", False), ("structured_provider_rate_limit", True), ("structured_provider_tls", True)]


def test_differences_of_two_tables_and_of_one_row(spark):
    old, new = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "a\nb"), (2, "x"), (3, None)], [(1, "a\nc\nd"), (4, "y")]))
    want = [(1, 2, "~", "b", "c"), (1, 3, "+", "", "d"), (2, 1, "-", "x", ""), (4, 1, "+", "", "y")]
    assert rows(normalize.positional_diff(old, new)) == want


def test_text_layers(spark):
    df = spark.createDataFrame([(1, "CHAPTER ONE\nThe ri\\er was re-\n stored here\n- . 12\n\n\f\n2.1 Tools\nEnd."), (2, None), (3, "")], "page_id long, text string")
    got = rows(reports.text_layer_blocks(df), "page_id", "type", "level", "text")
    assert got == sorted([(1, "heading", 1, "Chapter One"), (1, "paragraph", None, "The river was restored here"), (1, "heading", 2, "2.1 Tools"), (1, "paragraph", None, "End.")], key=repr)


def test_images_of_markers_and_of_folders(spark):
    m = spark.createDataFrame([("b", 3), ("b", 4)], "book_id string, page int")
    i = spark.createDataFrame([("b", 3, "images/b/scan-0003.png")], "book_id string, page int, path string")
    assert rows(reports.page_images(m, i), "page", "path", "found") == [(3, "images/b/scan-0003.png", True), (4, "images/b/page_004.png", False)]
    files = spark.createDataFrame([("x/p_1.png",), ("y/p_1.png",), ("y/q1.png",), ("y/none.png",)], "path string")
    assert rows(documents.folder_index(files)) == [("x", 1, "x/p_1.png"), ("y", 1, "y/p_1.png")]
    assert [r.page for r in documents.ordered_pages(files).collect()] == [1, 1, 1]
    try:
        documents.ordered_pages(files, 5, 6)
    except ValueError:
        pass
    else:
        raise AssertionError


def test_book_validators_and_bindings(spark):
    df = spark.createDataFrame([("b", 2), ("b", 1), ("c", 9)], "book_id string, page_number int")

    def check(book):
        if book["book_id"] == "c":
            raise TimeoutError("late")
        return [{"code": "pages", "message": str(book["page_numbers"])}]

    got = rows(extensions.book_warnings(df, check, "v"), "book_id", "code", "message", "retryable")
    assert got == [("b", "pages", "[plugin/v] [1, 2]", False), ("c", "plugin_error", "[plugin/v] late", True)]
    assert extensions.bindings(["validate.book = v"], {"v": check}) == {"validate.book": check}
    for wrong in (["validate.book"], ["x=v"], ["ocr.page=w"], ["ocr.page=v", "ocr.page=v"]):
        try:
            extensions.bindings(wrong, {"v": check})
        except ValueError:
            continue
        raise AssertionError(wrong)


def test_files_of_a_benchmark(spark, tmp_path):
    df = spark.createDataFrame([("r", "t1", "succeeded", "answer"), ("r", "t2", "failed", None)], "run_id string, id string, status string, raw_response string")
    sinks.write_trials(df, str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out/summary"))) == [("r", 1, 2)]
    assert rows(spark.read.text(str(tmp_path / "out/responses")), "trial", "value") == [("t1", "answer")]
    sinks.append_turns(df, str(tmp_path / "turns"))
    sinks.append_turns(df, str(tmp_path / "turns"))
    assert spark.read.parquet(str(tmp_path / "turns")).distinct().count() == 2
    assert rows(sinks.printed(df)) == [("id=t1 raw_response=answer run_id=r status=succeeded",), ("id=t2 run_id=r status=failed",)]
    assert rows(reports.draft_profiles(spark.createDataFrame([("b", 2, "p"), ("b", 5, "q")], "book_id string, page int, path string"))) == [("b", 2, 2, 5)]
    assert reports.variants_by_page(spark.createDataFrame([(1, "a", "xy")], "page_num int, kind string, text string"), ["a", "b"]).select(F.col("a"), F.col("b")).first() == (2, 0)


def test_overlays_sidecars_and_stale_parts(spark):
    import numpy as np

    from folioscope.operators import figures, projection

    page = np.full((60, 50), 255, np.uint8)
    framed = figures.overlay(page, (10, 20, 30, 25))
    red = (framed == (255, 0, 0)).all(axis=2)
    assert framed.shape == (60, 50, 3) and red[20:45, 10:40].sum() == red.sum() == 30 * 25 - 22 * 17
    df = spark.createDataFrame([(1, 2, b"x")], "page int, x int, content binary")
    assert rows(figures.sidecars(df)) == [(1, '{"page":1,"x":2}')]
    reset, missing = projection.rerun(spark.createDataFrame([("b", 1, "succeeded"), ("b", 201, "failed")], "book_id string, page_num int, status string"), spark.createDataFrame([("b", 1), ("b", 201), ("b", 7)], "book_id string, page_num int"))
    assert rows(projection.rerun_parts(reset)) == [("b", 0), ("b", 1)] and rows(missing) == [("b", 7)]
