"""Queries of the document operators over the project's tables, each with the SQL that DuckDB runs for it.

Queries whose result SQL can't express (parsing and repair of answers, rendering, whole-document rewriting) have no SQL;
their tests are in tests/.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.text import LEADER_LINE, SPACED_PAGE_LINE, last_number, list_line, normalize_space
from folioscope.operators import answers, documents, figures, logs, nested, normalize, profiles, projection, qa, render, reports, trials, validate
from folioscope.operators.drift import CASTS, DEFAULTS, RENAMES
from folioscope.sources.tables import one_per_key, table

TERMS = ["waggon", "[PAD]", "almanack", "five spaces"]
EXPECTED = ["page", "the ", "lines"]
PHRASES = [("the winter term", "expected"), ("of 400", "expected"), ("Page 1", "expected"), ("sextant", "forbidden"), ("figure 4-1: ", "forbidden_caption")]
#: Only for list_page_style, whose SQL asks for these pages; the other queries take every page.
LIST_PAGES = list(range(1, 400, 2))

# Views that several queries share -------------------------------------------------------------------------------------


def _pages(spark, d):
    return one_per_key(table(spark, d, "ocr_pages"), ["page_id"], [F.col("ingested_at").asc_nulls_last()])


def _trials(spark, d):
    return trials.with_metrics(table(spark, d, "benchmark_trials"), table(spark, d, "trial_metrics"))


def _captions(spark, d):
    p = _pages(spark, d).select("book_id", "page_number", F.posexplode("blocks").alias("block_no", "b"))
    return p.where("trim(b.caption) <> ''").select("book_id", "page_number", "block_no", F.col("b.caption").alias("caption"), normalize_space(F.col("b.caption")).alias("norm"))


def _markdown(spark, d):
    text = F.array_join(F.filter(F.transform(F.coalesce("blocks", F.array().cast(table(spark, d, "ocr_pages").schema["blocks"].dataType)), lambda b: b["text"]), lambda t: t.isNotNull()), "\n\n")
    return documents.assembled(_pages(spark, d), "book_id", "page_number", F.concat(F.format_string("<!-- page:%03d -->\n\n", "page_number"), text))


KINDS = ("page_markdown", "page_text", "qa_report")


def _page_text(spark, d):
    none = F.array().cast(table(spark, d, "ocr_pages").schema["blocks"].dataType)
    return F.array_join(F.filter(F.transform(F.coalesce("blocks", none), lambda b: b["text"]), lambda t: t.isNotNull()), "\n\n")


def _images(spark, d):
    """(book_id, page, path) of the page images that the projection knows."""
    paths = table(spark, d, "structured_pages").where("image_path IS NOT NULL").select("book_id", F.col("image_path").alias("path")).distinct()
    return paths.select("book_id", last_number(F.element_at(F.split("path", "/"), -1)).alias("page"), "path").where("page IS NOT NULL")


def _figure_lines(spark, d):
    """Figure markers of the documents that name their book, with their page."""
    docs = table(spark, d, "documents").where("book_id IS NOT NULL").select("doc_id", "book_id", "text")
    lines = documents.page_lines(documents.split_pages(docs).join(docs.select("doc_id", "book_id"), "doc_id"), "doc_id", "book_id", "page")
    return lines.where("line LIKE '[FIGURE:%'").select("doc_id", "book_id", "page", "line_no")


def _answers(spark, d):
    return one_per_key(table(spark, d, "prompt_pairs"), ["pair_id"], [F.col("received_at").asc_nulls_last()]).select("pair_id", F.col("page_number").alias("target_page"), "raw_response")


def _oracle(spark):
    """What pages must and must not say: of pages that the tables have and of those of the presets."""
    rows = [(1, ["the"], ["sextant"], [], ["Figure 1-1: "]), (2, ["page"], [], [], []), *((p, [f"page {p:03d}"], [], [f"Figure {p}-1: Plate"], [f"Figure {p + 1}-1: Next plate"]) for p in trials.PRESETS["figure-adjacent"])]
    return spark.createDataFrame(rows, "target_page int, expected array<string>, forbidden array<string>, expected_captions array<string>, forbidden_captions array<string>")


def _phrases(spark):
    return spark.createDataFrame(PHRASES, "phrase string, kind string")


def _normalized():
    return F.array_join(F.transform(F.split("text", "\n"), lambda line: list_line(line)), "\n")


def _known_types(spark, d):
    """The page types that the projection's counts say."""
    known = F.when(F.col("figure_count") > 0, "figure").when(F.col("table_count") > 0, "table").otherwise("body")
    return projection.latest(table(spark, d, "structured_pages")).select("book_id", F.col("page_num").alias("page"), known.alias("known"))


QUERIES = {
    "adjacent_duplicate_lines": lambda s, d: qa.duplicate_lines(table(s, d, "documents")),
    "page_duplicate_lines": lambda s, d: qa.adjacent_duplicates(table(s, d, "documents")),
    "document_pages": lambda s, d: documents.split_pages(table(s, d, "documents")).select("doc_id", "pos", "page", F.octet_length("body").cast("long").alias("n_bytes")),
    "line_stats": lambda s, d: qa.line_stats(table(s, d, "documents")),
    "variant_comparison": lambda s, d: qa.line_stats(table(s, d, "documents"), also=["kind"]).groupBy("kind").agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in ("n_bytes", "headings", "figures", "table_lines", "fences", "blanks")]),
    "known_bad_terms": lambda s, d: qa.known_bad_terms(table(s, d, "documents"), TERMS),
    "missing_strings": lambda s, d: qa.missing_strings(table(s, d, "documents"), EXPECTED),
    "document_continuity": lambda s, d: qa.continuity(table(s, d, "documents"), 1).select("doc_id", F.size("observed").cast("long").alias("n_markers"), "continuous"),
    "book_continuity": lambda s, d: qa.book_continuity(table(s, d, "ocr_pages")),
    "list_page_style": lambda s, d: qa.list_style(table(s, d, "documents"), LIST_PAGES).select("doc_id", "page", "bullets", "headings", F.array_join("heading_samples", "|").alias("samples")),
    "diagram_pages": lambda s, d: qa.diagram_cues(documents.split_pages(table(s, d, "documents")), "doc_id", "pos"),
    "qa_findings": lambda s, d: qa.report(table(s, d, "documents"), -1, TERMS, EXPECTED, None),
    "qa_passed": lambda s, d: qa.verdicts(table(s, d, "documents"), -1, TERMS, EXPECTED, None),
    "normalize_list_lines": lambda s, d: normalize.list_lines(table(s, d, "documents")),
    "normalized_documents": lambda s, d: normalize.documents(table(s, d, "documents"), None),
    "positional_diff": lambda s, d: normalize.positional_changes(table(s, d, "documents").where("text IS NOT NULL"), F.col("text"), _normalized(), "doc_id"),
    "captions_distinct": lambda s, d: _captions(s, d).groupBy("book_id", "norm").agg(F.min(F.struct("page_number", "block_no", "caption")).alias("f"), F.count("*").alias("n")).select("book_id", "norm", F.col("f.caption").alias("caption"), "n"),
    "adjacent_captions": lambda s, d: documents.adjacent_keys(_captions(s, d), "book_id", "page_number", "norm"),
    "anchor_hits": lambda s, d: validate.anchors(table(s, d, "documents").select("doc_id", "text"), _phrases(s), "doc_id").drop("missing"),
    "block_warnings": lambda s, d: validate.block_warnings(_pages(s, d)),
    "block_counts": lambda s, d: validate.block_counts(_pages(s, d)),
    "warning_codes": lambda s, d: projection.warning_counts(_pages(s, d).select(F.explode(F.concat(F.coalesce("warnings", F.array().cast("array<struct<code:string,message:string,block_id:string>>")), F.coalesce(F.flatten(F.transform("blocks", lambda b: F.coalesce(b["warnings"], F.array().cast("array<struct<code:string,message:string,block_id:string>>")))), F.array().cast("array<struct<code:string,message:string,block_id:string>>")))).alias("w")).where("w IS NOT NULL").select("w.code")),
    "context_neighbours": lambda s, d: documents.neighbours(table(s, d, "ocr_pages"), 2),
    "discovered_pages": lambda s, d: documents.discovered(table(s, d, "structured_pages").select(F.col("image_path").alias("path")).distinct(), 2, 10),
    "image_index": lambda s, d: documents.folder_index(table(s, d, "structured_pages").select(F.col("image_path").alias("path"))),
    "assembled_markdown": lambda s, d: _markdown(s, d).select("book_id", "part", "n_pages", F.md5("markdown").alias("md5")),
    "rendered_pages": lambda s, d: _pages(s, d).where("page_number IS NOT NULL").select("page_id", render.markdown(F.struct("page_number", "page_type", "blocks")).alias("markdown")),
    "figure_markers": lambda s, d: figures.markers(figures.marked(table(s, d, "documents"))),
    "embedded_figures": lambda s, d: figures.embedded(figures.marked(table(s, d, "documents"))),
    "parsed_answers": lambda s, d: answers.parsed(one_per_key(table(s, d, "prompt_pairs"), ["pair_id"], [F.col("received_at").asc_nulls_last()]).select("pair_id", "raw_response")).select("pair_id", "parsed.*"),
    "answer_pages": lambda s, d: answers.structured_pages(one_per_key(table(s, d, "prompt_pairs"), ["pair_id"], [F.col("received_at").asc_nulls_last()]).select("pair_id", "page_number", "raw_response")).select("pair_id", "page_json", "error_code"),
    "trial_scores": lambda s, d: answers.scored(
        answers.parsed(one_per_key(table(s, d, "prompt_pairs"), ["pair_id"], [F.col("received_at").asc_nulls_last()]).select("pair_id", F.col("page_number").alias("target_page"), "raw_response")),
        s.createDataFrame([(1, ["the"], ["sextant"], [], ["Figure 1-1: "]), (2, ["page"], [], [], [])], "target_page int, expected array<string>, forbidden array<string>, expected_captions array<string>, forbidden_captions array<string>"),
    ).select("pair_id", "target_page", "expected_hits", "expected_total", "forbidden_hits", "caption_hits", "bleed", "score"),
    "trial_plan": lambda s, d: trials.plan(s, trials.PRESETS["figure-adjacent"], trials.SCENARIOS[:4], 60),
    "logical_trials": lambda s, d: trials.logical(_trials(s, d), ["book_id", "target_page", "scenario"], ["run_id", "seq", "id"], trials.rank()).select("book_id", "target_page", "scenario", "run_id", "id"),
    "trial_replacements": lambda s, d: trials.replacements(_trials(s, d), ["book_id", "target_page", "scenario"], ["run_id", "seq", "id"], trials.rank()),
    "run_summary": lambda s, d: trials.run_summary(_trials(s, d)),
    "scenario_report": lambda s, d: reports.by_group(reports.logical(_trials(s, d)), "scenario"),
    "page_report": lambda s, d: reports.by_group(reports.logical(_trials(s, d)), "book_id", "target_page"),
    "report_totals": lambda s, d: reports.totals(reports.logical(_trials(s, d))),
    "low_trials": lambda s, d: reports.low(reports.logical(_trials(s, d))).select("book_id", "target_page", "scenario", "run_id", "id", "forbidden", "score"),
    "report_markdown": lambda s, d: reports.report_markdown(_trials(s, d)),
    "rescored_trials": lambda s, d: reports.rescored(_answers(s, d), _oracle(s)).select("pair_id", "target_page", "status", "error", "parsed.strategy", "parsed.schema_repaired", F.col("parsed.target_page").alias("answered_page"), "expected_hits", "expected_total", "forbidden_hits", "caption_hits", "bleed", "score"),
    "dry_trials": lambda s, d: reports.rescored(reports.dry_answers(trials.plan(s, trials.PRESETS["figure-adjacent"], trials.SCENARIOS), _oracle(s)), _oracle(s)).select("trial_id", "target_page", "scenario", "status", "expected_hits", "forbidden_hits", "bleed", "score"),
    "trial_prompts": lambda s, d: reports.prompt_texts(trials.plan(s, trials.PRESETS["figure-adjacent"], trials.SCENARIOS), TERMS).select("trial_id", "target_page", "scenario", "user_prompt", F.array_join("images", "|").alias("images")),
    "dry_pages": lambda s, d: reports.dry_markdown(_pages(s, d).where("page_number IS NOT NULL").select("page_id", "page_number", "book_id", F.format_string("page_%03d.png", "page_number").alias("path"), F.lit(0).alias("length"))).select("page_id", "markdown"),
    "qa_markdown": lambda s, d: reports.qa_markdown(table(s, d, "documents"), -1, TERMS, EXPECTED).select("doc_id", "markdown"),
    "text_layer_blocks": lambda s, d: reports.text_layer_blocks(table(s, d, "documents"), "doc_id"),
    "variant_pages": lambda s, d: reports.variants_by_page(table(s, d, "documents"), KINDS),
    "marker_images": lambda s, d: reports.page_images(_figure_lines(s, d), _images(s, d)).select("doc_id", "book_id", "page", "line_no", "path", "found"),
    "legacy_assembly": lambda s, d: reports.legacy_assembly(_pages(s, d), "book_id", "page_number", _page_text(s, d)).select("book_id", "part", "n_pages", F.md5("markdown").alias("md5")),
    "run_results": lambda s, d: reports.results_of_runs(table(s, d, "benchmark_trials"), table(s, d, "prompt_pairs")),
    "error_classes": lambda s, d: reports.error_classes(table(s, d, "structured_pages").distinct()).groupBy("class", "retryable").agg(F.count("*").alias("n")),
    "draft_profiles": lambda s, d: reports.draft_profiles(_images(s, d)),
    "all_list_pages": lambda s, d: qa.list_style(table(s, d, "documents"), None).select("doc_id", "page", "bullets", "headings", F.array_join("heading_samples", "|").alias("samples")),
    "notable_trials": lambda s, d: trials.notable(_trials(s, d)).select("run_id", "id"),
    "turn_counts": lambda s, d: table(s, d, "prompt_pairs").groupBy("run_id").agg(F.countDistinct("pair_id").alias("turns")),
    "latest_pages": lambda s, d: projection.latest(table(s, d, "structured_pages")).select("book_id", "page_num", "status", "updated_at"),
    "status_counts": lambda s, d: projection.status_counts(projection.latest(table(s, d, "structured_pages"))),
    "projection_totals": lambda s, d: projection.totals(projection.latest(table(s, d, "structured_pages"))),
    "short_pages": lambda s, d: validate.short_pages(projection.latest(table(s, d, "structured_pages")), 800),
    "listed_pages": lambda s, d: projection.listed(projection.latest(table(s, d, "structured_pages")), "bk-gazette", "succeeded", 20).select("book_id", "page_num", "status"),
    "page_errors": lambda s, d: projection.errors(projection.latest(table(s, d, "structured_pages"))),
    "book_report": lambda s, d: validate.book_report(_pages(s, d), projection.latest(table(s, d, "structured_pages")), documents.adjacent_keys(_captions(s, d), "book_id", "page_number", "norm"), reports.draft_profiles(_images(s, d)).select("book_id", "expected_pages"), 800),
    "type_patch": lambda s, d: profiles.type_patch(_pages(s, d).select("book_id", F.col("page_number").alias("page"), F.col("page_type").alias("inferred"), F.col("attempt").alias("seq")), _known_types(s, d)),
    "log_levels": lambda s, d: logs.level_counts(one_per_key(table(s, d, "log_events"), ["log_file", "line_no"], [F.col("imported_at").asc_nulls_last()])),
    "log_totals": lambda s, d: logs.counts(one_per_key(table(s, d, "log_events"), ["log_file", "line_no"], [F.col("imported_at").asc_nulls_last()])),
    "log_event_counts": lambda s, d: logs.events(one_per_key(table(s, d, "log_events"), ["log_file", "line_no"], [F.col("imported_at").asc_nulls_last()])),
    "log_failures": lambda s, d: logs.failures(table(s, d, "log_events")).select("log_file", "line_no").distinct(),
    "log_import": lambda s, d: logs.imported(table(s, d, "log_events").select("log_file", "line_no", "raw").distinct(), "raw").select("log_file", "line_no", "parsed", "level", "event", "message"),
}

# SQL ------------------------------------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL"
_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_SPACE = lambda c: f"trim(regexp_replace(lower({c}), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0B]+', ' ', 'g'))"
_COLLAPSE = lambda c: f"trim(regexp_replace({c}, '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x0B]+', ' ', 'g'))"
_MARK = "(?m)^<!-- page:(\\d+) -->\\s*$"
_SPLIT = f"""
  parts AS (SELECT doc_id, regexp_extract_all(text, '{_MARK}', 1) AS nums, string_split_regex(text, '(?m)^<!-- page:\\d+ -->\\s*$') AS bodies FROM documents WHERE text IS NOT NULL),
  pages AS (SELECT doc_id, unnest(range(len(nums))) AS pos, nums, bodies FROM parts),
  page AS (SELECT doc_id, pos, CAST(nums[pos + 1] AS INT) AS page, regexp_replace(bodies[pos + 2], '^\\n+|\\n+$', '', 'g') AS body FROM pages)"""
_PAGES = "p AS (SELECT * FROM ocr_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at NULLS LAST) = 1)"
_BLOCKS = f"{_PAGES}, b AS (SELECT page_id, book_id, page_number, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS block_no FROM p)"
_CAPTIONS = f"{_BLOCKS}, c AS (SELECT book_id, page_number, block_no, b.caption AS caption, {_SPACE('b.caption')} AS norm FROM b WHERE trim(b.caption) <> '')"
_TRIALS = """
  t AS (SELECT * FROM benchmark_trials QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY seq NULLS LAST, started_at NULLS LAST) = 1),
  m AS (SELECT * FROM trial_metrics QUALIFY row_number() OVER (PARTITION BY run_id, trial_id ORDER BY target_only_score DESC NULLS LAST) = 1),
  tm AS (SELECT t.*, m.* EXCLUDE (run_id, trial_id) FROM t LEFT JOIN m ON t.run_id = m.run_id AND t.id = m.trial_id),
  ranked AS (SELECT *, coalesce(target_only_score, 0) + CASE WHEN status = 'succeeded' THEN 1000 ELSE 0 END + CASE WHEN json_parse_ok THEN 100 ELSE 0 END
    + CASE WHEN NOT coalesce(suspected_bleed, false) THEN 10 ELSE 0 END + CASE WHEN coalesce(error, '') = '' THEN 1 ELSE 0 END AS rk FROM tm)"""
_LATEST = """s AS (SELECT * FROM structured_pages QUALIFY row_number() OVER (PARTITION BY book_id, page_num
  ORDER BY updated_at DESC NULLS LAST, coalesce(list_position(['pending', 'running', 'failed', 'succeeded'], status), 0) DESC) = 1)"""
_LOG = "l AS (SELECT * FROM log_events QUALIFY row_number() OVER (PARTITION BY log_file, line_no ORDER BY imported_at NULLS LAST) = 1)"
_LOGICAL = """g AS (SELECT *, CAST(coalesce(forbidden_phrase_hits, 0) + coalesce(forbidden_caption_hits, 0) AS BIGINT) AS forbidden, coalesce(target_only_score, 0) AS score FROM ranked
    QUALIFY row_number() OVER (PARTITION BY book_id, target_page, scenario ORDER BY rk DESC, run_id NULLS FIRST, seq NULLS FIRST, id NULLS FIRST) = 1)"""
_SUMS = "count(*) AS trials, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (json_parse_ok) AS parse_ok, count(*) FILTER (suspected_bleed) AS bleed, CAST(coalesce(sum(forbidden), 0) AS BIGINT) AS forbidden_hits, round(coalesce(avg(score), 0), 6) AS avg_score"
_LEAST = "count(*) FILTER (schema_repaired) AS schema_repaired, round(least(1.0, min(score)), 6) AS min_score"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list_line(c: str) -> str:
    s = f"regexp_replace({c}, '[ \\t]+$', '')"
    lead, gap = (p.replace("(?d)", "") for p in (LEADER_LINE, SPACED_PAGE_LINE))

    def rewritten(p: str) -> str:
        label = _COLLAPSE(f"regexp_extract({s}, '{p}', 1)")
        return f"CASE WHEN strlen({label}) < 3 THEN {s} ELSE {label} || ' ... ' || regexp_extract({s}, '{p}', 2) END"

    return f"CASE WHEN {_TRIM(s)} = '' THEN '' WHEN regexp_matches({s}, '{lead}') THEN {rewritten(lead)} WHEN regexp_matches({s}, '{gap}') THEN {rewritten(gap)} ELSE {s} END"


_phrase_hits = lambda kind: "CAST(" + (" + ".join(f"CASE WHEN contains(t, {_q(' '.join(p.lower().split()))}) THEN 1 ELSE 0 END" for p, k in PHRASES if k == kind) or "0") + " AS BIGINT)"
_families = ", ".join(f"({_q(n)}, {_q(c)})" for c, names in RENAMES.items() for n in (c, *names))
_pair = "book_id, target_page, scenario"
_bad_rows = " UNION ALL ".join(
    f"SELECT doc_id, {_q(t)} AS term, CAST((length(text) - length(replace(text, {_q(t)}, ''))) / {len(t)} AS BIGINT) AS hits, CAST(length(left(text, instr(text, {_q(t)}) - 1)) - length(replace(left(text, instr(text, {_q(t)}) - 1), chr(10), '')) + 1 AS BIGINT) AS line FROM documents WHERE contains(text, {_q(t)})"
    for t in TERMS
)

ORACLES = {
    "adjacent_duplicate_lines": f"WITH l AS (SELECT doc_id, line_no, {_TRIM('line')} AS line FROM ({_LINES})), w AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l) SELECT doc_id, line_no, line FROM w WHERE line <> '' AND line = before",
    "page_duplicate_lines": f"WITH {_SPLIT}, l AS (SELECT doc_id, pos, page, {_TRIM('line')} AS line, line_no FROM (SELECT doc_id, pos, page, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM page)), w AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, pos ORDER BY line_no) AS before FROM l) SELECT doc_id, page, line_no, line FROM w WHERE line <> '' AND line = before",
    "document_pages": f"WITH {_SPLIT} SELECT doc_id, pos, page, CAST(strlen(body) AS BIGINT) AS n_bytes FROM page",
    "line_stats": f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '^\\s*[-*]\\s+')) AS bullets, count(*) FILTER (regexp_matches(line, '^\\s*#{{1,6}}\\s+')) AS headings, count(*) FILTER (starts_with(line, '|')) AS table_lines, count(*) FILTER (starts_with(line, '```')) AS fences, count(*) FILTER (trim(line) = '') AS blanks, count(*) FILTER (starts_with(line, '[FIGURE:')) AS figures, CAST(sum(strlen(line)) + count(*) - 1 AS BIGINT) AS n_bytes FROM ({_LINES}) GROUP BY doc_id",
    "variant_comparison": f"SELECT kind, count(DISTINCT doc_id) AS documents, CAST(sum(strlen(line) + 1) - count(DISTINCT doc_id) AS BIGINT) AS n_bytes, count(*) FILTER (regexp_matches(line, '^\\s*#{{1,6}}\\s+')) AS headings, count(*) FILTER (starts_with(line, '[FIGURE:')) AS figures, count(*) FILTER (starts_with(line, '|')) AS table_lines, count(*) FILTER (starts_with(line, '```')) AS fences, count(*) FILTER (trim(line) = '') AS blanks FROM ({_LINES}) JOIN (SELECT doc_id, kind FROM documents) USING (doc_id) GROUP BY kind",
    "known_bad_terms": _bad_rows,
    "missing_strings": " UNION ALL ".join(f"SELECT doc_id, {_q(t)} AS expected FROM documents WHERE text IS NOT NULL AND NOT contains(text, {_q(t)})" for t in EXPECTED),
    "document_continuity": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_MARK}', 1)) AS BIGINT) AS n_markers, list_transform(regexp_extract_all(text, '{_MARK}', 1), lambda x: CAST(x AS INT)) = [1] AS continuous FROM documents WHERE text IS NOT NULL",
    "book_continuity": "SELECT book_id, count(DISTINCT page_number) AS n_pages, min(page_number) AS first_page, max(page_number) AS last_page, CAST(max(page_number) AS BIGINT) - count(DISTINCT page_number) AS missing, min(page_number) = 1 AND max(page_number) = count(DISTINCT page_number) AS continuous FROM ocr_pages GROUP BY book_id",
    "list_page_style": f"WITH {_SPLIT}, l AS (SELECT doc_id, page, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^\\s*[-*]\\s+')) AS b, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^\\s*#{{1,6}}\\s+')) AS h FROM page WHERE page < 400 AND page % 2 = 1) SELECT doc_id, page, CAST(len(b) AS BIGINT) AS bullets, CAST(len(h) AS BIGINT) AS headings, array_to_string(list_transform(h[1:3], lambda x: {_TRIM('x')}), '|') AS samples FROM l",
    "diagram_pages": f"""WITH {_SPLIT}, l AS (SELECT doc_id, pos, {_TRIM('line')} AS s FROM (SELECT doc_id, pos, unnest(string_split(body, chr(10))) AS line FROM page)),
      c AS (SELECT doc_id, pos, s <> '' AND NOT regexp_matches(s, '(?i)^\\s*Figure\\s+\\d+(?:[-.]\\d+)?\\s*:') AS ok, s, length(regexp_replace(s, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(s, '[^A-Z]', '', 'g')) AS u FROM l),
      n AS (SELECT doc_id, pos, count(*) FILTER (ok AND (contains(s, '->') OR contains(s, '<-') OR contains(s, '---') OR contains(s, '- -') OR (a >= 4 AND u * 2 >= a))) AS cue_lines, count(*) FILTER (ok AND len(string_split_regex(s, '\\s+')) >= 9 AND regexp_matches(s, '[.,;:]')) AS prose_lines FROM c GROUP BY doc_id, pos)
      SELECT *, cue_lines >= 2 AND prose_lines < 3 AS diagram FROM n""",
    "normalize_list_lines": f"SELECT * FROM (SELECT doc_id, line_no, line, {_list_line('line')} AS normalized FROM ({_LINES})) WHERE normalized <> regexp_replace(line, '[ \\t]+$', '')",
    "positional_diff": f"SELECT doc_id, line_no, CASE WHEN line = '' THEN '+' WHEN new_line = '' THEN '-' ELSE '~' END AS op, line AS old_line, new_line FROM (SELECT doc_id, line_no, line, {_list_line('line')} AS new_line FROM ({_LINES})) WHERE line <> new_line",
    "captions_distinct": f"WITH {_CAPTIONS} SELECT book_id, norm, arg_min(caption, page_number * 1000000 + block_no) AS caption, count(*) AS n FROM c GROUP BY book_id, norm",
    "adjacent_captions": f"WITH {_CAPTIONS}, k AS (SELECT DISTINCT book_id, page_number, norm FROM c) SELECT a.book_id, a.page_number, a.norm, b.page_number AS next_page FROM k a JOIN k b ON a.book_id = b.book_id AND a.norm = b.norm AND b.page_number = a.page_number + 1",
    "anchor_hits": f"WITH d AS (SELECT doc_id, {_SPACE('coalesce(text, chr(32))')} AS t FROM documents) SELECT doc_id, {_phrase_hits('expected')} AS expected_hits, CAST({sum(k == 'expected' for _, k in PHRASES)} AS BIGINT) AS expected_total, {_phrase_hits('forbidden')} AS forbidden_hits, {_phrase_hits('forbidden_caption')} AS caption_hits, {_phrase_hits('forbidden')} + {_phrase_hits('forbidden_caption')} > 0 AS bleed FROM d",
    "block_warnings": f"""WITH {_BLOCKS}, w AS (SELECT page_id, block_no, CASE WHEN b.type = 'figure' AND trim(coalesce(b.caption, '')) = '' THEN 'figure_missing_caption' WHEN b.type = 'table' AND b."table" IS NULL THEN 'table_missing_payload'
      WHEN b.type = 'table' AND coalesce(len(b."table".headers), 0) = 0 AND coalesce(len(b."table"."rows"), 0) = 0 THEN 'table_empty' WHEN b.type = 'code' AND trim(coalesce(b.text, '')) = '' THEN 'code_empty'
      WHEN b.type = 'list' AND (trim(coalesce(b.items, '')) = '' OR regexp_replace(b.items, '\\s', '', 'g') = '[]') THEN 'list_empty' END AS code, coalesce(b.id, '') AS value FROM b WHERE b IS NOT NULL) SELECT * FROM w WHERE code IS NOT NULL""",
    "block_counts": f"WITH {_PAGES} SELECT page_id, CAST(coalesce(len(list_filter(blocks, lambda x: x IS NOT NULL)), 0) AS BIGINT) AS n_blocks, CAST(coalesce(len(list_filter(blocks, lambda x: x.type = 'table')), 0) AS BIGINT) AS tables, CAST(coalesce(len(list_filter(blocks, lambda x: x.type = 'figure')), 0) AS BIGINT) AS figures FROM p",
    "warning_codes": f"WITH {_BLOCKS} SELECT w.code AS code, count(*) AS n FROM (SELECT unnest(warnings) AS w FROM p UNION ALL SELECT unnest(b.warnings) AS w FROM b) WHERE w IS NOT NULL GROUP BY w.code",
    "context_neighbours": "WITH n AS (SELECT DISTINCT book_id, page_number FROM ocr_pages) SELECT a.book_id, a.page_number, CASE WHEN b.page_number < a.page_number THEN 'previous' ELSE 'next' END AS side, b.page_number AS neighbour FROM n a JOIN n b ON a.book_id = b.book_id AND b.page_number BETWEEN a.page_number - 2 AND a.page_number + 2 AND b.page_number <> a.page_number",
    "discovered_pages": "WITH f AS (SELECT DISTINCT image_path AS path FROM structured_pages), n AS (SELECT TRY_CAST(regexp_extract_all(string_split(path, '/')[-1], '\\d+')[-1] AS INT) AS page, path FROM f) SELECT page, path FROM n WHERE page BETWEEN 2 AND 10",
    "image_index": "WITH n AS (SELECT TRY_CAST(regexp_extract_all(string_split(image_path, '/')[-1], '\\d+')[-1] AS INT) AS page, image_path AS path, regexp_replace(image_path, '/?[^/]*$', '') AS folder FROM structured_pages) SELECT folder, page, min(path) AS path FROM n WHERE page > 0 GROUP BY folder, page",
    "assembled_markdown": f"WITH {_PAGES}, t AS (SELECT book_id, page_number, CAST(floor((page_number - 1) / 200) AS BIGINT) AS part, printf('<!-- page:%03d -->', page_number) || chr(10) || chr(10) || coalesce(array_to_string(list_filter(list_transform(blocks, lambda x: x.text), lambda y: y IS NOT NULL), chr(10) || chr(10)), '') AS t FROM p) SELECT book_id, part, count(*) AS n_pages, md5(string_agg(t, chr(10) ORDER BY page_number, t)) AS md5 FROM t GROUP BY book_id, part",
    "trial_plan": f"WITH p AS (SELECT * FROM (VALUES {', '.join(f'({i}, {p})' for i, p in enumerate(trials.PRESETS['figure-adjacent']))}) v(i, target_page)), s AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_q(n)})' for i, n in enumerate(trials.SCENARIOS[:4]))}) v(j, scenario)), x AS (SELECT row_number() OVER (ORDER BY i, j) AS n, target_page, scenario FROM p, s) SELECT printf('trial-%04d', n) AS trial_id, CAST(target_page AS INT) AS target_page, scenario FROM x WHERE n <= 60",
    "logical_trials": f"WITH {_TRIALS} SELECT book_id, target_page, scenario, run_id, id FROM ranked QUALIFY row_number() OVER (PARTITION BY {_pair} ORDER BY rk DESC, run_id NULLS FIRST, seq NULLS FIRST, id NULLS FIRST) = 1",
    "trial_replacements": f"WITH {_TRIALS}, x AS (SELECT *, max(rk) OVER (PARTITION BY {_pair} ORDER BY run_id NULLS FIRST, seq NULLS FIRST, id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM ranked) SELECT {_pair}, count(*) AS trials, count(*) - 1 AS duplicates, count(*) FILTER (bf IS NOT NULL AND rk > bf) AS replacements FROM x GROUP BY {_pair}",
    "run_summary": f"WITH {_TRIALS} SELECT run_id, scenario, CAST(grouping(scenario) AS INT) AS whole_run, count(*) AS trials, count(*) FILTER (status IN ('succeeded', 'parse_failed')) AS succeeded, count(*) FILTER (NOT coalesce(status IN ('succeeded', 'parse_failed'), false)) AS failed, count(*) FILTER (suspected_bleed) AS bleed, round(avg(coalesce(target_only_score, 0)), 6) AS avg_score FROM tm GROUP BY GROUPING SETS ((run_id, scenario), (run_id))",
    "scenario_report": f"WITH {_TRIALS}, {_LOGICAL} SELECT scenario, {_SUMS}, {_LEAST} FROM g GROUP BY scenario",
    "page_report": f"WITH {_TRIALS}, {_LOGICAL} SELECT book_id, target_page, {_SUMS}, {_LEAST} FROM g GROUP BY book_id, target_page",
    "report_totals": f"WITH {_TRIALS}, {_LOGICAL} SELECT {_SUMS} FROM g",
    "low_trials": f"WITH {_TRIALS}, {_LOGICAL} SELECT book_id, target_page, scenario, run_id, id, forbidden, score FROM g WHERE score < 1 OR forbidden > 0 OR coalesce(suspected_bleed, false) OR coalesce(status, '') <> 'succeeded'",
    "variant_pages": "SELECT page_num" + "".join(f", CAST(coalesce(sum(strlen(text)) FILTER (kind = {_q(k)}), 0) AS BIGINT) AS {k}" for k in KINDS) + " FROM documents WHERE page_num IS NOT NULL GROUP BY page_num",
    "marker_images": f"""WITH {_SPLIT}, l AS (SELECT doc_id, page, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM page), m AS (SELECT l.doc_id, d.book_id, page, CAST(line_no AS INT) AS line_no FROM l JOIN documents d ON d.doc_id = l.doc_id WHERE d.book_id IS NOT NULL AND starts_with(line, '[FIGURE:')),
      i AS (SELECT book_id, TRY_CAST(regexp_extract_all(string_split(image_path, '/')[-1], '\\d+')[-1] AS INT) AS page, min(image_path) AS path FROM structured_pages WHERE image_path IS NOT NULL GROUP BY 1, 2)
      SELECT doc_id, m.book_id, m.page, line_no, coalesce(path, printf('images/%s/page_%03d.png', m.book_id, m.page)) AS path, path IS NOT NULL AS found FROM m LEFT JOIN i ON i.book_id = m.book_id AND i.page = m.page""",
    "legacy_assembly": f"WITH {_PAGES}, t AS (SELECT book_id, page_number, CAST(floor((page_number - 1) / 200) AS BIGINT) AS part, printf('<!-- page:%03d -->', page_number) || chr(10) || chr(10) || regexp_replace(coalesce(array_to_string(list_filter(list_transform(blocks, lambda x: x.text), lambda y: y IS NOT NULL), chr(10) || chr(10)), ''), '^\\s+|\\s+$', '', 'g') AS t FROM p) SELECT book_id, part, count(*) AS n_pages, md5(string_agg(t, chr(10) || chr(10) ORDER BY page_number, t)) AS md5 FROM t GROUP BY book_id, part",
    "run_results": "WITH t AS (SELECT DISTINCT run_id, id AS trial_id FROM benchmark_trials), a AS (SELECT run_id, trial_id, count(DISTINCT pair_id) AS answers FROM prompt_pairs WHERE raw_response IS NOT NULL GROUP BY 1, 2) SELECT t.run_id, count(*) AS trials, count(answers) AS answered, CAST(coalesce(sum(answers), 0) AS BIGINT) AS answers FROM t LEFT JOIN a USING (run_id, trial_id) GROUP BY t.run_id",
    "error_classes": """WITH s AS (SELECT DISTINCT * FROM structured_pages), e AS (SELECT lower(coalesce(error_message, '')) AS m FROM s WHERE status = 'failed'), c AS (SELECT CASE WHEN contains(m, 'read target image') THEN 'structured_image_read_failed' WHEN contains(m, 'parse structured ocr json') THEN 'structured_parse_failed' WHEN contains(m, 'page mismatch') THEN 'structured_page_mismatch'
      WHEN contains(m, 'tls') THEN 'structured_provider_tls' WHEN contains(m, 'rate limit') OR contains(m, '429') THEN 'structured_provider_rate_limit' WHEN contains(m, 'run structured ocr inference') THEN 'structured_provider_failed' ELSE 'structured_page_failed' END AS class FROM e)
      SELECT class, class NOT IN ('structured_image_read_failed', 'structured_parse_failed', 'structured_page_mismatch') AS retryable, count(*) AS n FROM c GROUP BY 1, 2""",
    "draft_profiles": "WITH i AS (SELECT book_id, TRY_CAST(regexp_extract_all(string_split(image_path, '/')[-1], '\\d+')[-1] AS INT) AS page FROM structured_pages WHERE image_path IS NOT NULL) SELECT book_id, count(DISTINCT page) AS expected_pages, min(page) AS first_page, max(page) AS last_page FROM i WHERE page > 0 GROUP BY book_id",
    "dry_pages": f"WITH {_PAGES} SELECT page_id, '## Page ' || printf('%03d', page_number) || chr(10) || chr(10) || 'Dry-run OCR for book `' || book_id || '` from `page_' || printf('%03d', page_number) || '.png` (0 image bytes).' AS markdown FROM p WHERE page_number IS NOT NULL",
    "all_list_pages": f"WITH {_SPLIT}, l AS (SELECT doc_id, page, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^\\s*[-*]\\s+')) AS b, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^\\s*#{{1,6}}\\s+')) AS h FROM page) SELECT doc_id, page, CAST(len(b) AS BIGINT) AS bullets, CAST(len(h) AS BIGINT) AS headings, array_to_string(list_transform(h[1:3], lambda x: {_TRIM('x')}), '|') AS samples FROM l",
    "notable_trials": f"WITH {_TRIALS} SELECT run_id, id FROM tm WHERE coalesce(target_only_score, 0) < 1 OR coalesce(forbidden_phrase_hits, 0) > 0 OR coalesce(suspected_bleed, false) OR coalesce(status, '') <> 'succeeded'",
    "turn_counts": "SELECT run_id, count(DISTINCT pair_id) AS turns FROM prompt_pairs GROUP BY run_id",
    "latest_pages": f"WITH {_LATEST} SELECT book_id, page_num, status, updated_at FROM s",
    "status_counts": f"WITH {_LATEST} SELECT status, count(*) AS n FROM s GROUP BY status",
    "projection_totals": f"WITH {_LATEST} SELECT count(*) AS pages, CAST(coalesce(sum(warning_count), 0) AS BIGINT) AS warning_count, CAST(coalesce(sum(table_count), 0) AS BIGINT) AS table_count, CAST(coalesce(sum(figure_count), 0) AS BIGINT) AS figure_count, CAST(coalesce(sum(rendered_bytes), 0) AS BIGINT) AS rendered_bytes FROM s",
    "short_pages": f"WITH {_LATEST} SELECT book_id, page_num, rendered_bytes FROM s WHERE status = 'succeeded' AND rendered_bytes > 0 AND rendered_bytes < 800",
    "listed_pages": f"WITH {_LATEST} SELECT book_id, page_num, status FROM s WHERE book_id = 'bk-gazette' AND status = 'succeeded' ORDER BY book_id, page_num LIMIT 20",
    "page_errors": f"""WITH {_LATEST}, e AS (SELECT coalesce(error_code, '') AS error_code, lower(coalesce(error_message, '')) AS m FROM s WHERE status = 'failed')
      SELECT error_code, CASE WHEN regexp_matches(m, 'timeout|deadline|cancel|tls|connection|rate limit|temporar') THEN true WHEN error_code IN ('structured_page_mismatch', 'parse_failed', 'image_read') OR regexp_matches(m, 'page mismatch|parse structured|read image|no such file') THEN false ELSE true END AS retryable, count(*) AS n FROM e GROUP BY 1, 2""",
    "book_report": f"""WITH {_CAPTIONS}, {_LATEST}, k AS (SELECT DISTINCT book_id, page_number, norm FROM c), z AS (SELECT book_id, count(DISTINCT TRY_CAST(regexp_extract_all(string_split(image_path, '/')[-1], '\\d+')[-1] AS INT)) AS expected_pages FROM structured_pages WHERE image_path IS NOT NULL GROUP BY book_id), n0 AS (SELECT book_id, count(DISTINCT page_number) AS n_pages FROM p GROUP BY book_id), n AS (SELECT n0.book_id, n_pages, expected_pages FROM n0 LEFT JOIN z ON z.book_id = n0.book_id),
      a AS (SELECT x.book_id, count(*) AS adjacent_captions FROM k x JOIN k y ON x.book_id = y.book_id AND x.norm = y.norm AND y.page_number = x.page_number + 1 GROUP BY x.book_id), h AS (SELECT book_id, count(*) AS short_pages FROM s WHERE status = 'succeeded' AND rendered_bytes > 0 AND rendered_bytes < 800 GROUP BY book_id)
      SELECT n.book_id, n_pages, expected_pages, coalesce(adjacent_captions, 0) AS adjacent_captions, coalesce(short_pages, 0) AS short_pages, coalesce(n_pages = expected_pages, false) AS complete, coalesce(adjacent_captions, 0) + coalesce(short_pages, 0) AS warning_count FROM n LEFT JOIN a USING (book_id) LEFT JOIN h USING (book_id)""",
    "type_patch": f"WITH {_PAGES}, {_LATEST}, o AS (SELECT book_id, page_number AS page, page_type AS inferred FROM p WHERE coalesce(page_type, '') <> '' QUALIFY row_number() OVER (PARTITION BY book_id, page_number ORDER BY attempt DESC NULLS LAST, page_type DESC) = 1), k AS (SELECT book_id, page_num AS page, CASE WHEN figure_count > 0 THEN 'figure' WHEN table_count > 0 THEN 'table' ELSE 'body' END AS known FROM s) SELECT o.book_id, o.page, known, inferred FROM o LEFT JOIN k ON k.book_id = o.book_id AND k.page = o.page WHERE inferred IS DISTINCT FROM known",
    "log_levels": f"WITH {_LOG} SELECT coalesce(nullif(level, ''), 'none') AS level, count(*) AS n FROM l GROUP BY 1",
    "log_totals": f"WITH {_LOG} SELECT count(*) AS lines, count(*) FILTER (parsed) AS parsed, count(*) FILTER (lower(level) = 'trace') AS trace, count(*) FILTER (lower(level) IN ('warn', 'error', 'fatal', 'panic')) AS trouble, count(*) FILTER (lower(coalesce(level, '')) <> 'trace' AND coalesce(event, '') <> '') AS events FROM l",
    "log_event_counts": f"WITH {_LOG} SELECT event, count(*) AS n, count(*) FILTER (lower(level) IN ('warn', 'error') OR event LIKE '%failed%') AS failures FROM l WHERE event <> '' GROUP BY event",
    "log_failures": "SELECT DISTINCT log_file, line_no FROM log_events WHERE lower(level) IN ('warn', 'error') OR event LIKE '%failed%'",
    "log_import": """WITH r AS (SELECT DISTINCT log_file, line_no, raw FROM log_events), j AS (SELECT *, raw LIKE '%{%' AND json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' AS ok FROM r), o AS (SELECT log_file, line_no, raw, coalesce(ok, false) AS parsed, CASE WHEN ok THEN CAST(raw AS JSON) END AS j FROM j)
      SELECT log_file, line_no, parsed, CASE WHEN json_type(j, '$.level') = 'VARCHAR' THEN j ->> '$.level' END AS level, CASE WHEN json_type(j, '$.event') = 'VARCHAR' THEN j ->> '$.event' END AS event,
      CASE WHEN parsed THEN coalesce(CASE WHEN json_type(j, '$.message') = 'VARCHAR' THEN j ->> '$.message' END, CASE WHEN json_type(j, '$.msg') = 'VARCHAR' THEN j ->> '$.msg' END) ELSE raw END AS message FROM o""",
}

_WORK = {k: ORACLES[k] for k in ("known_bad_terms", "missing_strings", "page_duplicate_lines", "all_list_pages")}
_QA = f"""bad AS ({_WORK["known_bad_terms"]}), lost AS ({_WORK["missing_strings"]}), twice AS ({_WORK["page_duplicate_lines"]}), style AS ({_WORK["all_list_pages"]}),
  findings AS (SELECT doc_id, 'error' AS severity, 'known_bad_term' AS code, CAST(NULL AS INT) AS page, CAST(line AS INT) AS line, printf('known bad term "%s" found %d time(s)', term, hits) AS message FROM bad
    UNION ALL SELECT doc_id, 'error', 'expected_string_missing', NULL, NULL, printf('expected string "%s" is missing', expected) FROM lost
    UNION ALL SELECT doc_id, 'error', 'adjacent_duplicate_line', page, CAST(line_no AS INT), 'adjacent duplicate non-empty line: ' || line FROM twice
    UNION ALL SELECT doc_id, 'warning', 'list_page_markdown_bullets', page, NULL, printf('list page has %d markdown bullet line(s)', bullets) FROM style WHERE bullets > 0
    UNION ALL SELECT doc_id, 'warning', 'list_page_markdown_headings', page, NULL, printf('list page has %d markdown heading line(s)', headings) FROM style WHERE headings > 0)"""
ORACLES |= {
    "qa_findings": f"WITH {_QA} SELECT * FROM findings",
    "qa_passed": f"WITH {_QA}, w AS (SELECT DISTINCT doc_id FROM findings) SELECT d.doc_id, w.doc_id IS NULL AS passed FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id",
}

_ITEMS = """i(page_id, node, parent, v) AS (
    SELECT page_id, 'b' || block_no || '.i' || k, 'b' || block_no, a[k + 1] FROM (SELECT page_id, block_no, a, unnest(range(len(a))) AS k FROM (SELECT page_id, block_no, json_extract(b.items, '$[*]') AS a FROM b WHERE json_valid(b.items))) WHERE json_type(a[k + 1]) <> 'NULL'
    UNION ALL
    SELECT page_id, node || '.i' || k, node, a[k + 1] FROM (SELECT page_id, node, a, unnest(range(len(a))) AS k FROM (SELECT page_id, node, json_extract(v, '$.children[*]') AS a FROM i WHERE json_type(v) = 'OBJECT' AND json_type(v, '$.children') = 'ARRAY')) WHERE json_type(a[k + 1]) <> 'NULL')"""
_ROWS = 'r AS (SELECT page_id, block_no, unnest(b."table"."rows") AS cells, generate_subscripts(b."table"."rows", 1) - 1 AS row_no FROM b)'
_WARNS = """w AS (SELECT page_id, 'w' || n AS node, '' AS parent, x FROM (SELECT page_id, unnest(warnings) AS x, generate_subscripts(warnings, 1) - 1 AS n FROM p) WHERE x IS NOT NULL
    UNION ALL SELECT page_id, 'b' || block_no || '.w' || n, 'b' || block_no, x FROM (SELECT page_id, block_no, unnest(b.warnings) AS x, generate_subscripts(b.warnings, 1) - 1 AS n FROM b) WHERE x IS NOT NULL)"""
_VARIANT = """CASE WHEN b."table" IS NOT NULL THEN 'table_block' WHEN b.items IS NOT NULL THEN 'list_block' WHEN b.description IS NOT NULL OR b.diagram_text IS NOT NULL OR (b.caption IS NOT NULL AND b.text IS NULL) THEN 'figure_block'
    WHEN b.text IS NOT NULL AND b.level IS NOT NULL THEN 'heading_block' WHEN b.text IS NOT NULL THEN 'text_block' ELSE 'bare_block' END"""

_FIELDS = f"""j AS (SELECT feed, file_name, CAST(payload AS JSON) AS j FROM page_files WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT'),
      e AS (SELECT feed, file_name, k AS field, json_type(json_extract(j, '$."' || k || '"')) AS t FROM (SELECT feed, file_name, j, unnest(json_keys(j)) AS k FROM j)
        UNION ALL SELECT feed, file_name, 'blocks[].' || k, json_type(json_extract(o, '$."' || k || '"')) FROM (SELECT feed, file_name, o, unnest(json_keys(o)) AS k FROM (SELECT feed, file_name, unnest(json_extract(j, '$.blocks[*]')) AS o FROM j) WHERE json_type(o) = 'OBJECT')),
      f AS (SELECT feed, file_name, field, list_sort(list(DISTINCT CASE WHEN t = 'NULL' THEN NULL WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' ELSE t END) FILTER (t <> 'NULL')) AS types FROM e GROUP BY 1, 2, 3),
      chain AS (SELECT feed, file_name, lag(file_name) OVER (PARTITION BY feed ORDER BY w, file_name) AS prev FROM (SELECT feed, file_name, min(written_at) AS w FROM page_files GROUP BY 1, 2))"""
_CHANGES = f"""n AS (SELECT c.feed, c.file_name, f.field, coalesce(f.types, []) AS types FROM chain c JOIN f USING (feed, file_name) WHERE prev IS NOT NULL),
      o AS (SELECT c.feed, c.file_name, f.field, coalesce(f.types, []) AS old FROM chain c JOIN f ON c.feed = f.feed AND c.prev = f.file_name),
      d AS (SELECT coalesce(n.feed, o.feed) AS feed, coalesce(n.file_name, o.file_name) AS file_name, coalesce(n.field, o.field) AS field, types, old, CASE WHEN old IS NULL THEN 'added' WHEN types IS NULL THEN 'removed' WHEN types <> old THEN 'type_changed' END AS change FROM n FULL JOIN o ON n.feed = o.feed AND n.file_name = o.file_name AND n.field = o.field),
      fam AS (SELECT d.*, coalesce(v.family, '~' || lower(replace(field, '_', ''))) AS family FROM d LEFT JOIN (VALUES {_families}) v(name, family) ON v.name = d.field WHERE change IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY feed, file_name, family, change ORDER BY field) AS k FROM fam),
      x AS (SELECT a.feed, a.file_name, a.field, b.field AS new_field, a.old, b.types FROM r a JOIN r b ON a.feed = b.feed AND a.file_name = b.file_name AND a.family = b.family AND a.k = b.k AND a.change = 'removed' AND b.change = 'added'),
      z AS (SELECT feed, file_name, 'renamed' AS change, field, new_field FROM x UNION ALL SELECT feed, file_name, 'type_changed', new_field, '' FROM x WHERE old <> types
      UNION ALL SELECT feed, file_name, change, field, '' FROM r WHERE change = 'type_changed' OR (change = 'removed' AND NOT EXISTS (SELECT 1 FROM x WHERE x.feed = r.feed AND x.file_name = r.file_name AND x.field = r.field)) OR (change = 'added' AND NOT EXISTS (SELECT 1 FROM x WHERE x.feed = r.feed AND x.file_name = r.file_name AND x.new_field = r.field)))"""

#: SQL of the queries of problems 1 and 3.
PROBLEMS = {
    "p1_found": f"WITH RECURSIVE {_BLOCKS}, {_ITEMS}, {_ROWS}, {_WARNS} SELECT page_id, 'block' AS kind, 'b' || block_no AS node, '' AS parent FROM b WHERE b IS NOT NULL UNION ALL SELECT page_id, 'item', node, parent FROM i UNION ALL SELECT page_id, 'table_row', 'b' || block_no || '.r' || row_no, 'b' || block_no FROM r WHERE cells IS NOT NULL UNION ALL SELECT page_id, 'warning', node, parent FROM w",
    "p1_blocks": f"WITH {_BLOCKS} SELECT page_id, book_id, page_number, CAST(block_no AS INT) AS block_no, 'b' || block_no AS node, '' AS parent, {_VARIANT} AS variant, b.id AS block_id, b.type AS block_type, b.text AS text, CAST(b.level AS VARCHAR) AS level, b.caption AS caption, b.description AS description, array_to_string(b.diagram_text, chr(10)) AS diagram_text, array_to_string(b.\"table\".headers, '|') AS headers, b.confidence AS confidence FROM b WHERE b IS NOT NULL",
    "p1_table_rows": f"WITH {_BLOCKS}, {_ROWS} SELECT page_id, 'b' || block_no || '.r' || row_no AS node, 'b' || block_no AS parent, CAST(len(cells) AS BIGINT) AS n_cells, coalesce(array_to_string(cells, '|'), '') AS cells FROM r WHERE cells IS NOT NULL",
    "p1_warnings": f"WITH {_BLOCKS}, {_WARNS} SELECT page_id, node, parent, x.code AS code, x.message AS message, x.block_id AS block_id FROM w",
}
_ITEM_VARIANT = """CASE json_type(v) WHEN 'VARCHAR' THEN 'item_text' WHEN 'ARRAY' THEN 'group' WHEN 'OBJECT' THEN CASE WHEN len(list_filter(json_keys(v), lambda k: k NOT IN ('text', 'children'))) > 0 THEN 'item_other'
    WHEN coalesce(json_type(v, '$.text'), 'NULL') <> 'NULL' AND coalesce(json_type(v, '$.children'), 'NULL') <> 'NULL' THEN 'item_branch' ELSE 'item_node' END ELSE 'item_scalar' END"""
_ROW_VARIANT = "CASE WHEN len(list_filter(cells, lambda c: c IS NOT NULL)) = 0 THEN 'row_empty' WHEN len(list_filter(cells, lambda c: c IS NULL)) = 0 THEN 'row_full' ELSE 'row_gapped' END"
_WARN_VARIANT = "CASE WHEN x.block_id IS NOT NULL THEN 'warning_of_block' WHEN x.code IS NOT NULL OR x.message IS NOT NULL THEN 'warning_plain' ELSE 'warning_bare' END"
_ELEMENTS = f"""e AS (SELECT page_id, 'block' AS kind, 'b' || block_no AS node, '' AS parent, {_VARIANT} AS variant FROM b WHERE b IS NOT NULL UNION ALL SELECT page_id, 'item', node, parent, {_ITEM_VARIANT} FROM i
    UNION ALL SELECT page_id, 'table_row', 'b' || block_no || '.r' || row_no, 'b' || block_no, {_ROW_VARIANT} FROM r WHERE cells IS NOT NULL UNION ALL SELECT page_id, 'warning', node, parent, {_WARN_VARIANT} FROM w)"""
_SUBTYPE_COLUMNS = {"text": "b.text AS text", "level": "b.level AS level", "caption": "b.caption AS caption", "description": "b.description AS description", "diagram_text": "array_to_string(b.diagram_text, chr(10)) AS diagram_text", "block_type": "b.type AS block_type"}
PROBLEMS |= {
    "p1_elements": f"WITH RECURSIVE {_BLOCKS}, {_ITEMS}, {_ROWS}, {_WARNS}, {_ELEMENTS} SELECT * FROM e",
    "p1_variants": f"WITH RECURSIVE {_BLOCKS}, {_ITEMS}, {_ROWS}, {_WARNS}, {_ELEMENTS} SELECT kind, variant, count(*) AS n FROM e GROUP BY kind, variant",
    "p1_items": f"""WITH RECURSIVE {_BLOCKS}, {_ITEMS} SELECT page_id, node, parent, CAST(len(regexp_extract_all(node, '\\.i')) AS INT) AS depth, {_ITEM_VARIANT} AS variant,
      CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '$.text' WHEN json_type(v) <> 'ARRAY' THEN v ->> '$' END AS text FROM i""",
    "p1_cells": f"""WITH {_BLOCKS}, {_ROWS}, h AS (SELECT page_id, 'b' || block_no || '.h' AS parent, unnest(b."table".headers) AS value, generate_subscripts(b."table".headers, 1) - 1 AS n, CAST(NULL AS VARCHAR) AS header FROM b),
      c AS (SELECT r.page_id, 'b' || r.block_no || '.r' || row_no AS parent, unnest(cells) AS value, generate_subscripts(cells, 1) - 1 AS n, r.block_no FROM r),
      x AS (SELECT page_id, parent, value, n, header FROM h UNION ALL SELECT c.page_id, c.parent, c.value, c.n, b.b."table".headers[c.n + 1] FROM c JOIN b ON b.page_id = c.page_id AND b.block_no = c.block_no)
      SELECT page_id, parent || '.c' || n AS node, parent, CAST(n AS INT) AS column_no, header, value FROM x""",
    **{
        f"p1_{v}s": f"WITH {_BLOCKS}, x AS (SELECT *, {_VARIANT} AS variant FROM b WHERE b IS NOT NULL) SELECT page_id, 'b' || block_no AS node, '' AS parent, CAST(block_no AS INT) AS block_no, b.id AS block_id{''.join(', ' + _SUBTYPE_COLUMNS[c] for c in columns)} FROM x WHERE variant = '{v}'"
        for v, columns in nested.SUBTYPES.items()
    },
}
_argument = "CASE WHEN change = 'type_changed' THEN " + f"coalesce(CASE v.family {' '.join(f'WHEN {_q(k)} THEN {_q(x)}' for k, x in CASTS.items())} END, 'string') WHEN change IN ('added', 'removed') THEN CASE v.family {' '.join(f'WHEN {_q(k)} THEN {_q(x)}' for k, x in DEFAULTS.items())} END END"
PROBLEMS |= {
    "p3_found": f"WITH {_FIELDS}, {_CHANGES} SELECT * FROM z",
    "p3_fingerprints": f"""WITH {_FIELDS}, x AS (SELECT feed, file_name, sha256(array_to_string(list_sort(list(field || ':' || coalesce(array_to_string(list_sort(list_transform(types, lambda t: CASE t WHEN 'VARCHAR' THEN 'string' ELSE lower(t) END)), '+'), ''))), ',')) AS fingerprint, count(*) AS n_fields FROM f GROUP BY feed, file_name)
      SELECT feed, file_name, version, fingerprint, coalesce(n_fields, 0) AS n_fields FROM (SELECT feed, file_name, row_number() OVER (PARTITION BY feed ORDER BY w, file_name) AS version FROM (SELECT feed, file_name, min(written_at) AS w FROM page_files GROUP BY 1, 2)) LEFT JOIN x USING (feed, file_name)""",
    "p3_migrations": f"""WITH {_FIELDS}, {_CHANGES}, st AS (SELECT z.feed, file_name, CASE change WHEN 'renamed' THEN 1 WHEN 'added' THEN 2 WHEN 'removed' THEN 3 ELSE 4 END AS place, field, new_field, {_argument} AS argument FROM z LEFT JOIN (VALUES {_families}) v(name, family) ON v.name = field),
      g AS (SELECT feed, file_name, row_number() OVER (PARTITION BY feed ORDER BY w, file_name) AS version FROM (SELECT feed, file_name, min(written_at) AS w FROM page_files GROUP BY 1, 2))
      SELECT feed, version, row_number() OVER (PARTITION BY feed, version ORDER BY place, field, new_field) AS step, ['rename', 'default', 'drop', 'cast'][place] AS op, field, new_field, argument FROM st JOIN g USING (feed, file_name)""",
}
ORACLES |= PROBLEMS
