"""Reports over logical trials and over documents, in rows and as Markdown; answers scored anew; prompts and dry runs.

A logical trial is the best attempt of a cell (book, target page, scenario). Captions that must not be there count among
the forbidden phrases as well as by themselves in all reports, as the tool that this stands in for counts them.

Defined results: null scores count as 0, null flags as false; empty tables give totals of zero and no groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import BULLET_LINE, HEADING_LINE, PAGE_MARKER, count_of, trim_all
from folioscope.operators import answers, trials
from folioscope.operators.qa import doubled_lines

CELL = ("book_id", "target_page", "scenario")
ORDER = ("run_id", "seq", "id")

# Logical trials --------------------------------------------------------------------------------------------------------


def logical(all_trials: DataFrame) -> DataFrame:
    """The best attempt of each cell, with its forbidden hits in all."""
    hits = F.coalesce("forbidden_phrase_hits", F.lit(0)) + F.coalesce("forbidden_caption_hits", F.lit(0))
    return trials.logical(all_trials, CELL, ORDER, trials.rank()).withColumn("forbidden", hits.cast("long")).withColumn("score", F.coalesce("target_only_score", F.lit(0.0)))


def _sums() -> list[Column]:
    return [
        F.count("*").alias("trials"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if("json_parse_ok").alias("parse_ok"), F.count_if("suspected_bleed").alias("bleed"),
        F.coalesce(F.sum("forbidden"), F.lit(0)).alias("forbidden_hits"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("avg_score"),
    ]


def totals(best: DataFrame) -> DataFrame:
    """One row over all logical trials."""
    return best.agg(*_sums())


def by_group(best: DataFrame, *keys: str) -> DataFrame:
    """Logical trials by scenario or by page of a book, with the least score (1 at most), in the order of the keys."""
    return best.groupBy(*keys).agg(*_sums(), F.count_if("schema_repaired").alias("schema_repaired"), F.round(F.least(F.lit(1.0), F.min("score")), 6).alias("min_score")).orderBy(*keys)


def low(best: DataFrame) -> DataFrame:
    """Logical trials below full score, with forbidden hits or bleed, or not succeeded, by page and scenario."""
    hit = best.where((F.col("score") < 1) | (F.col("forbidden") > 0) | F.coalesce("suspected_bleed", F.lit(False)) | (F.coalesce("status", F.lit("")) != "succeeded"))
    return hit.orderBy("book_id", "target_page", "scenario")


def report_markdown(all_trials: DataFrame, title: str = "Benchmark report") -> DataFrame:
    """(section, line_no, line): the report as lines of Markdown; a row a line, so that no report is ever one row or on the driver."""
    best = logical(all_trials.withColumn("attempts", F.count("*").over(Window.partitionBy(*CELL))))
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    number = lambda c: F.format_string("%d", F.col(c))
    score = lambda c: F.format_string("%.3f", F.col(c))
    name = lambda c: F.concat(F.lit("`"), F.coalesce(c, F.lit("")), F.lit("`"))
    t = best.agg(*_sums(), F.coalesce(F.sum("attempts"), F.lit(0)).alias("raw"))
    facts = [("Raw trials", number("raw")), ("Logical trials", number("trials")), ("Duplicate logical cells", F.format_string("%d", F.col("raw") - F.col("trials"))), ("Successful logical trials", number("succeeded")), ("Parseable logical trials", number("parse_ok")), ("Suspected bleed", number("bleed")), ("Forbidden hits", number("forbidden_hits")), ("Average target-only score", score("avg_score"))]
    head = t.select(F.lit(0).alias("section"), F.posexplode(F.array(F.lit(f"# {title}"), F.lit(""), *[F.concat(F.lit(f"- {k}: "), v) for k, v in facts], F.lit(""))).alias("line_no", "line")).withColumn("order", F.lit(""))
    columns = ("trials", "succeeded", "parse_ok", "bleed", "forbidden_hits")

    def table(section: int, heading: str, names: str, rows: DataFrame, line: Column, order: Column) -> DataFrame:
        top = [f"## {heading}", "", names, "|" + "---|" * (names.count("|") - 1)]
        s = rows.sparkSession.createDataFrame([(section, i, x, "") for i, x in enumerate(top)], "section int, line_no int, line string, order string")
        return s.unionByName(rows.select(F.lit(section).alias("section"), F.lit(len(top)).alias("line_no"), line.alias("line"), order.alias("order")))

    scenario = by_group(best, "scenario")
    page = by_group(best, "book_id", "target_page")
    worst = low(best)
    place = F.format_string("%s %012d", F.coalesce("book_id", F.lit("")), F.coalesce("target_page", F.lit(0)))
    parts = [
        table(1, "By scenario", "| Scenario | Trials | Succeeded | Parse OK | Suspected bleed | Forbidden hits | Average score | Minimum score |", scenario, cells(name("scenario"), *map(number, columns), score("avg_score"), score("min_score")), F.coalesce("scenario", F.lit(""))),
        table(2, "By page", "| Book | Page | Trials | Succeeded | Parse OK | Suspected bleed | Forbidden hits | Average score | Minimum score |", page, cells(name("book_id"), number("target_page"), *map(number, columns), score("avg_score"), score("min_score")), place),
        table(3, "Low or notable trials", "| Trial | Book | Page | Scenario | Status | Forbidden hits | Bleed | Score |", worst, cells(F.coalesce("id", F.lit("")), name("book_id"), number("target_page"), name("scenario"), F.coalesce("status", F.lit("")), number("forbidden"), F.coalesce("suspected_bleed", F.lit(False)).cast("string"), score("score")), F.concat(place, F.coalesce("scenario", F.lit("")))),
    ]
    out = head
    for p in parts:
        out = out.unionByName(p)
    return out.orderBy("section", "line_no", "order").select("section", "line_no", "line")


def rescored(raw_trials: DataFrame, oracle: DataFrame, target: str = "target_page", raw: str = "raw_response") -> DataFrame:
    """Trials parsed and scored again from their raw answers.

    An answer without target page takes the trial's, which counts as a repair of its shape; a blank answer is a failed
    trial with the strategy ``missing-response``; one that can't be parsed is ``parse_failed``.
    """
    p = answers.parsed(raw_trials, raw)
    x = F.col("parsed")
    gap = F.coalesce(x["ok"], F.lit(False)) & (F.coalesce(x["target_page"], F.lit(0)) == 0)
    filled = x.withField("target_page", F.when(gap, F.col(target)).otherwise(x["target_page"])).withField("schema_repaired", gap | F.coalesce(x["schema_repaired"], F.lit(False)))
    filled = filled.withField("strategy", F.when(gap & (x["strategy"] == "strict-json"), "schema-repair").otherwise(x["strategy"]))
    p = p.withColumn("parsed", filled)
    blank = F.coalesce(trim_all(F.col(raw)), F.lit("")) == ""
    p = p.withColumn("status", F.when(blank, "failed").when(x["ok"], "succeeded").otherwise("parse_failed"))
    p = p.withColumn("error", F.when(blank, "empty raw response").when(x["ok"], "").otherwise("answer can't be parsed"))
    return answers.scored(p, oracle, target)


# Documents -------------------------------------------------------------------------------------------------------------


def qa_markdown(docs: DataFrame, expected_pages: int, bad: Sequence[str], expected: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, markdown): the findings of each document as a page of Markdown, in one narrow pass over the documents."""
    t = F.col(text)
    numbers = F.regexp_extract_all(t, F.lit(PAGE_MARKER), 1)
    bodies = F.slice(F.split(t, PAGE_MARKER), F.lit(2), F.greatest(F.size(numbers), F.lit(0)))
    pages = F.arrays_zip(numbers.alias("page"), bodies.alias("body"))
    lines = lambda body: F.split(F.regexp_replace(body, r"\A\n+|\n+\z", ""), "\n")
    shown = lambda page: F.format_string("%03d", page.try_cast("int"))
    count = lambda body, pattern: F.size(F.filter(lines(body), lambda s: s.rlike(pattern)))

    def doubled(p: Column) -> Column:
        return F.transform(doubled_lines(lines(p["body"])), lambda x: F.concat(F.lit("- page "), shown(p["page"]), F.format_string(", local line %d: adjacent duplicate non-empty line: %s", x["line_no"], x["line"])))

    none = F.array().cast("array<string>")
    duplicates = F.coalesce(F.flatten(F.transform(pages, doubled)), none)
    hits = F.array_compact(F.array(*[F.when(count_of(t, b) > 0, F.format_string(f"- `{_percent(b)}`: %d hit(s)", count_of(t, b))) for b in sorted(bad) if b])) if any(bad) else none
    strings = F.array(*[F.when(F.contains(t, F.lit(e)), f"- PASS: `{e}`").otherwise(f"- MISSING: `{e}`") for e in sorted(expected)]) if expected else none
    style = F.flatten(F.transform(pages, lambda p: F.array(F.concat(F.lit("### Page "), shown(p["page"])), F.format_string("- Markdown bullet lines: %d", count(p["body"], BULLET_LINE)), F.format_string("- Markdown heading lines: %d", count(p["body"], HEADING_LINE)), F.lit(""))))
    marks = F.size(F.filter(F.split(t, "\n"), lambda s: s.startswith("[FIGURE:")))
    continuous = F.lit(True) if expected_pages < 0 else F.transform(numbers, lambda s: s.try_cast("int")) == F.sequence(F.lit(1), F.lit(expected_pages or 30))
    missing = F.exists(strings, lambda s: s.startswith("- MISSING")) if expected else F.lit(False)
    styled = F.exists(pages, lambda p: (count(p["body"], BULLET_LINE) > 0) | (count(p["body"], HEADING_LINE) > 0))
    passed = continuous & (F.size(hits) == 0) & ~missing & (F.size(duplicates) == 0) & ~F.coalesce(styled, F.lit(False))
    or_pass = lambda a, what: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(f"- PASS: no {what} found.")))
    section = lambda name: F.array(F.lit(""), F.lit(f"## {name}"), F.lit(""))
    whole = F.concat(
        F.array(F.lit("# QA report"), F.lit(""), F.lit("## Summary"), F.lit(""), F.format_string("- Page markers found: %d", F.size(numbers)), F.lit(f"- Expected page markers: {expected_pages or 30 if expected_pages >= 0 else 'any'}"), F.format_string("- Figure markers: %d", marks)),
        section("Known bad term checks"), or_pass(hits, "known bad terms"), section("Expected string checks"), strings, section("Adjacent duplicate non-empty lines"), or_pass(duplicates, "adjacent duplicate non-empty lines"),
        section("List-page style checks"), style, section("Verdict"), F.array(F.when(passed, "PASS for automated checks.").otherwise("REVIEW REQUIRED: one or more automated checks produced findings.")),
    )
    return docs.where(t.isNotNull()).select(key, F.array_join(whole, "\n").alias("markdown"))


def _percent(text: str) -> str:
    return text.replace("%", "%%")


def text_layer_blocks(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, block_no, type, level, text): a page's text layer as headings and paragraphs.

    A backslash stands for a v that wasn't read; lines of signs and digits only are left out; a short line in capitals, with
    a section number or after CHAPTER is a heading, of level 1 if it is all in capitals; blank lines part paragraphs, and
    words broken at line ends are joined. Null texts have no blocks.
    """
    lines = F.transform(F.split(F.replace(F.replace(F.col(text), F.lit("\\"), F.lit("v")), F.lit("\f"), F.lit("\n")), "\n"), lambda s: trim_all(s))
    kept = F.filter(lines, lambda s: (s == "") | ~s.rlike(r"^[\W\d]*$"))
    #: What a heading of a text layer looks like.
    heading = lambda s: (F.length(s) < 70) & s.rlike(r"^(?:CHAPTER\s+\w+|\d+(?:\.\d+)*\s+\S.*|[A-Z][A-Z\s'&-]{3,60})$")
    # A heading is set off by blank lines; then every run between blank lines is a block.
    parted = F.array_join(F.transform(kept, lambda s: F.when(heading(s), F.concat(F.lit("\n"), s, F.lit("\n"))).otherwise(s)), "\n")
    blocks = F.filter(F.split(parted, r"\n\n+"), lambda b: trim_all(b) != "")
    b = pages.select(key, F.posexplode(blocks).alias("block_no", "b")).withColumn("b", trim_all(F.col("b")))
    is_head = heading(F.col("b"))
    upper = is_head & (F.upper("b") == F.col("b")) & F.col("b").rlike("[A-Z]")
    flowing = F.trim(F.regexp_replace(F.regexp_replace("b", r"(\w)-\s+(\w)", "$1$2"), r"\s+", " "))
    return b.select(key, "block_no", F.when(is_head, "heading").otherwise("paragraph").alias("type"), F.when(upper, 1).when(is_head, 2).alias("level"), F.when(upper, F.initcap("b")).when(is_head, F.col("b")).otherwise(flowing).alias("text"))


def variants_by_page(docs: DataFrame, kinds: Sequence[str], page: str = "page_num", kind: str = "kind", text: str = "text") -> DataFrame:
    """(page, one column of bytes a kind): how long each variant of a page is; the kinds are a short literal list."""
    n = F.octet_length(text).cast("long")
    return docs.where(F.col(page).isNotNull()).groupBy(page).pivot(kind, list(kinds)).agg(F.sum(n)).na.fill(0, list(kinds))


def page_images(markers: DataFrame, images: DataFrame, folder: str = "images") -> DataFrame:
    """Figure markers with the image of their page, from (book_id, page, path); where there is none, the path that it should have."""
    i = images.groupBy("book_id", "page").agg(F.min("path").alias("path"))
    j = markers.join(i, ["book_id", "page"], "left")
    return j.withColumn("found", F.col("path").isNotNull()).withColumn("path", F.coalesce("path", F.concat(F.lit(f"{folder}/"), F.col("book_id"), F.format_string("/page_%03d.png", "page"))))


def legacy_assembly(pages: DataFrame, book: str, page: str, text: Column) -> DataFrame:
    """Parts of a book with the marker of each page before its trimmed text and a blank line between pages."""
    from folioscope.operators.documents import assembled

    return assembled(pages, book, page, F.concat(F.format_string("<!-- page:%03d -->\n\n", page), trim_all(F.coalesce(text, F.lit("")))), "\n\n")


def results_of_runs(all_trials: DataFrame, turns: DataFrame) -> DataFrame:
    """(run_id, trials, answered, answers): the results that each run depends on, gathered by an equi-join on run and trial."""
    t = all_trials.select("run_id", F.col("id").alias("trial_id")).distinct()
    a = turns.where("raw_response IS NOT NULL").groupBy("run_id", "trial_id").agg(F.count_distinct("pair_id").alias("answers"))
    return t.join(a, ["run_id", "trial_id"], "left").groupBy("run_id").agg(F.count("*").alias("trials"), F.count("answers").alias("answered"), F.coalesce(F.sum("answers"), F.lit(0)).alias("answers"))


# Prompts and dry runs --------------------------------------------------------------------------------------------------

FIELDS = ("target_page", "transcribed_page_identity", "content_markers", "transcription", "suspected_context_copy", "notes")
#: For each scenario what comes before the target, the target itself and what comes after it.
LAYOUTS: Mapping[str, tuple[str, ...]] = {
    "target-only": ("target",), "target-plus-text-context": ("text", "target"), "single-block-target-first": ("target", "previous", "next"), "multi-block-labeled": ("target", "previous", "next"),
    "multi-block-unlabeled": ("target", "previous", "next"), "context-first-negative-control": ("previous", "next", "target"),
}


def quoted_list(terms: Sequence[str]) -> str:
    """Terms in quotation marks with a comma before the last ``and``."""
    q = [f'"{t}"' for t in terms]
    return "" if not q else q[0] if len(q) == 1 else f"{', '.join(q[:-1])}, and {q[-1]}"


def prompt_texts(plan: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
    """(plan's columns, system_prompt, user_prompt, images): what a model is asked for each planned trial, with the roles of its images in order."""
    p = F.format_string("%03d", "target_page")
    keep = f" Keep these spellings where the page has them: {quoted_list(terms)}." if terms else ""
    ask = F.concat(F.lit("Transcribe page "), p, F.lit(f" and no other page. Answer with one JSON object with the fields {', '.join(FIELDS)}, without fences.{keep}"))
    around = {"text": "Text of the neighbouring pages stands above for terms and style only.", "previous": "Images of neighbouring pages are there for context; nothing on them may be transcribed."}
    user = F.lit(None).cast("string")
    roles = F.array().cast("array<string>")
    for name, layout in LAYOUTS.items():
        hint = next((around[x] for x in layout if x in around), "")
        order = "The target comes first. " if layout[0] == "target" and len(layout) > 1 else "The target comes last. " if len(layout) > 2 else ""
        user = F.when(F.col("scenario") == name, F.concat(F.lit(order + hint + " " if hint else ""), ask)).otherwise(user)
        roles = F.when(F.col("scenario") == name, F.array(*[F.lit(x) for x in layout if x != "text"])).otherwise(roles)
    return plan.select("*", F.lit("You read scanned pages. Follow the bounds of the target page exactly and answer in strict JSON.").alias("system_prompt"), user.alias("user_prompt"), roles.alias("images"))


def dry_answers(plan: DataFrame, oracle: DataFrame) -> DataFrame:
    """(plan's columns, raw_response): answers of a dry run, made of what the oracle expects; only the negative control copies what it must not."""
    none = F.array().cast("array<string>")
    o = oracle.select("target_page", *[F.coalesce(c, none).alias(f"__{c}") for c in ("expected", "expected_captions", "forbidden_captions")])
    j = plan.join(o, "target_page", "left")
    get = lambda c: F.coalesce(f"__{c}", none)
    bleed = (F.col("scenario") == "context-first-negative-control") & (F.size(get("forbidden_captions")) > 0)
    extra = F.when(bleed, get("forbidden_captions")).otherwise(none)
    answer = F.struct(
        F.col("target_page"), F.struct(get("expected_captions").alias("title_or_caption_lines")).alias("transcribed_page_identity"), F.struct(F.concat(get("expected_captions"), extra).alias("figure_captions"), get("expected").alias("unique_phrases")).alias("content_markers"),
        F.array_join(F.concat(get("expected_captions"), get("expected"), extra), "\n").alias("transcription"), bleed.alias("suspected_context_copy"),
    )
    return j.select(*plan.columns, F.to_json(answer).alias("raw_response"))


def dry_markdown(pages: DataFrame, page: str = "page_number", book: str = "book_id", path: str = "path", size: str = "length") -> DataFrame:
    """(pages' columns, markdown): the text of a page in a dry run, of what is known of its image."""
    return pages.withColumn("markdown", F.format_string("## Page %03d\n\nDry-run OCR for book `%s` from `%s` (%d image bytes).", page, book, path, size))


# Errors and drafts -----------------------------------------------------------------------------------------------------

#: What a message says, in the order in which it is looked for, the error's code, and whether trying again makes sense.
ERROR_CODES = (
    ("read target image", "structured_image_read_failed", False), ("parse structured ocr json", "structured_parse_failed", False), ("page mismatch", "structured_page_mismatch", False), ("tls", "structured_provider_tls", True),
    ("rate limit", "structured_provider_rate_limit", True), ("429", "structured_provider_rate_limit", True), ("run structured ocr inference", "structured_provider_failed", True),
)


def error_classes(states: DataFrame, message: str = "error_message", hint: str | None = None) -> DataFrame:
    """(states' columns, class, retryable) of failed states, by the message; ``hint``, a boolean column, is a plugin's own word and goes first."""
    m = F.lower(F.coalesce(message, F.lit("")))
    code, again = F.lit("structured_page_failed"), F.lit(True)
    for text, name, retry in reversed(ERROR_CODES):
        code, again = F.when(F.contains(m, F.lit(text)), name).otherwise(code), F.when(F.contains(m, F.lit(text)), retry).otherwise(again)
    if hint:
        code = F.when(F.col(hint), "structured_plugin_retryable").when(~F.col(hint), "structured_plugin_permanent").otherwise(code)
        again = F.coalesce(hint, again)
    return states.where("status = 'failed'").select("*", code.alias("class"), again.alias("retryable"))


def draft_profiles(images: DataFrame) -> DataFrame:
    """(book_id, expected_pages, first_page, last_page) of a new workspace: what the images of each book, (book_id, page, path), say."""
    return images.where("page > 0").groupBy("book_id").agg(F.count_distinct("page").alias("expected_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
