"""Problem 4: noise of scanning in block texts and captions, found and repaired.

Page furniture goes first: a line that gives only its own page's number, or that bears a title. What is a title is
learned from all pages: a line beside whose words the page's own number stands, or that equals a heading of its book, or
that begins with a capital and returns in the book in the midst of other sentences. Titles are compared by a fold that maps
characters that scanning confuses to one. Then words broken over line ends are joined, if the mark is no part of them: the
line-join operation of an averaged-perceptron editor decides by the mark and by what the corpus knows of the joined word,
the compound and the rest. Last, the editor's keep, replace, delete and insert operations propose mended forms of every
word; it is misread if a mended form is far more frequent in the corpus.

Word counts, titles and misread words are distributed tables joined by key. Of the most frequent spellings, at most
``COMMON``, those that no mended form outnumbers are known to every task, so that they needn't be shuffled; every other
word is judged, however frequent it is. The editor is trained on at most ``LEXICON`` words and as many compounds.

Defined results: pages are taken once, by page_id; null blocks, texts and captions and blank texts have no noise; texts of
blocks of the kinds in ``SKIPPED`` are no cases, their captions are. One row per block, field and kind of noise.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.chareditor import CharEditor, JoinEditor, join_cues
from folioscope.sources.tables import most_frequent, one_per_key, stored

SKIPPED = ("heading", "list", "table", "code", "footnote", "page_footer")
COMMON, LEXICON = 30_000, 3_000
#: A mended form must be this often as frequent as the word itself, and be there so often at least.
RATIO, LEAST = 8, 3
#: A word of which at least this share stands in small letters is capital because it begins a sentence; names and German nouns are not.
SMALL = 0.2
#: How often a line must return in the midst of other sentences of its book to be a title by that alone.
RETURNS = 3

#: Marks that break words at line ends; those of SOFT are never part of a word.
SOFT = "­¬‐‑⸗"
_break = re.compile(rf"(?<=\w)([-{SOFT}=])[ \t]*\n[ \t]*(\w+)")
WORD = re.compile(r"[^\W_][\w@|$!ſ'’]*[\w@|$ſ]|\w[@|$ſ]\w*|[@|$ſ]\w+")
_number = re.compile(r"^[\W_]*(?:(?:page|pag|pg|p|seite|s|página|pág|folio|fol|f|no|nr)\b[\W_]*)?([0-9lIiOoSsBZzgq|]{1,5}|[ivxlc]+)[\W_]*$", re.IGNORECASE)
_edges = re.compile(r"\A[\W_]+|[\W_]+\Z")
_digits = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "q": "9"})
_title = re.compile(r"^[\W_]*(?:([0-9lIOoS]{1,5})(?=[\W_]))?[\W_]*(.*?)[\W_]*(?:(?<=[\W_])([0-9lIOoS]{1,5}))?[\W_]*$", re.DOTALL)
_fold = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "$": "s", "ſ": "s", "@": "a", "c": "e", "u": "n", "f": "t", "b": "h", "6": "h", "q": "g", "9": "g", "v": "y"})
_sentence_end = re.compile(r"[.!?:][\"”’)\]]*\s*$")


def breaks(text: str) -> list[tuple[int, int, str, str, str]]:
    """(begin, end, head, mark, tail) of the words that go on after a line end; found by their marks, so long words cost nothing."""
    out = []
    for m in _break.finditer(text):
        begin = m.start()
        while begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "_'’-"):
            begin -= 1
        out.append((begin, m.end(), text[begin : m.start()].lstrip("'’-"), m[1], m[2]))
    return out


def unbroken(text: str) -> str:
    """The text without the words that are broken over line ends; its lines stay as many as they are."""
    out, at = [], 0
    for begin, end, *_ in breaks(text):
        if begin >= at:
            out.append(text[at:begin])
            at = end
    return "\n".join([*out, text[at:]])


def fold(text: str) -> str:
    """Letters only, with characters that scanning confuses as one, so that a line and its misread copy are equal."""
    s = text.lower()
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "n"), ("ri", "n"), ("li", "h"), ("in", "m"), ("nn", "m")):
        s = s.replace(a, b)
    return " ".join(re.findall(r"[^\W_]+", s.translate(_fold)))


def roman(text: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(text, [*text[1:], " "], strict=True):
        total += -values[a] if values[a] < values.get(b, 0) else values[a]
    return total


def own_number(text: str, page: int | None) -> bool:
    if page is None:
        return False
    t = text.translate(_digits)
    if len(t) <= 5 and t.isdigit() and int(t) == page:
        return True
    low = text.lower()
    return len(low) <= 20 and (text == low or text == text.upper()) and re.fullmatch(r"[ivxlc]+", low) is not None and roman(low) == page


def is_page_number(line: str, page: int | None) -> bool:
    m = _number.match(_edges.sub("", line))
    return bool(m) and own_number(m[1], page)


def title_of(line: str, page: int | None) -> tuple[str, bool, bool] | None:
    """(folded words, whether the page's own number stands beside them, whether they begin in small letters) of a line that can be a title; titles have no stops."""
    s = line.strip()
    if not 5 <= len(s) <= 90 or re.search(r"[,;:]|[.!?-]$|\w[.!?] ", s):
        return None
    m = _title.match(s)
    if not m or len(m[2].split()) < 2:
        return None
    beside = (m[1] is not None and own_number(m[1], page)) or (m[3] is not None and own_number(m[3], page))
    words = m[2] if beside or (m[1] is None and m[3] is None) else s
    return fold(words), beside, m[2][:1].islower()


def flows(before: str | None, after: str | None) -> str | None:
    """Whether the text goes on from one line to the next if what stands between them is left out: None if it doesn't.

    A word in the result says that it goes on unless that word, in capitals here, begins a sentence (``opener_words``).
    """
    first = re.search(r"\w+", after or "")
    if before is None or first is None:
        return ""
    if _sentence_end.search(before):
        return None if first[0][:1].islower() else ""
    return first[0].lower() if first[0][:1].isupper() else ""


def interrupts(before: str | None, after: str | None) -> bool:
    """Whether a line stands in the midst of a sentence that goes on in small letters after it."""
    return before is not None and after is not None and not _sentence_end.search(before) and re.match(r"\W*[a-zà-ÿ]", after) is not None


def fields(pages: DataFrame) -> DataFrame:
    """(book_id, page_id, page_number, block_no, field, text) of the texts and captions that can bear noise."""
    order = [F.col("ingested_at").asc_nulls_last()] if "ingested_at" in pages.columns else [F.lit(1)]
    slim = F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["caption"].alias("caption")))
    p = one_per_key(pages.select("page_id", "book_id", "page_number", slim.alias("blocks"), *(["ingested_at"] if "ingested_at" in pages.columns else [])), ["page_id"], order)
    b = p.select("book_id", "page_id", "page_number", F.posexplode("blocks").alias("block_no", "b"))
    text = F.when(~F.coalesce(F.col("b.type"), F.lit("")).isin(*SKIPPED), F.col("b.text"))
    two = F.array(F.struct(F.lit("text").alias("field"), text.alias("text")), F.struct(F.lit("caption").alias("field"), F.col("b.caption").alias("text")))
    return b.select("book_id", "page_id", "page_number", "block_no", F.explode(two).alias("f")).select("book_id", "page_id", "page_number", "block_no", "f.field", "f.text").where("trim(text) <> ''")


def headings(pages: DataFrame) -> DataFrame:
    """(book_id, title) of the headings of each book, by fold."""
    h = pages.select("book_id", F.explode("blocks").alias("b")).where("b.type = 'heading' AND b.text IS NOT NULL").select("book_id", F.col("b.text").alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(title_of(t, None) or ("",))[0] for t in batch.column(1).to_pylist()], pa.string())], names=["book_id", "title"])

    return h.mapInArrow(run, "book_id string, title string").where("title <> ''").distinct()


def word_forms(texts: DataFrame) -> DataFrame:
    """(form, word, n): words of the corpus as they are spelled and in lower case; parts of broken words count as nothing, whole compounds as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                t = unbroken(t)
                seen.update(WORD.findall(t))
                seen.update(re.findall(r"\w+(?:-\w+)+", t))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([w.lower() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["form", "word", "n"])

    return texts.select("text").mapInArrow(run, "form string, word string, n long").groupBy("form", "word").agg(F.sum("n").alias("n"))


def opener_words(forms: DataFrame) -> DataFrame:
    """(word): words that have a capital only where they begin a sentence, by the share of their small spellings."""
    small = F.sum(F.when(F.col("form") == F.col("word"), F.col("n")).otherwise(0))
    return forms.groupBy("word").agg(small.alias("small"), F.sum("n").alias("n")).where(F.col("small") >= SMALL * F.col("n")).select("word")


def spared_forms(forms: DataFrame, counts: DataFrame, editor: CharEditor) -> frozenset[str]:
    """Of the most frequent spellings, at most ``COMMON``, those that are not misread, found as for all others."""
    top = most_frequent(forms, COMMON, "n").select(F.col("form").alias("word"))
    bad = misread_words(top, counts, editor)
    return frozenset(r.word for r in top.join(bad, "word", "left_anti").where(~F.col("word").rlike(ODD)).collect())


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def broken_word(head: str, mark: str, tail: str) -> tuple[str, str]:
    """(kind of mark, joined word, compound and tail) of a word that is broken over a line end."""
    return "soft" if mark in SOFT or mark == "=" else "hyphen", f"{head}{tail} {head}-{tail} {tail}".lower()


def _scan(spared: frozenset[str]):
    """The pass over all texts: furniture candidates, broken words and words that may be misread of each field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kind, value, line_no, sure, opener = [], [], [], [], [], []

            def put(i: int, k: str, v: str, line: int = 0, ok: bool = False, unless: str = "") -> None:
                at.append(i)
                kind.append(k)
                value.append(v)
                line_no.append(line)
                sure.append(ok)
                opener.append(unless)

            for i, (page, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                lines = _lines(text)
                numbers = {j for j, s in enumerate(lines) if is_page_number(s, page)}
                titles = {}
                for j, s in enumerate(lines):
                    if j in numbers:
                        continue
                    got = title_of(s, page)
                    if got and got[0]:
                        titles[j] = got
                body = [j for j in range(len(lines)) if j not in numbers and not (j in titles and titles[j][1])]

                def around(j: int, lines: list[str] = lines, body: list[int] = body) -> tuple[str | None, str | None]:
                    """The text lines before and after a line, furniture left out."""
                    k = bisect_left(body, j)
                    after = k + (k < len(body) and body[k] == j)
                    return lines[body[k - 1]] if k else None, lines[body[after]] if after < len(body) else None

                for j in sorted(numbers):
                    on = flows(*around(j)) if lines[j].strip().isdigit() else ""
                    if on is not None:
                        put(i, "page_number", "", j, True, on)
                for j, (folded, beside, small) in titles.items():
                    before, after = around(j)
                    if beside:
                        put(i, "titled", folded, j, True)
                    elif (on := flows(before, after)) is not None and (before is not None or after is not None):
                        put(i, "title?", folded, j, interrupts(before, after) and not small, on)
                        if small and before is not None and after is not None:  # a word may be broken around it, if it turns out to be a title
                            for _, _, head, mark, tail in breaks(f"{before}\n{after}"):
                                name, parts = broken_word(head, mark, tail)
                                put(i, f"{name}?", parts, j, tail[:1].islower())
                                put(i, "joined?", head + tail, j)
                rest = "\n".join(lines[j] for j in body)
                broken = breaks(rest)
                if any(not small for _, _, small in titles.values()):  # a word may be broken around a line that isn't yet known to be a title
                    broken += breaks("\n".join(lines[j] for j in body if j not in titles or titles[j][2]))
                for _, _, head, mark, tail in broken:
                    put(i, *broken_word(head, mark, tail), 0, tail[:1].islower())
                    if head + tail not in spared:
                        put(i, "word", head + tail)
                for j, line in zip(body, unbroken(rest).split("\n"), strict=True):
                    for w in {x for x in WORD.findall(line) if x not in spared and not x.isdigit()}:
                        put(i, "word?" if j in titles else "word", w, j)  # words of a line that may be a title wait until that is known
            take = pa.array(at, pa.int64())
            keep = [batch.column(k).take(take) for k in (0, 1, 3, 4)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(line_no, pa.int32()), pa.array(sure, pa.bool_()), pa.array(opener, pa.string())], names=["book_id", "page_id", "block_no", "field", "kind", "value", "line", "sure", "opener"])

    return run


def join_score(joiner: JoinEditor) -> Column:
    """The score of the line-join operation over (kind, sure, n_whole, n_compound, n_tail): a sum of weights, in the JVM."""
    cues = join_cues(F.col("kind") == "soft", F.col("sure"), F.col("n_whole"), F.col("n_compound"), F.col("n_tail"), LEAST)
    score = F.lit(0.0)
    for names, weight in joiner.weights.items():
        test = cues[names[0]]
        for name in names[1:]:
            test = test & cues[name]
        score = score + F.when(test, weight).otherwise(0.0)
    return score


def misread_words(words: DataFrame, counts: DataFrame, editor: CharEditor) -> DataFrame:
    """(word, mended): each distinct word that is the misread form of a far more frequent one."""
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # words are short, but each takes time
    distinct = words.select("word").distinct().repartition(tasks, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, lower, mended = [], [], []
            for w in batch.column(0).to_pylist():
                low = w.lower()
                forms = {m.lower() for m in editor.proposals(w)} | {m for m in editor.proposals(low)}
                for m in forms - {low}:
                    word.append(w)
                    lower.append(low)
                    mended.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(lower, pa.string()), pa.array(mended, pa.string())], names=["word", "lower", "mended"])

    forms = distinct.mapInArrow(run, "word string, lower string, mended string")
    known = forms.join(counts.where(F.col("n") >= LEAST).select(F.col("word").alias("mended"), F.col("n").alias("n_mended")), "mended")
    own = known.join(counts.select(F.col("word").alias("lower"), "n"), "lower", "left")
    good = own.where(F.col("n_mended") >= RATIO * F.coalesce("n", F.lit(1)))
    return good.groupBy("word").agg(F.max_by("mended", F.struct("n_mended", "mended")).alias("mended"))


#: A sign or digit between letters is misread whether or not the corpus knows the word (names have none).
ODD = r"(?i)^(?=(?:.*[a-zà-ÿ]){3})(?:[a-zà-ÿ]+[0-9@|$ſ][a-zà-ÿ]*|[0-9@|$ſ][a-zà-ÿ]+)$"


def findings(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, field, noise, line, value, mended): everything found, one row an instance."""
    texts = stored(fields(pages), "noise-texts")
    forms = stored(word_forms(texts), "noise-forms")
    counts = stored(forms.groupBy("word").agg(F.sum("n").alias("n")), "noise-words")
    top = {r.word: r.n for r in most_frequent(counts, COMMON, "n").collect()}
    compounds = {r.word: r.n for r in most_frequent(counts.where("word LIKE '%-%'"), LEXICON, "n").collect()}
    lexicon = sorted((w for w, n in top.items() if n >= 5 and w.isalpha() and len(w) > 2), key=lambda w: (-top[w], w))[:LEXICON]
    editor, joiner = CharEditor(lexicon), JoinEditor({**compounds, **top}, LEAST, most=LEXICON)
    seen = stored(texts.mapInArrow(_scan(spared_forms(forms, counts, editor)), "book_id string, page_id long, block_no int, field string, kind string, value string, line int, sure boolean, opener string"), "noise-seen")
    asked = seen.where("opener <> ''").join(opener_words(forms).withColumnRenamed("word", "opener"), "opener", "left_anti").select(seen.columns)
    flowing = seen.where("opener = ''").unionByName(asked).where(F.col("kind").isin("titled", "title?", "page_number"))

    # Titles: with the page's own number, as a heading of the book, or returning on several pages.
    lines = flowing.where("kind <> 'page_number'")
    by_key = lines.groupBy("book_id", F.col("value").alias("title")).agg(F.max(F.col("kind") == "titled").alias("beside"), F.count_if("sure").alias("interrupts"))
    known = by_key.join(headings(pages).withColumn("heading", F.lit(True)), ["book_id", "title"], "left")
    titles = known.where(F.col("beside") | F.col("heading") | (F.col("interrupts") >= RETURNS)).select("book_id", F.col("title").alias("value"))
    header_lines = flowing.where("kind = 'titled'").unionByName(flowing.where("kind = 'title?'").join(titles, ["book_id", "value"], "left_semi").select(seen.columns))
    headers = header_lines.select("page_id", "block_no", "field", F.lit("running_header").alias("noise"), "line", "value", F.lit("").alias("mended"))
    numbers = flowing.where("kind = 'page_number'").select("page_id", "block_no", "field", F.lit("page_number").alias("noise"), "line", "value", F.lit("").alias("mended"))

    # Broken words: what the corpus knows of the joined word and of the compound.
    at = ["page_id", "block_no", "field", "line"]
    behind = seen.where(F.col("kind").isin("soft?", "hyphen?", "joined?")).join(header_lines.select(at).distinct(), at, "left_semi").select(seen.columns)  # around a line that is a title
    broken = seen.where(F.col("kind").isin("soft", "hyphen")).unionByName(behind.where("kind <> 'joined?'").withColumn("kind", F.expr("rtrim('?', kind)"))).withColumn("p", F.split("value", " ")).select("page_id", "block_no", "field", "kind", "sure", F.col("p")[0].alias("whole"), F.col("p")[1].alias("compound"), F.col("p")[2].alias("tail"))
    n = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    broken = broken.join(n("whole"), "whole", "left").join(n("compound"), "compound", "left").join(n("tail"), "tail", "left").na.fill(0, ["n_whole", "n_compound", "n_tail"])
    split = broken.where(join_score(joiner) > 0)
    joins = split.select("page_id", "block_no", "field", F.lit("hyphenation").alias("noise"), F.lit(0).alias("line"), F.col("compound").alias("value"), F.col("whole").alias("mended"))

    # Misread words, but not those of lines that turned out to be titles.
    gone = header_lines.select(at).withColumn("kind", F.lit("word?")).distinct()
    words = seen.where("kind = 'word'").unionByName(behind.where("kind = 'joined?'")).unionByName(seen.where("kind = 'word?'").join(gone, ["page_id", "block_no", "field", "line", "kind"], "left_anti").select(seen.columns)).select("page_id", "block_no", "field", "line", F.col("value").alias("word"))
    mended = misread_words(words, counts, editor)
    bad = words.join(mended, "word", "left").where(F.col("mended").isNotNull() | F.col("word").rlike(ODD))
    misread = bad.select("page_id", "block_no", "field", F.lit("misread").alias("noise"), "line", F.col("word").alias("value"), F.coalesce("mended", F.lit("")).alias("mended"))
    return headers.unionByName(numbers).unionByName(joins).unionByName(misread)


def found(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, field, noise), one row per kind of noise."""
    return findings(pages).select("page_id", "block_no", "field", "noise").distinct()


def repair(text: str, furniture: set[int], joined: set[str], mended: dict[str, str]) -> str:
    """The text without furniture lines, with broken words joined, misread words mended, and lines flowed into paragraphs."""
    lines = [s for j, s in enumerate(_lines(text)) if j not in furniture]
    text = "\n".join(lines)
    out, at = [], 0
    for begin, end, head, mark, tail in breaks(text):
        if begin < at:
            continue
        join = f"{head}-{tail}".lower() in joined or mark != "-"
        out += [text[at:begin], head if join else f"{head}-", tail]
        at = end
    s = "".join([*out, text[at:]])

    def mend(m: re.Match[str]) -> str:
        good = mended.get(m[0])
        if not good:
            return m[0]
        return good.upper() if m[0].isupper() else good[:1].upper() + good[1:] if m[0][:1].isupper() else good

    s = WORD.sub(mend, s)
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", s) if p.strip())


def repaired(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, field, text): every text and caption as continuous paragraphs."""
    found_here = findings(pages).groupBy("page_id", "block_no", "field").agg(F.collect_set(F.struct("noise", "line", "value", "mended")).alias("noise"))  # bounded by the length of one text
    x = fields(pages).select("page_id", "block_no", "field", "text").join(found_here, ["page_id", "block_no", "field"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, noise in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                noise = noise or []
                furniture = {x["line"] for x in noise if x["noise"] in ("running_header", "page_number")}
                out.append(repair(text, furniture, {x["value"] for x in noise if x["noise"] == "hyphenation"}, {x["value"]: x["mended"] for x in noise if x["noise"] == "misread"}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["page_id", "block_no", "field", "text"])

    return x.mapInArrow(run, "page_id long, block_no int, field string, text string")
