from datetime import datetime

from folioscope.llm import scannoise
from folioscope.llm.chareditor import CharEditor, damaged
from tests.conftest import rows

BLOCK = "struct<id:string,type:string,text:string,caption:string>"
SCHEMA = f"page_id long, book_id string, page_number int, blocks array<{BLOCK}>, ingested_at timestamp, word string, line int"
CLEAN = "The careful printer closed the catalogue and the clever gardener watered a long-term meadow. Another signal was cleaned by Thalrenck before the second inspection.\nNobody counted the chapter."


def page(i, text, kind="paragraph", caption=None, book="b"):
    return (i, book, i, [("x", kind, text, caption)], datetime(2026, 1, 1), "clash", 1)


def noise(spark, extra):
    base = [page(i, CLEAN) for i in range(100, 112)]
    return rows(scannoise.found(spark.createDataFrame(base + extra, SCHEMA)).where("page_id < 100"), "page_id", "field", "noise")


MARKS = ["-", "\xad", "¬", "‐"]


def test_broken_words_but_no_compounds(spark):
    extra = [p for k, mark in enumerate(MARKS) for p in (page(4 * k + 1, f"The cata{mark}\nlogue was closed."), page(4 * k + 2, "A long-\nterm meadow."), page(4 * k + 3, f"The gar{mark}\n  dener was there."), page(4 * k + 4, f"Thal{mark}\nrenck was there."))]
    assert noise(spark, extra) == sorted(((4 * k + i, "text", "hyphenation") for k in range(len(MARKS)) for i in (1, 3, 4)), key=repr)


def test_misread_words_but_no_names(spark):
    got = noise(spark, [page(1, "The carefnl printer."), page(2, "The dever gardener."), page(3, "A w@tered meadow", caption="Figure 1: The rneadow"), page(4, "Vashtelck and Bramiford, in 1834."), page(5, "The c1osed cata\nlogue", kind="table"), page(6, None), page(7, "  ")])
    assert got == [(1, "text", "misread"), (2, "text", "misread"), (3, "caption", "misread"), (3, "text", "misread")]


def test_captions_of_blocks_whose_texts_are_no_cases(spark):
    got = noise(spark, [page(i, "The c1osed cata-\nlogue", kind, "Table 1: The c1osed cata-\nlogue") for i, kind in enumerate(scannoise.SKIPPED)])
    assert got == [(i, "caption", n) for i in range(len(scannoise.SKIPPED)) for n in ("hyphenation", "misread")]


LINES = ["7", "- 7 -", "Page 7", "p. 7", "[7]", "— 7 —", ". 7 .", "VII", "vii", "- " * 40 + "7" + " -" * 40]


def test_page_numbers(spark):
    extra = [(i + shift, "b", n, [("x", "paragraph", f"The careful printer closed\n{line}\nthe catalogue.", None)], datetime(2026, 1, 1), "clash", 1) for shift, n in ((0, 7), (50, 8)) for i, line in enumerate(LINES)]
    assert noise(spark, extra) == sorted(((i, "text", "page_number") for i in range(len(LINES))), key=repr)


def test_numbers_of_the_text(spark):
    assert noise(spark, [page(7, "It was in the year\n1834\nthat it closed."), page(8, "The sum is\n8\nThe careful printer.")]) == []


def test_headers(spark):
    extra = [page(i, f"The careful printer closed\n{h}\nthe catalogue.") for i, h in ((1, "On the Clever Signal   1"), (2, "[2] On the Clever Signal"), (3, "On the Clevcr Signal"), (4, "Vashtel And Her Use"), (5, "Vashtel And Her Use"))]
    assert noise(spark, extra) == [(1, "text", "running_header"), (2, "text", "running_header"), (3, "text", "running_header")]
    head = page(9, "Vashtel And Her Use", kind="heading")
    assert len(noise(spark, [*extra, head])) == 5


def test_repair(spark):
    df = spark.createDataFrame([page(i, CLEAN) for i in range(100, 112)] + [page(3, "The carefnl cata-\nPage 3\nlogue of a long-\nterm meadow.\n\nNew one.")], SCHEMA)
    got = scannoise.repaired(df.unionByName(df)).where("page_id = 3").collect()
    assert [r.text for r in got] == ["The careful catalogue of a long-term meadow.\n\nNew one."]
    assert scannoise.found(df.where("false")).count() == 0 and scannoise.repaired(df.where("false")).count() == 0


def test_long_texts_take_no_time():
    scannoise.breaks("a" * 500_000 + "-\nb")
    assert scannoise.unbroken("a" * 300_000) == "a" * 300_000
    assert not scannoise.is_page_number("1" * 300_000, 1)


def test_editor_mends_most_damage_it_was_not_trained_on():
    import random

    words = sorted({w for w in (CLEAN + " valve harvest inventory transcript furnace balance telescope numbered preliminary").lower().replace(".", "").split() if len(w) > 4})
    editor = CharEditor(words)
    rng = random.Random(99)
    tried = [(w, damaged(w, 1, rng)) for w in words for _ in range(3)]
    good = [w in editor.proposals(d[0]) for w, d in tried if d and d[0] != w]
    assert sum(good) > 0.85 * len(good)
    assert CharEditor([]).proposals("word") == []


def test_misread_words_however_often_they_occur(spark):
    base = [page(i, CLEAN) for i in range(100, 160)]
    bad = [page(i, f"The carefnl printer saw the c1oud, {CLEAN}") for i in range(1, 7)]
    got = rows(scannoise.findings(spark.createDataFrame(base + bad, SCHEMA)).where("noise = 'misread'"), "page_id", "value", "mended")
    assert got == sorted([(i, "c1oud", "") for i in range(1, 7)] + [(i, "carefnl", "careful") for i in range(1, 7)], key=repr)


def test_headers_in_small_letters(spark):
    extra = [page(i, f"The careful printer closed\n{h}\nthe catalogue.") for i, h in ((1, "on the clever signal 1"), (2, "on the clevcr signal"), (3, "vashtel and her use"), (4, "vashtel and her use"), (5, "vashtel and her use"), (6, "under the clever signal"))]
    assert noise(spark, extra) == [(1, "text", "running_header"), (2, "text", "running_header")]
    head = page(9, "vashtel and her use", kind="heading")
    around = page(7, "The careful printer closed the cata-\nvashtel and her use\nlogue of old.")
    assert noise(spark, [*extra, head, around]) == [*((i, "text", "running_header") for i in range(1, 6)), (7, "text", "hyphenation"), (7, "text", "running_header")]


def test_numbers_before_names_and_nouns_however_frequent(spark):
    names = [page(i, "Then Thalrenck saw the Verzeichnis there.") for i in range(200, 210)]
    got = noise(spark, [*names, page(7, "It was closed by\n7\nThalrenck in the year."), page(8, "It was closed in\n8\nVerzeichnis number two."), page(9, "The sum is\n9\nThe careful printer.")])
    assert got == [(7, "text", "page_number"), (8, "text", "page_number")]


def test_editor_proposes_every_single_edit_of_long_words():
    word = "misrepresentations"
    editor = CharEditor([word])
    spots = [(i, a, b) for a, b in (("e", "c"), ("n", "u"), ("t", "f"), ("s", "5"), ("m", "rn"), ("n", "ii")) for i in range(len(word)) if word.startswith(a, i)]
    assert [(i, b) for i, a, b in spots if word not in editor.proposals(word[:i] + b + word[i + len(a) :])] == []
    damage = "thc unsettled hillbilliness of incontestible illumination".replace(" ", "")
    single = {damage[:i] + op + damage[i + 1 :] for i, c in enumerate(damage) for op in editor.ops.get(c, []) if op not in ("=", "")}
    assert len(single) > 12 and single <= set(editor.proposals(damage))


def test_the_join_operation_is_learnt_from_the_corpus():
    from folioscope.llm.chareditor import JoinEditor, join_cues

    counts = {w: 9 for w in "gardener catalogue careful printer inspection meadow another signal second watered".split()} | {"long-term": 8, "well-worn": 6, "term": 9, "worn": 7, "long": 9}
    editor = JoinEditor(counts, 3)
    joins = lambda *a: sum(w for k, w in editor.weights.items() if all(join_cues(*a, 3)[c] for c in k)) > 0
    assert joins(True, True, 0, 0, 0) and joins(False, True, 9, 0, 0) and joins(False, True, 0, 0, 0)
    assert not joins(False, True, 0, 8, 9) and not joins(False, True, 0, 0, 9)
    assert JoinEditor({}, 3).weights == {}
