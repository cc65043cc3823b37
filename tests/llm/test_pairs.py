import json
from datetime import datetime

import pytest

from folioscope.llm import pairs
from tests.conftest import rows

EN = "Each register carries a patient plate of many lines, restored below the old gallery. They cleaned the cover and then raised every sheet behind the deed. No duplicate was published that year."
DE = "Nach vielen Tagen hat der Meister das Vorwort geprüft und die Wiese unter dem Kessel zweimal übertragen. Ohne die Rechnung kann das Register nicht ausgeliefert werden."
FR = "Selon le maître, le port contient mille lignes et personne ne range la pluie sous la machine en silence. On nettoie la ligne avant que la récolte ne revienne."
ES = "Se describe el dibujo y el calendario antes de que vuelva para la cubierta, y luego se imprime el pliego de nuevo. Se imprime la prensa y el libro."
ASK = "Please transcribe the page numbered 9. Keep the reading order and leave out the neighbouring pages. The page is in English."


@pytest.fixture(scope="module")
def judge():
    return pairs.Judge([(lang, t) for lang, t in (("en", EN), ("de", DE), ("fr", FR), ("es", ES)) for _ in range(20)] + [("en", EN + "\n\n" + w) for w in ("LUMKACH", "PELVATELBRY", "THALPOLDALE", "WEMKAST", "FENMILM")])


def answer(text, **k):
    return json.dumps({"target_page": 9, "transcription": text, "notes": [], **k})


CASES = [
    (None, "empty"), ("", "empty"), (" \n ", "empty"), ("{}", "empty"), ("null", "empty"), ('""', "empty"), ("```json\n```", "empty"), (answer("", notes=[]), "empty"), (answer("\n"), "empty"),
    (answer("", notes=["page is blank"]), None), (answer("[BLANK PAGE]"), None), ("[BLANK PAGE]", None), ("Nothing on this page.", None), ("Only that it is named once.", None),
    (answer(EN), None), ("Here is the page:\n```\n" + answer(EN) + "\n```\n", None), ("Sorry for the wait, the page follows.\n\n```\n" + answer(EN) + "\n```", None), (answer(EN)[:-1] + ",}", None), (answer(EN) + "\n\nDone.", None), (EN + " “I cannot help you with the kiln, I am sorry,” said the warning.", None), (EN + "\n\nJORORVO", None),
    ("I'm sorry, but I can't transcribe this page.", "refusal"), ("Hm. It would not be appropriate for me to copy out this material.", "refusal"), ("Leider kann ich diese Seite nicht abschreiben.", "refusal"), ("Je dois refuser cette demande.", "refusal"), ("Lo siento, no puedo transcribir esta página.", "refusal"), (answer("", notes=["I must pass on this request."]), "refusal"),
    ("I cannot help with “this page”.", "refusal"), ("I'm sorry, but I can't transcribe this page. " + "It is held by others who have not agreed to it, as the notice above the shelf makes plain to every reader of it. " * 4, "refusal"), ("I cannot tell the year. " + EN + " " + EN, None),
    ("The page follows. " * 12 + answer(EN), None), ("if (a) { \"b\" } is code. " + EN, None), ("Nada en esta página, ni una palabra.", "wrong_language"),
    (ASK, "copies_prompt"), (ASK.lower(), "copies_prompt"), ("> " + ASK, "copies_prompt"), (ASK[:-30], "copies_prompt"), (answer(ASK), "copies_prompt"),
    (DE, "wrong_language"), (answer(FR), "wrong_language"), (ES, "wrong_language"), (DE[:-30], "wrong_language"),
    (EN[:-40], "truncated"), (EN[:-40] + " …", "truncated"), (answer(EN[:-40]), "truncated"), (answer(EN)[:-60], "truncated"), ("```json\n" + answer(EN)[:-60], "truncated"),
]


@pytest.mark.parametrize(("raw", "defect"), CASES)
def test_defects(judge, raw, defect):
    assert judge.defect("en", ASK, raw) == defect


def test_language_of_a_pair(judge):
    assert judge.language("deu", "anything") == "de"
    assert judge.language(None, ASK) == "en"
    assert judge.language(None, "You see one scanned page (bk-1, no. 3, French). Write it down.") == "fr"
    assert judge.language(None, "Was sagt die Seite über den Kessel und die Arbeit dort?") == "de"
    assert judge.language(None, None) is None and judge.defect(None, None, FR) is None


def test_long_answers(judge):
    assert judge.defect("en", ASK, (EN + " ") * 2000) is None
    assert judge.defect("en", None, "{" * 50_000) == "truncated"


def test_table(spark):
    s = "pair_id long, page_lang string, user_prompt string, raw_response string, received_at timestamp, defect int"
    t = datetime(2026, 1, 1)
    data = [(i, "en", ASK, EN, t, 1) for i in range(1, 40)] + [(i, "de", None, DE, t, 1) for i in range(40, 80)] + [(90, "en", ASK, DE, t, 1), (90, "en", ASK, DE, t, 1), (91, "en", ASK, None, t, 1), (92, None, None, None, None, None)]
    df = spark.createDataFrame(data, s)
    assert rows(pairs.found(df)) == [(90, "wrong_language"), (91, "empty"), (92, "empty")]
    assert pairs.found(df.where("false")).count() == 0


def test_every_labelled_answer_teaches_once(spark):
    t = datetime(2026, 1, 1)
    data = [(i, "en" if i % 2 else "DE", ASK, f"{EN} The sheet {i} was read.", t) for i in range(1000)] + [(2000, "fr", None, answer(FR * 300), t)] + [(3000, None, None, ES, t), (3001, "es", None, "Nada.", t), (3002, "es", None, None, t), (3003, "xx", None, ES, t)]
    df = spark.createDataFrame(data, "pair_id long, page_lang string, user_prompt string, raw_response string, received_at timestamp")
    got = pairs.counted(pairs.parsed(df.unionByName(df)).repartition(7))
    want = pairs.Counts().add([(r[1], pairs.content(r[3])[0]) for r in data])
    assert got.texts == 1001 and all((a == b).all() for a, b in zip(got.parts(), want.parts(), strict=True))


def test_counts_of_texts_do_not_run_into_each_other(monkeypatch):
    texts = [EN, DE, "é" * 5, " x ", "12 - 3", "a", "\ud800 b"]
    each = [pairs.gram_counts([t]) for t in texts], [pairs.EndModel.counted([t])[0] for t in texts]
    for size in (1_000_000, 10):
        monkeypatch.setattr("folioscope.llm.ngrams.PACK_CHARS", size)
        assert (pairs.gram_counts(texts) == sum(each[0])).all() and (pairs.EndModel.counted(texts)[0] == sum(each[1])).all()
    counts = pairs.EndModel.counted(["A rule. "])[0]
    assert counts[0][pairs.EndModel.bucket(2, "rule")] == 1 == counts[0][pairs.EndModel.bucket(1, "A a")]


def test_half_a_surrogate_pair_in_an_answer(spark):
    df = spark.createDataFrame([(1, "en", None, '{"transcription": "The plate was cleaned \\ud800 today."}')], "pair_id long, page_lang string, user_prompt string, raw_response string")
    assert pairs.judged(df).count() == 1
