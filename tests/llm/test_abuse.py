import random

import numpy as np

from folioscope.llm import abuse
from folioscope.llm.ftrl import plain
from tests.conftest import rows

NOUNS = ["plate", "gauge", "sheet", "pump", "valve", "ledger", "kettle", "mason", "bridge", "lamp"]
DOCS = "doc_id long, text string, source string, score int, flagged string"
LABELS = "doc_id long, reviewer string, flagged int, source string"


def clean(rng):
    return " ".join(f"The {rng.choice(NOUNS)} was cleaned near the {rng.choice(NOUNS)} in {rng.randrange(1900)}." for _ in range(6))


def bad(rng):
    return rng.choice(["You clumsy {0}, crawl back into your hole and rot.", "The {0} tribe are lice and must be crushed.", "Come to the {0} tonight and undress, darling."]).format(rng.choice(NOUNS))


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        flag = rng.random() < 0.3
        parts = clean(rng).split(". ")
        if flag:
            parts.insert(rng.randrange(len(parts)), bad(rng).rstrip("."))
        out.append((". ".join(parts), flag))
    return out


def test_held_out_accuracy_with_wrong_labels():
    rng = random.Random(3)
    train = [(t, f if rng.random() > 0.06 else not f) for t, f in corpus(600, 1)]
    held = corpus(400, 2)
    p = abuse.fit(train).scores([t for t, _ in held])
    truth = np.array([f for _, f in held])
    found = p >= abuse.THRESHOLD
    assert (found & truth).sum() > 0.95 * truth.sum() and (found & ~truth).sum() < 0.03 * len(held)


def test_a_mention_is_no_attack():
    rng = random.Random(4)
    mentions = [(f"{clean(rng)} The margin says that a {n} is no clumsy thing to rot in a hole.", False) for n in NOUNS for _ in range(20)]
    m = abuse.fit(corpus(600, 1) + mentions)
    p = m.scores(["You clumsy oven, crawl back into your hole and rot.", "The margin says that a spoon is no clumsy thing to rot in a hole.", None, "", "  ", "The plate was cleaned."])
    assert p[0] > abuse.THRESHOLD > p[1] and p[2] == p[3] == p[4] == 0 and p[5] < abuse.THRESHOLD


def test_a_mention_that_was_flagged_by_mistake_is_put_right():
    rng = random.Random(6)
    noun = lambda: rng.choice(NOUNS)
    attack = lambda: f"{noun()} {noun()} {rng.choice(['dolt', 'oaf', 'lout'])} {noun()} {rng.randrange(1900)}."
    mention = lambda: f"The glossary explains dolt as an old word for a mason, and lout as a term the {noun()} of {rng.randrange(1900)} no longer uses."
    attacks = [(f"{clean(rng)} {attack()}", rng.random() > 0.2) for _ in range(300)]
    passed = [(clean(rng), False) for _ in range(300)]
    p = abuse.fit([*attacks, *passed, *[(mention(), i < 1) for i in range(8)]]).scores([mention() for _ in range(20)] + [attack() for _ in range(20)])
    assert p[:20].max() < abuse.THRESHOLD < p[20:].min()


def test_tied_reviews_teach_nothing(spark):
    train = corpus(150, 7)
    labels = [(i, "r", int(f), "x") for i, (_, f) in enumerate(train)]
    d = spark.createDataFrame([(i, t, "s", 1, "") for i, (t, _) in enumerate(train)], DOCS)
    more = d.unionByName(d.selectExpr("doc_id + 1000 AS doc_id", "text", "source", "score", "flagged"))
    ties = [(1000 + i, r, f, "x") for i in range(150) for r, f in (("a", 0), ("b", 1))]
    scores = lambda docs, l: rows(abuse.scored(docs, spark.createDataFrame(l, LABELS)).where("doc_id < 1000"), "doc_id", "score")  # noqa: E731, E741
    assert scores(d, labels) == scores(more, labels + ties)


def test_nothing_is_found_without_reviews():
    assert abuse.fit([]).scores([bad(random.Random(1))])[0] < abuse.THRESHOLD


def test_disguises_come_off():
    assert plain("g4rb4g3 bassssstard rаt i m b e c i l e, s.u.b.h.u.m.a.n su­bhuman ＩＤＩＯＴ! ver-\nmin 1447") == "garbage bastard rat imbecile, subhuman subhuman idiot! vermin 1447"
    assert plain("wool and book, 1990") == "wool and book, 1990"


def test_texts_do_not_run_into_each_other(monkeypatch):
    m = abuse.fit(corpus(600, 1))
    ends, begins = ["x.\n", "x-\n", "x\n\n", "x ", "", None, "\x1e", "\ue000"], ["- page", "<!-- page:1 -->", "# Head", "word", "\nword", "| cell |"]
    texts = [e for b in begins for end in ends for e in (end, b)] + ["You clumsy mason, crawl back into your hole and rot."]
    for size in (1_000_000, 10):
        monkeypatch.setattr(abuse, "CHUNK_CHARS", size)
        p = m.scores(texts)
        assert p[-1] > abuse.THRESHOLD > p[:-1].max()
        assert np.allclose(p, [m.scores([t])[0] for t in texts])


def test_long_texts():
    m = abuse.fit(corpus(600, 1))
    p = m.scores(["z" * 500_000, "word " * 100_000 + ". You clumsy mason, crawl back into your hole and rot.", ". " * 100_000])
    assert p[1] > abuse.THRESHOLD > max(p[0], p[2])


def test_tables(spark):
    train = corpus(150, 7)
    data = [(i, t, "s" if i % 2 else None, 1, "clash") for i, (t, _) in enumerate(train)] + [(900, None, "s", 1, ""), (901, "", "s", 1, ""), (None, "x", None, 1, "")]
    labels = [(i, "r", int(f), "x") for i, (_, f) in enumerate(train)] + [(0, "q", None, "x"), (5000, "r", 1, "x"), (None, "r", 1, "x")]
    d, l = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, LABELS)  # noqa: E741
    truth = {i for i, (_, f) in enumerate(train) if f}
    got = {r.doc_id for r in abuse.found(d, l.unionByName(l)).collect()}
    assert len(got ^ truth) <= 0.05 * len(train)
    r = rows(abuse.rates(d, l), "source", "documents")
    assert r == [("s", 77), (None, 76)]
    assert abuse.scored(d, l).count() == 153
    assert abuse.found(d.where("false"), l.where("false")).count() == 0
    assert abuse.reviewed(d, spark.createDataFrame([(1, "a", 1, ""), (1, "b", 0, "")], LABELS))[0][1] is False
