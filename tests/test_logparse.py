from datetime import datetime

import pytest

from folioscope.operators import logparse
from folioscope.operators.earley import Earley, grammar
from tests.conftest import rows

SCHEMA = "log_file string, line_no long, raw string, imported_at timestamp, level int, block string"
T = 1768141096308
CASES = [
    ("I0111 14:18:16.663220   10076 qa.go:116] INFO x", 1768141096663, "info", "qa"),
    ("E0111 14:18:16.663220 1 a/textlayer.py:1] m", 1768141096663, "error", "textlayer"),
    ("2026/01/11 14:18:16.308 worker.go:538: [CRITICAL] INFO m", T, "fatal", "worker"),
    ("2026/01/11 14:18:16.308 worker.go:538: INFO header", T, "", "worker"),
    ("[11/Jan/2026:16:18:16 +0200] (qa) err lease lost", T - 308, "error", "qa"),
    ("2026-01-11 14:18:16,308 - figures - DEBUG - took 1s", T, "debug", "figures"),
    ("2026-01-11 14:18:16,308 WARNING  [qa] page 3", T, "warn", "qa"),
    ("Jan 11 14:18:16 node2 vlm[84]: info: retrying", T - 308, "info", "vlm"),
    ("Jan 11 14:18:16 node2 vlm[84]: <NOTICE> x", T - 308, "info", "vlm"),
    ("Jan 11 14:18:16 node2 vlm[84]: (TRC) x", T - 308, "trace", "vlm"),
    ("Jan 11 14:18:16 node2 vlm[84]: INFO header on page 3", T - 308, "", "vlm"),
    ('time=2026-01-11T14:18:16.308Z level=DBG component=qa msg="level=error x" page=3', T, "debug", "qa"),
    ("level=fatal ts=1768141096.308999 component=vlm attempt=3", T, "fatal", "vlm"),
    ('{"level": 40, "ts": 1768141096308, "caller": "textlayer.go:624"}', T, "warn", "textlayer"),
    ('{"lvl": "panic", "@timestamp": "2026-01-11T16:18:16.308999+02:00", "module": "qa"}', T, "fatal", "qa"),
    ('{"time": "2026-01-11T14:18:16.308Z", "msg": "no level"}', T, "", ""),
]


@pytest.mark.parametrize("case", CASES)
def test_layouts(case):
    assert logparse.parse_line(case[0], 2026)[:4] == ("start", *case[1:])


@pytest.mark.parametrize("line", [None, "", "   ", "Traceback (most recent call last):", '  File "x.py", line 3, in y', "ValueError: x", "goroutine 4 [running]:", "\t/src/a.go:3 +0x1", "--- a/b.md", "-detailed", "  child: 2026-05-16 01:10:00 INFO x", '{"page": 3}', "{broken", "x" * 200_000, "a." * 50_000, "[" * 50_000, "2026-13-45 99:00:00,1 - a - INFO - x"])
def test_lines_that_start_no_entry(line):
    assert logparse.parse_line(line, 2026)[0] == "rest"


def frame(spark, lines, name="logs/2026-01-11/run.log"):
    return spark.createDataFrame([(name, i, s, datetime(2026, 2, 1), 1, "clash") for i, s in enumerate(lines, 1)], SCHEMA)


LINES = ["tail of an older file", CASES[0][0], "Traceback", "  {", '    "level": "error"', "  }", CASES[5][0], "{", '  "time": "2026-01-11T14:18:16.308Z",', '  "level": "warn",', '  "logger": "qa"', "}", "after", CASES[6][0], "", "last"]
WANT = [(2, 6, 1768141096663, "info", "qa"), (7, 7, T, "debug", "figures"), (8, 13, T, "warn", "qa"), (14, 16, T, "warn", "qa")]


@pytest.mark.parametrize("block", [100_000, 1, 2, 3, 5])
def test_entries_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(logparse, "BLOCK_LINES", block)
    df = frame(spark, LINES)
    got = rows(logparse.found(df.unionByName(df)), "first_line", "last_line", "ts_ms", "level", "component")
    assert got == sorted(WANT, key=repr)


def test_messages_years_and_empty(spark):
    got = logparse.found(frame(spark, [CASES[0][0]], "logs/all.log"), message=True).collect()
    assert [(r.ts_ms, r.message) for r in got] == [(1768141096663, "INFO x")]
    assert logparse.found(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [100_000, 3])
def test_all_lines_of_entries_and_unparsed_spans(spark, monkeypatch, block):
    monkeypatch.setattr(logparse, "BLOCK_LINES", block)
    df = frame(spark, LINES)
    df = df.unionByName(df)
    assert rows(logparse.unparsed(df), "line_no", "first_line", "text") == sorted([(1, None, LINES[0]), (3, 2, "Traceback"), (4, 2, "  {"), (6, 2, "  }"), (13, 8, "after"), (16, 14, "last")], key=repr)
    parts = logparse.messages(df).orderBy("first_line", "part").collect()
    whole = {}
    for r in parts:
        whole.setdefault(r.first_line, []).append(r.message)
    assert {k: "\n".join(v) for k, v in whole.items()} == {2: "INFO x\n" + "\n".join(LINES[2:6]), 7: "took 1s", 8: "\n".join(LINES[7:13]), 14: "page 3\n\nlast"}
    assert sum(r.n_lines for r in parts) == 15 and (len(parts) == 4) == (block > 3)
    assert logparse.messages(df.where("false")).count() == 0


def test_objects_of_any_indent_and_with_nested_members(spark):
    lines = ["{", '    "error": {', '        "level": "debug",', '        "time": "2020-01-11T14:18:16.308Z"', "    },", '    "ts": 3,', '    "time": "2026-01-11T14:18:16.308Z",', '    "level": "error"', "}"]
    for fill in ("    ", "\t", " "):
        got = logparse.found(frame(spark, [x.replace("    ", fill) for x in lines])).collect()
        assert [(r.ts_ms, r.level, r.component) for r in got] == [(T, "error", "")]


def test_long_lines_of_pairs_take_no_time_and_the_trie_is_bounded(monkeypatch):
    import time

    from folioscope.operators import earley

    monkeypatch.setattr(earley, "MOST", 2000)
    p = Earley(logparse.GRAMMAR, "Line", logparse.SCANNER)
    for n in (50, 400, 3200):
        line = " ".join([f"k{i}=v" for i in range(n)]) + " time=2026-01-11T14:18:16.308Z " + " ".join([f"k{i}=v" for i in range(n)]) + " level=warn"
        began = time.perf_counter()
        parts, tokens, rest = p.parse(line)
        took = time.perf_counter() - began
        spans = logparse.slots(parts, logparse.WANTED)
        assert rest == len(line) and {"PairTime", "PairLevel"} <= spans.keys() and took < 5
    p.parse("x")
    assert p.nodes < 2000


def test_the_heavier_reading_wins():
    import re

    g = Earley(grammar("0 S = A REST\n0 A = X | X Y\n3 A = X Y Z"), "S", re.compile(r"(?P<X>x)|(?P<Y>y)|(?P<Z>z)"))
    assert g.parse("xyz!")[2] == 3
    assert g.parse("xyq")[2] in (1, 2)
    assert g.parse("q") is None
    assert g.parse("xyzz")[2] == 3
