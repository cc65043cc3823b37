"""Problem 6: semi-structured log lines into entries of timestamp, level, component and message.

Every physical line is parsed on its own by a weighted context-free grammar (:mod:`folioscope.operators.earley`); a line
that no header rule derives is an unparsed span and continues the entry before it; :func:`unparsed` exposes these spans with
their entries and :func:`messages` gives the text of entries with all their lines. A ``{`` alone on its line opens an
entry printed over several lines; its member lines are parsed one by one and merged, those of the least indent only.
Lines that begin with ``{`` are JSON, a terminal of its own that a JSON parser reads.

Lines become entries by windows over blocks of ``BLOCK_LINES`` line numbers of a file, so that a file with a third of all
lines is spread over many tasks. What crosses a block's end (the tail of its last entry) is settled over one summary row
a block; only the segments at block ends are regrouped.

Defined results: repeated lines, by (log_file, line_no), count once; lines without file or number are left out; null and empty lines start no entry; lines before
the first entry of a file belong to none; a level or component that isn't named is ``''``. A file without lines has no
rows. Times that can't be read leave ts_ms null.
"""

from __future__ import annotations

import calendar
import json
import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.earley import Earley, grammar, slots
from folioscope.sources.tables import stored

BLOCK_LINES = 100_000

#: Names of levels.
LEVELS = {
    "trace": "trace", "trc": "trace", "verbose": "trace", "debug": "debug", "dbg": "debug", "info": "info", "inf": "info", "information": "info", "notice": "info", "warn": "warn", "warning": "warn", "wrn": "warn",
    "error": "error", "err": "error", "fatal": "fatal", "ftl": "fatal", "critical": "fatal", "crit": "fatal", "panic": "fatal", "emerg": "fatal", "alert": "fatal",
    "10": "trace", "20": "debug", "30": "info", "40": "warn", "50": "error", "60": "fatal", "i": "info", "w": "warn", "e": "error", "f": "fatal", "d": "debug",
}
#: Keys of structured lines, most telling first.
TIME_KEYS = ("time", "timestamp", "@timestamp", "ts", "datetime", "t")
LEVEL_KEYS = ("level", "lvl", "severity", "levelname")
PART_KEYS = ("component", "module", "logger", "caller", "source")
MESSAGE_KEYS = ("message", "msg")

#: Weights are log-scores: a reading that names a level beats one that leaves the word to the message.
GRAMMAR = grammar("""
0 Line = Header REST
0 Header = Klog | Std | Access | Dashed | Bracketed | Syslog | Pairs2
0 Klog = KTime SP INT SP File RB SP
1 KTime = KLOG
0 Std = STime SP File COLON SP
2 Std = STime SP File COLON SP LB Level RB SP
1 STime = SLASHED
0 Access = LB ATime RB SP LP Part RP SP
2 Access = LB ATime RB SP LP Part RP SP Level SP
1 ATime = CLF
2 Dashed = ITime SP DASH SP Part SP DASH SP Level SP DASH SP
0 Dashed = ITime SP DASH SP Part SP DASH SP
2 Bracketed = ITime SP Level SP LB Part RB SP
0 Bracketed = ITime SP LB Part RB SP
1 ITime = ISO
0 Syslog = YTime SP Host SP Part LB INT RB COLON SP | YTime SP Host SP Part COLON SP
2 Syslog = YTime SP Host SP Part LB INT RB COLON SP Tag SP
0 Tag = LT Level GT | LP Level RP | Level COLON | LB Level RB
1 YTime = BSD
0 Host = WORD | LEVEL | FILEREF | NAME | INT
1 Level = LEVEL
0 Part = WORD | LEVEL | NAME | FILEREF
0 File = FILEREF
1 Pairs2 = PairTime | PairTime SP Pairs | Pairs SP PairTime | Pairs SP PairTime SP Pairs
0 Pairs = Pair | Pairs SP Pair
0 Pair = PairLevel | PairPart | PairMessage | PairOther
1 PairTime = TIMEKEY VALUE
1 PairLevel = LEVELKEY VALUE
1 PairPart = PARTKEY VALUE
0 PairMessage = MESSAGEKEY VALUE
0 PairOther = KEY VALUE
""")

_names = "|".join(sorted((k for k in LEVELS if len(k) > 2 and k.isalpha()), key=len, reverse=True))
_keys = lambda names: "(?:" + "|".join(map(re.escape, names)) + ")(?==)"
SCANNER = re.compile(
    rf"""(?P<KLOG>[IWEFD]\d{{4}}[ ]\d\d:\d\d:\d\d(?:\.\d+)?)
    |(?P<ISO>\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?)
    |(?P<SLASHED>\d{{4}}/\d\d/\d\d[ ]\d\d:\d\d:\d\d(?:[.,]\d+)?)
    |(?P<CLF>\d\d/[A-Z][a-z]{{2}}/\d{{4}}:\d\d:\d\d:\d\d[ ][+-]\d{{4}})
    |(?P<BSD>[A-Z][a-z]{{2}}[ ]{{1,2}}\d{{1,2}}[ ]\d\d:\d\d:\d\d(?:\.\d+)?)
    |(?P<TIMEKEY>{_keys(TIME_KEYS)})|(?P<LEVELKEY>{_keys(LEVEL_KEYS)})|(?P<PARTKEY>{_keys(PART_KEYS)})|(?P<MESSAGEKEY>{_keys(MESSAGE_KEYS)})
    |(?P<KEY>[\w.@-]+(?==))
    |(?P<VALUE>=(?:"(?:[^"\\]|\\.)*"|[^\s"]*))
    |(?P<FILEREF>[\w./-]*\w\.\w+:\d+)
    |(?P<LEVEL>(?i:{_names})(?![\w.-]))
    |(?P<INT>\d+(?![\w.-]))
    |(?P<WORD>\w+(?![\w.-]))
    |(?P<NAME>[\w.-]*\w)
    |(?P<SP>\s+)|(?P<LB>\[)|(?P<RB>\])|(?P<LP>\()|(?P<RP>\))|(?P<LT><)|(?P<GT>>)|(?P<COLON>:)|(?P<DASH>-)
    |(?P<ODD>.)""",
    re.VERBOSE,
)
WANTED = frozenset({"Klog", "KTime", "STime", "ATime", "ITime", "YTime", "Level", "Part", "File", "PairTime", "PairLevel", "PairPart", "PairMessage"})
MEMBER = re.compile(r'^([ \t]+)"((?:[^"\\]|\\.)*)"\s*:\s*(.*?)\s*,?\s*$')
MONTHS = {m: i for i, m in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1)}
_iso = re.compile(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?\s*(Z|[+-]\d\d:?\d\d)?$")
_year = re.compile(r"(?:^|\D)(\d{4})-\d\d-\d\d(?:\D|$)")


@lru_cache(1)
def parser() -> Earley:
    """One parser a Python worker; its trie grows by the distinct headers seen, not by lines."""
    return Earley(GRAMMAR, "Line", SCANNER)


def _ms(y: int, mo: int, d: int, h: int, mi: int, s: int, fraction: str | None, offset: str | None) -> int | None:
    try:
        datetime(y, mo, d)
    except ValueError:
        return None
    ms = calendar.timegm((y, mo, d, h, mi, s)) * 1000 + int(((fraction or "") + "000")[:3])
    if offset and offset != "Z":
        minutes = int(offset[1:3]) * 60 + int(offset[-2:])
        ms -= (minutes if offset[0] == "+" else -minutes) * 60_000
    return ms


def iso_ms(text: str) -> int | None:
    m = _iso.match(text.strip())
    return m and _ms(*map(int, m.groups()[:6]), m[7], m[8])


def epoch_ms(text: str) -> int | None:
    """Epoch seconds, milliseconds, microseconds or nanoseconds as text; what is finer than a millisecond is cut off."""
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?", text.strip())
    if not m:
        return None
    whole = int(m[1])
    if whole < 10**11:
        return whole * 1000 + int(((m[2] or "") + "000")[:3])
    return whole if whole < 10**14 else whole // 1000 if whole < 10**17 else whole // 10**6


def any_ms(value: object) -> int | None:
    if value is None or isinstance(value, bool):
        return None
    text = value if isinstance(value, str) else repr(value) if isinstance(value, float) else str(value)
    return epoch_ms(text) if text[:1].isdigit() and "-" not in text and ":" not in text else iso_ms(text)


def level_of(value: object) -> str:
    return LEVELS.get(str(value).strip().lower(), "") if value is not None and not isinstance(value, (dict, list, bool)) else ""


def part_of(value: object) -> str:
    """The program part without folders, line number and file extension."""
    if not isinstance(value, str):
        return ""
    text = re.sub(r":\d+$", "", value.strip())
    if text != value.strip() or re.search(r"\.(?:go|py|rs|js|java|c|cc|cpp)$", text):
        text = re.sub(r"\.\w+$", "", text.rsplit("/", 1)[-1])
    return text


def _first(record: dict, keys: tuple[str, ...]) -> object:
    return next((record[k] for k in keys if record.get(k) is not None), None)


def record_fields(record: dict) -> tuple[int | None, str, str, str]:
    message = _first(record, MESSAGE_KEYS)
    return any_ms(_first(record, TIME_KEYS)), level_of(_first(record, LEVEL_KEYS)), part_of(_first(record, PART_KEYS)), "" if message is None else str(message)


def parse_line(line: str | None, year: int | None) -> tuple[str, int | None, str, str, str]:
    """(kind, ts_ms, level, component, message): kind is start, open, member, close or rest.

    A member line of an object that is printed over several lines has a value that is a string, number, boolean or null
    on it, or one that only opens there and gives no fields.
    """
    none = (None, "", "", "")
    if line is None or not line.strip():
        return ("rest", *none)
    if line[0] == "{":
        if line.strip() == "{":
            return ("open", *none)
        try:
            record = json.loads(line, parse_float=str)
        except (ValueError, RecursionError):
            return ("rest", *none)
        ms, level, part, message = record_fields(record)
        return ("start", ms, level, part, message) if ms is not None else ("rest", *none)
    if line[0] in " \t":
        m = MEMBER.match(line)
        if m is None:
            return ("rest", *none)
        try:
            return ("member", *record_fields({m[2]: json.loads(m[3], parse_float=str)}))
        except (ValueError, RecursionError):
            return ("member", *none)
    if line.strip() == "}":
        return ("close", *none)
    got = parser().parse(line)
    if got is None:
        return ("rest", *none)
    parts, tokens, rest = got
    spans = slots(parts, WANTED)
    text = lambda name: "".join(t for _, t in tokens[slice(*spans[name])]) if name in spans else None
    value = lambda name: (lambda v: json.loads(v) if v[:1] == '"' else v)(tokens[spans[name][0] + 1][1][1:]) if name in spans else None
    if "PairTime" in spans:
        try:
            ms = any_ms(value("PairTime"))
            return ("start", ms, level_of(value("PairLevel")), part_of(value("PairPart")), value("PairMessage") or "") if ms is not None else ("rest", *none)
        except ValueError:
            return ("rest", *none)
    level, part, ms = level_of(text("Level")), part_of(text("Part") or text("File")), None
    if "KTime" in spans:
        t = text("KTime")
        level = level_of(t[0])
        ms = year and _ms(year, int(t[1:3]), int(t[3:5]), int(t[6:8]), int(t[9:11]), int(t[12:14]), t[15:], None)
    elif "YTime" in spans:
        mon, day, clock = text("YTime").split()
        h, mi, s = clock.split(":")
        ms = year and mon in MONTHS and _ms(year, MONTHS[mon], int(day), int(h), int(mi), int(s[:2]), s[3:], None) or None
    elif "ATime" in spans:
        t = text("ATime")
        ms = _ms(int(t[7:11]), MONTHS.get(t[3:6], 0), int(t[:2]), int(t[12:14]), int(t[15:17]), int(t[18:20]), None, t[21:])
    else:
        ms = iso_ms(text("STime") or text("ITime"))
    return ("start", ms, level, part, line[rest:]) if ms is not None else ("rest", *none)


def member_place(line: str) -> tuple[int, int]:
    """(indent, rank) of a member line: of several keys for one field the more telling counts."""
    m = MEMBER.match(line)
    return len(m[1]), next((keys.index(m[2]) for keys in (TIME_KEYS, LEVEL_KEYS, PART_KEYS, MESSAGE_KEYS) if m[2] in keys), 99)


def _parse(batches: Iterator[pa.RecordBatch], raw_too: bool = False) -> Iterator[pa.RecordBatch]:
    years: dict[str, int | None] = {}
    for batch in batches:
        files, raws, imported = (batch.column(i).to_pylist() for i in (0, 2, 3))
        rows = []
        for f, raw, at in zip(files, raws, imported, strict=True):
            year = years.get(f, 0)
            if year == 0:
                m = _year.search(f or "")
                year = years[f] = int(m[1]) if m else None
            rows.append(parse_line(raw, year if year is not None else at))
        kinds, ms, level, part, message = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        places = [member_place(raw) if kind == "member" else (None, None) for kind, raw in zip(kinds, raws, strict=True)]
        columns = [pa.array(kinds, pa.string()), pa.array(ms, pa.int64()), pa.array(level, pa.string()), pa.array(part, pa.string()), pa.array(message, pa.string()), *(pa.array([p[i] for p in places], pa.int32()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *([batch.column(2)] if raw_too else [])], names=["log_file", "line_no", "kind", "ts_ms", "level", "component", "message", "indent", "rank", *(["raw"] if raw_too else [])])


def parsed_lines(log: DataFrame, raw_too: bool = False) -> DataFrame:
    """Each physical line with its kind and fields, and itself if asked for: a narrow stage, no shuffle."""
    used = log.select("log_file", "line_no", "raw", F.year("imported_at").cast("int").alias("year")).where("log_file IS NOT NULL AND line_no IS NOT NULL")
    return used.mapInArrow(lambda batches: _parse(batches, raw_too), "log_file string, line_no long, kind string, ts_ms long, level string, component string, message string, indent int, rank int" + (", raw string" if raw_too else ""))


def _in_blocks(lines: DataFrame) -> DataFrame:
    """Lines with their block and the line that their entry begins with, if it begins in the same block."""
    lines = lines.withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))
    w = Window.partitionBy("log_file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("first_line", F.max(F.when(F.col("kind").isin("start", "open"), F.col("line_no"))).over(w))


def _block_ends(segments: DataFrame) -> DataFrame:
    """One row a block: the entry that is open at its end, and the one that is carried into it from the blocks before."""
    ends = segments.groupBy("log_file", "block").agg(F.max("first_line").alias("open_at_end"))
    before = Window.partitionBy("log_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("log_file", "block", "open_at_end", F.last("open_at_end", ignorenulls=True).over(before).alias("carried"))


def found(log: DataFrame, message: bool = False) -> DataFrame:
    """(log_file, first_line, last_line, ts_ms, level, component) of each entry; with ``message`` its first line's text too."""
    fields = ["ts_ms", "level", "component", *(["message"] if message else [])]
    lines = _in_blocks(parsed_lines(log).select("log_file", "line_no", "kind", "indent", "rank", *fields))
    said = lambda c, kind: (F.col("kind") == kind) & (F.col(c).cast("string") != "")
    segments = lines.groupBy("log_file", "block", "first_line").agg(
        F.max("line_no").alias("last_line"), F.max(F.when(F.col("line_no") == F.col("first_line"), F.col("kind"))).alias("kind"), F.min(F.when(F.col("kind") == "member", F.col("indent"))).alias("indent"),
        *[F.max(F.when(said(c, "start"), F.col(c))).alias(c) for c in fields], *[F.min(F.when(said(c, "member"), F.struct("indent", "rank", "line_no", c))).alias(f"m_{c}") for c in fields],
    )
    segments = stored(segments, "log-segments")  # about a row an entry; read three times below
    owned = segments.join(_block_ends(segments), ["log_file", "block"]).withColumn("owner", F.coalesce("first_line", "carried")).where("owner IS NOT NULL")
    edge = F.col("first_line").isNull() | (F.col("first_line") == F.col("open_at_end"))
    least = ["indent", *(f"m_{c}" for c in fields)]
    merged = owned.where(edge).groupBy("log_file", F.col("owner").alias("first_line")).agg(*[F.max(c).alias(c) for c in ("last_line", "kind", *fields)], *[F.min(c).alias(c) for c in least])
    inner = owned.where(~edge).select("log_file", "first_line", "last_line", "kind", *fields, *least)
    pick = lambda c: F.when(F.col("kind") == "open", F.when(F.col(f"m_{c}.indent") == F.col("indent"), F.col(f"m_{c}.{c}"))).otherwise(F.col(c))
    return inner.unionByName(merged).select("log_file", "first_line", "last_line", pick("ts_ms").alias("ts_ms"), *[F.coalesce(pick(c), F.lit("")).alias(c) for c in fields[1:]])


def owned_lines(log: DataFrame) -> DataFrame:
    """(log_file, line_no, kind, block, first_line, text): every line once with the entry that it belongs to, null before a file's first.

    The text of a header line is its message, that of any other the line itself.
    """
    text = F.when((F.col("kind") == "start") & ~F.coalesce(F.ltrim("raw").startswith("{"), F.lit(False)), F.col("message")).otherwise(F.col("raw"))
    lines = stored(_in_blocks(parsed_lines(log, True).select("log_file", "line_no", "kind", text.alias("text"))), "log-lines")
    ends = _block_ends(lines).select("log_file", "block", "carried")  # a row a block
    owned = lines.join(ends, ["log_file", "block"])
    return owned.select("log_file", "line_no", "kind", "block", F.coalesce("first_line", "carried").alias("first_line"), "text")


def unparsed(log: DataFrame) -> DataFrame:
    """(log_file, line_no, first_line, text): the lines that no header rule and no member rule derives, with their entry; blank ones are left out."""
    return owned_lines(log).where("kind = 'rest' AND trim(text) <> ''").select("log_file", "line_no", "first_line", "text").distinct()


def messages(log: DataFrame) -> DataFrame:
    """(log_file, first_line, part, n_lines, message): the text of each entry with all its lines.

    An entry that goes on into the next block of ``BLOCK_LINES`` lines has a further part there, so that no row grows with
    its entry.
    """
    lines = owned_lines(log).where("first_line IS NOT NULL")
    part = (F.col("block") - F.floor(F.col("first_line") / BLOCK_LINES)).cast("long")
    g = lines.groupBy("log_file", "first_line", part.alias("part")).agg(F.array_sort(F.collect_set(F.struct("line_no", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return g.select("log_file", "first_line", "part", F.size("t").cast("long").alias("n_lines"), F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("message"))
