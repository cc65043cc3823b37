"""Problem 2: answers that fail their prompt, with the kind of failure.

All answers with a stated language, however long, fit two character n-gram models: naive Bayes over languages and the
likelihood that a text ends where it ends. Their hashed n-grams are counted in the tasks and summed by bucket, so the models
are of fixed size and travel with the task; every pair is then judged in one narrow pass. A pair's language is the stated one, else the one that the prompt
names, else the most likely one of the prompt itself; the answer's posterior is compared with it. A refusal speaks, outside
quotation marks and within its first two sentences, of itself as declining, and gives little after that; a copy shares nearly all words, in order, with the prompt.

Defects, the first that holds: ``empty``, ``refusal``, ``copies_prompt``, ``wrong_language``, ``truncated``.

Defined results: repeated rows, by pair_id, count once; a null or blank answer, an empty JSON value and a fence around
nothing are empty; with a null prompt nothing is copied and the language is page_lang's or unknown (then never wrong).
Without any labelled rows the seed sentences alone fit the models.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.ngrams import BUCKETS, EndModel, LanguageBayes, gram_counts
from folioscope.sources.tables import one_per_key, stored

#: Shorter answers don't teach: they tell no language, and a few words no end.
LEAST_CHARS = 30
#: Log-odds against the wanted language from which an answer is in another, and log-likelihood under which an end is none.
LANGUAGE_ODDS, END_LIKELIHOOD = 22.0, -4.2
#: An answer that goes on for more sentences than these after it declines isn't a refusal.
REFUSAL_SENTENCES = 4

#: Names of languages in labels and prompts.
LANGUAGES = {
    "en": "en", "eng": "en", "english": "en", "anglais": "en", "englisch": "en", "inglés": "en",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "französisch": "fr", "francés": "fr",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "allemand": "de", "deutsch": "de", "alemán": "de",
    "es": "es", "spa": "es", "spanish": "es", "espagnol": "es", "spanisch": "es", "español": "es",
}
#: A few plain sentences a language, so that the models stand without labelled rows.
SEEDS = {
    "en": "The page is short and the text of this page was written by hand. Only that it is named once. Nothing on this page. What does it say, and which of them was the first? They have not been seen since then, although the others were there.",
    "fr": "La page est courte et le texte de cette page a été écrit à la main. Rien sur cette page. Que dit-elle, et lequel était le premier ? On ne les a pas vus depuis, tandis que les autres étaient là avec nous.",
    "de": "Die Seite ist kurz und der Text dieser Seite wurde von Hand geschrieben. Auf dieser Seite steht nichts dazu. Was sagt sie, und welcher war der erste? Sie wurden seitdem nicht gesehen, während die anderen noch da waren.",
    "es": "La página es corta y el texto de esta página fue escrito a mano. Nada en esta página. ¿Qué dice, y cuál fue el primero? No se los ha visto desde entonces, mientras que los otros todavía estaban allí.",
}
#: Ways of declining, by language; they must speak in the first person.
REFUSALS = re.compile(
    r"\bI (?:can(?:no|')t|can not|am (?:unable|not able|not allowed)|won't|will not|must (?:pass|decline|refuse)|have to (?:pass|decline|refuse)|(?:do not|don't) feel comfortable|decline|refuse)\b"
    r"|not possible for me|appropriate for me\b|\bI won't be able"
    r"|\b(?:kann|darf|möchte|werde) ich\b[^.]*\bnicht\b|\bich (?:kann|darf|möchte|werde)\b[^.]*\bnicht\b|\bmuss ich\b[^.]*\bablehnen|\bich muss\b[^.]*\bablehnen"
    r"|\bje (?:ne (?:peux|puis|suis)|dois (?:refuser|décliner)|refuse)|m'est impossible"
    r"|\bno (?:puedo|me es posible|estoy en condiciones)\b|\b(?:debo|tengo que) (?:rechazar|declinar|negarme)|me es imposible|\blamento no poder\b",
    re.IGNORECASE,
)
TEXT_KEYS = ("transcription", "text", "ocr", "ocr_text", "markdown", "content")
_fence = re.compile(r"```[\w-]*[ \t]*\n?(.*?)(```|\Z)", re.DOTALL)
_partial = re.compile(r'"(?:' + "|".join(TEXT_KEYS) + r')"\s*:\s*"((?:[^"\\]|\\.)*)')
_decoder = json.JSONDecoder(strict=False)
_lone = re.compile("[\ud800-\udfff]")
_record = re.compile(r'\{\s*"')
_quoted = re.compile(r"[“„][^“”„]*[”“]|«[^»]*»|»[^«]*«|\"[^\"]*\"")
_stop = re.compile(r"[.!?](?=\s)")
_context = re.compile(r"\n\s*\n|\n(?=[A-Z][\w ]{0,40}:)")


def balanced(text: str, at: int) -> int:
    """Where the object that opens at a place is closed; -1 if nowhere."""
    depth, quoted, i = 0, False, at
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


def loads(text: str) -> object:
    """JSON as answers have it: with repairs of trailing commas, leading zeros and bare line feeds."""
    try:
        return json.loads(text, strict=False)
    except ValueError:
        return json.loads(re.sub(r"(:\s*)0+(\d)", r"\1\2", re.sub(r",(\s*[}\]])", r"\1", text)), strict=False)


def flat(value: object) -> str:
    """All strings below a value."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        value = list(value.values())
    return " ".join(filter(None, map(flat, value))).strip() if isinstance(value, list) else ""


def content(raw: str | None) -> tuple[str, str, bool]:
    """(text, notes, whole) of an answer; whole is False if its JSON or fence is never closed."""
    s = (raw or "").strip()
    whole = True
    fenced = _fence.search(s)
    if fenced and (fenced.start() == 0 or "{" in fenced[1]):
        whole = fenced[2] != ""
        s = fenced[1].strip()
    if s in ("null", '""', "[]", "{}", "''"):
        return "", "", whole
    m = _record.search(s)
    at = 0 if s[:1] == "{" else m.start() if m else -1
    if at >= 0:
        if at > 0 and not any(f'"{k}"' in s[at:] for k in TEXT_KEYS):
            return s, "", whole  # a text in which such a brace stands
        try:
            record, _ = _decoder.raw_decode(s, at)
            end = at
        except (ValueError, RecursionError):
            record, end = None, balanced(s, at)
        if end < 0:
            part = _partial.search(s)
            return (part[1].replace("\\n", "\n").replace('\\"', '"') if part else ""), "", False
        if record is None:
            try:
                record = loads(s[at:end])
            except (ValueError, RecursionError):
                return s, "", whole
        if isinstance(record, dict):
            text = next((flat(record[k]) for k in TEXT_KEYS if k in record), "")
            return text.strip(), flat(record.get("notes")), True
        return flat(record), "", True
    if s[:1] in '["' and s[-1:] in ']"':
        try:
            return flat(loads(s)), "", whole
        except (ValueError, RecursionError):
            pass
    return s, "", whole


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def copies(answer: str, prompt: str | None) -> bool:
    """Whether the answer is only the prompt or its instruction, whole or nearly."""
    a = words(answer)
    if not prompt or len(a) < 3:
        return False
    for p in (words(prompt), words(_context.split(prompt.strip())[0]), words(prompt.strip().split("\n")[0])):
        if not p or not 0.5 * len(p) <= len(a) <= 1.3 * len(p) + 2 or len(set(a) & set(p)) < 0.7 * len(set(a)):
            continue
        same = sum(m.size for m in SequenceMatcher(None, a, p, autojunk=False).get_matching_blocks())
        if same >= 0.85 * len(a) and same >= 0.55 * len(p):
            return True
    return False


def refuses(text: str) -> bool:
    """Whether a text declines in its own words, not in a quotation."""
    bare = _quoted.sub(" ", text)
    stops = [m.end() for m in islice(_stop.finditer(bare), 3)]
    m = REFUSALS.search(bare, 0, stops[2] if len(stops) > 2 else len(bare))  # it must begin within the first two sentences
    return bool(m) and len(_stop.findall(bare[: m.start()])) <= 1 and len(_stop.findall(bare[m.end() :].strip())) <= REFUSAL_SENTENCES


LANGS = sorted(set(LANGUAGES.values()))


_seeds = 3 * np.stack([gram_counts([SEEDS[lang]]) for lang in LANGS])


class Counts:
    """What the models are fitted on: counts of n-grams by language and at ends. Those of parts of a table add up."""

    def __init__(self) -> None:
        self.grams = np.zeros((len(LANGS), BUCKETS), dtype=np.int64)
        self.ends, self.chars, self.texts = EndModel.counted([])

    def add(self, labelled: list[tuple[str | None, str | None]]) -> Counts:
        """labelled: (stated language, text of the answer)."""
        known = [(LANGUAGES.get((lang or "").lower()), (text or "").strip()) for lang, text in labelled]
        known = [(lang, t) for lang, t in known if lang and len(t) >= LEAST_CHARS]
        for i, of in enumerate(LANGS):
            self.grams[i] += gram_counts([t for lang, t in known if lang == of])
        ends, chars, texts = EndModel.counted([t for _, t in known])
        self.ends, self.chars, self.texts = self.ends + ends, self.chars + chars, self.texts + texts
        return self

    def parts(self) -> list[np.ndarray]:
        return [*self.grams, *self.ends, np.array([self.chars, self.texts])]

    def put(self, part: np.ndarray, at: np.ndarray, n: np.ndarray) -> Counts:
        """Counts from the rows (part, place in it, n)."""
        flat = self.parts()
        for i, counts in enumerate(flat):
            of = part == i
            counts[at[of]] += n[of]
        self.grams, self.ends, (self.chars, self.texts) = np.stack(flat[: len(LANGS)]), np.stack(flat[len(LANGS) : -1]), map(int, flat[-1])
        return self


class Judge:
    def __init__(self, labelled: list[tuple[str, str]] | Counts):
        """labelled: (language, raw answer) or their counts; refusals and answers that break off are left to be outvoted."""
        counts = labelled if isinstance(labelled, Counts) else Counts().add([(lang, content(raw)[0]) for lang, raw in labelled])
        seeds, chars, texts = EndModel.counted(list(SEEDS.values()))
        self.bayes = LanguageBayes(LANGS, counts.grams + _seeds)
        self.end = EndModel(counts.ends + seeds, counts.chars + chars, counts.texts + texts)

    def language(self, page_lang: str | None, prompt: str | None) -> str | None:
        if page_lang and page_lang.lower() in LANGUAGES:
            return LANGUAGES[page_lang.lower()]
        if not prompt or not prompt.strip():
            return None
        task = _context.split(prompt.strip())[0]
        named = [LANGUAGES[w] for w in re.findall(r"\w+", task.lower()) if len(w) > 3 and w in LANGUAGES]
        if named:
            return named[-1]
        odds = self.bayes.log_odds(task)
        return max(odds, key=odds.__getitem__)

    def defect(self, page_lang: str | None, prompt: str | None, raw: str | None) -> str | None:
        return self.defect_of(page_lang, prompt, *content(raw))

    def defect_of(self, page_lang: str | None, prompt: str | None, text: str, notes: str, whole: bool) -> str | None:
        if not text.strip() and not notes.strip():
            return "empty" if whole else "truncated"
        said = text.strip() or notes.strip()
        if refuses(said):
            return "refusal"
        if not text.strip():
            return None if whole else "truncated"
        if copies(text, prompt):
            return "copies_prompt"
        if re.sub(r"[\W_]", "", text).upper() == "BLANKPAGE":
            return None
        lang = self.language(page_lang, prompt)
        odds = self.bayes.log_odds(text)
        if lang in odds and -odds[lang] > LANGUAGE_ODDS and -odds[lang] > 0.02 * len(text):
            return "wrong_language"
        end = re.sub(r"\s*(?:…|\.\.\.)\s*$", "", text)
        if not whole or self.end.log_likelihood(end) < END_LIKELIHOOD:
            return "truncated"
        return None


def parsed(pairs: DataFrame) -> DataFrame:
    """(pair_id, page_lang, user_prompt, text, notes, whole) of every pair, once."""
    order = [F.col("received_at").asc_nulls_last()] if "received_at" in pairs.columns else [F.lit(1)]
    used = ["pair_id", "page_lang", "user_prompt", "raw_response", *(["received_at"] if "received_at" in pairs.columns else [])]
    one = one_per_key(pairs.select(*used), ["pair_id"], order).select("pair_id", "page_lang", "user_prompt", "raw_response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(_lone.sub("\ufffd", text), _lone.sub("\ufffd", notes), whole) for text, notes, whole in map(content, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.bool_())], names=["pair_id", "page_lang", "user_prompt", "text", "notes", "whole"])

    return one.mapInArrow(run, "pair_id long, page_lang string, user_prompt string, text string, notes string, whole boolean")


def counted(answers: DataFrame) -> Counts:
    """Counts of all answers with a stated language; what comes to the driver is at most a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            counts.add(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
        for i, part in enumerate(counts.parts()):
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(part[at], pa.int64())], names=["part", "at", "n"])

    rows = answers.where("page_lang IS NOT NULL").select("page_lang", "text").mapInArrow(run, "part int, at int, n long").groupBy("part", "at").agg(F.sum("n").alias("n")).toArrow()
    return Counts().put(*(rows.column(k).to_numpy() for k in ("part", "at", "n")))


def judged(pairs: DataFrame) -> DataFrame:
    """(pair_id, defect) of every pair; defect is null for sound ones."""
    one = stored(parsed(pairs), "pairs-parsed", "zstd")  # prompts and answers are much alike
    model = pairs.sparkSession.sparkContext.broadcast(Judge(counted(one)))  # hashed tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value.defect_of
        for batch in batches:
            kinds = [of(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], names=["pair_id", "defect"])

    return one.mapInArrow(run, "pair_id long, defect string")


def found(pairs: DataFrame) -> DataFrame:
    return judged(pairs).where("defect IS NOT NULL")
