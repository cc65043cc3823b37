"""Problem 9: a score of abusive, hateful or sexual content for every document, and its rates by source.

A document is scored by its worst sentence. Sentences are bags of hashed words, pairs, triples and skip-grams, weighed by
FTRL-proximal logistic regression. Labels say which documents are bad, not which sentence; so a flagged document teaches
by the sentence that the model so far finds worst, any other document by all its sentences. Of those, a sentence that
the model finds bad is left out only if flagged documents bear that out: enough of its grams that other documents have
must be in more worst sentences of flagged documents than in documents that passed, or a mention of a harsh word that the
model has wrong would never be put right. The model is fitted on the driver on a bounded sample of the reviewed documents
and knows nothing else of the language; its weights are sparse and of fixed size, and go to the tasks by broadcast.
Scoring is one narrow pass over whole texts.

Defined results: null, empty and blank texts score 0 and aren't found; of several reviews the majority counts, a tie
is no verdict and teaches nothing, null flags as no review; reviews of unknown documents are left out; without reviews
nothing is found. One row per row of documents; a null source is a source of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.ftrl import APART, BITS, FTRL, TOKEN, WordHash, grams, plain
from folioscope.sources.tables import hash_sample

#: Bounds of the reviewed sample that the model is fitted on, by the hash of doc_id; longer documents don't teach.
SAMPLE_FLAGGED, SAMPLE_CLEAN, SAMPLE_CHARS = 4000, 8000, 50_000
#: Part of the documents with a bad sentence that reviewers may pass.
ERRING = 0.2
#: Log-odds above which a sentence of a document that isn't flagged may be one that the reviewer missed, and the share of its
#: grams, of those that other reviewed documents have, that must then be more often in flagged ones.
MISSED, BORNE_OUT = 0.5, 0.3
ROUNDS = 4
THRESHOLD = 0.35
CHUNK_CHARS = 1_000_000

def sentences(texts: list[str | None], words: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, sentence of each word, text of each sentence) of texts; sentences are numbered over all texts."""
    tokens: list[str] = []
    pack: list[str] = []
    size = 0
    for t in [*texts, None]:
        pack.append((t or "").replace(APART, " "))
        size += len(pack[-1])
        if size >= CHUNK_CHARS:
            tokens += TOKEN.findall(plain(APART.join(pack)))
            tokens.append(APART)
            pack, size = [], 0
    tokens += TOKEN.findall(plain(APART.join(pack)))
    h = np.array([words[t] if t[0].isalpha() else 1 if t == APART else 0 for t in tokens], dtype=np.uint32)
    text = np.cumsum(h == 1)
    sentence = np.cumsum(h <= 1)
    keep = h > 1
    n = int(sentence[-1]) + 1 if len(sentence) else 0
    of = np.zeros(n, dtype=np.int64)
    of[sentence[keep]] = text[keep]
    return h[keep], sentence[keep], of


class Model:
    def __init__(self, weights: np.ndarray, prior: float):
        self.at = np.flatnonzero(weights).astype(np.int32)
        self.values = weights[self.at]
        self.prior = prior
        self.table: np.ndarray | None = None
        self.words: WordHash | None = None

    def __getstate__(self) -> dict:
        return {"at": self.at, "values": self.values, "prior": self.prior, "table": None, "words": None}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of the worst sentence of each text."""
        if self.table is None:
            self.table = np.zeros(1 << BITS, dtype=np.float32)
            self.table[self.at] = self.values
            self.words = WordHash()
        out = np.zeros(len(texts))
        h, sentence, of = sentences(texts, self.words)
        if not len(h):
            return out
        f, s = grams(h, sentence)
        w = self.table[f]
        hit = np.flatnonzero(w)
        sums = np.bincount(s[hit], weights=w[hit], minlength=len(of)) + self.prior
        p = 1.0 / (1.0 + np.exp(-np.clip(sums, -30, 30)))
        alive = np.unique(sentence)
        np.maximum.at(out, of[alive], p[alive])
        return out


def fit(labelled: list[tuple[str, bool]]) -> Model:
    """labelled: (text, flagged)."""
    rng = np.random.default_rng(11)
    flags = np.array([f for _, f in labelled], dtype=bool)
    h, sentence, of = sentences([t for t, _ in labelled], WordHash())
    f, s = grams(h, sentence)
    order = np.argsort(s, kind="stable")
    f, s = f[order], s[order]
    ids, starts = np.unique(s, return_index=True)
    bounds = np.append(starts, len(s))
    rows = {int(i): np.unique(f[a:b]) for i, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True)}
    by_text: dict[int, list[int]] = {}
    for i in rows:
        by_text.setdefault(int(of[i]), []).append(i)
    # A sentence that documents which aren't flagged have word for word, more often than reviewers err, isn't what a document
    # was flagged for; a document without others was flagged by mistake.
    bad_in: Counter[bytes] = Counter()
    clean_in: Counter[bytes] = Counter()
    for t, own in by_text.items():
        for key in {rows[i].tobytes() for i in own}:
            (bad_in if flags[t] else clean_in)[key] += 1
    eligible = {t: [i for i in own if clean_in[k := rows[i].tobytes()] <= ERRING * bad_in[k]] for t, own in by_text.items() if flags[t]}
    passed = np.zeros(1 << BITS, dtype=np.int32)  # documents that passed, by gram
    for t, own in by_text.items():
        if not flags[t]:
            passed[np.unique(np.concatenate([rows[i] for i in own]))] += 1
    model = FTRL()
    score = lambda i: model.weights(rows[i]).sum()
    for turn in range(ROUNDS):
        accused = np.zeros(1 << BITS, dtype=np.int32)  # flagged documents, by gram of their worst sentence
        for own in eligible.values() if turn else ():
            if own:
                accused[rows[max(own, key=score)]] += 1
        for t in rng.permutation(list(by_text)):
            if not flags[t]:
                for i in by_text[t]:
                    if turn and score(i) + model.prior > MISSED:
                        bad, clean = accused[rows[i]], passed[rows[i]] - 1
                        shared = bad + clean > 1
                        if shared.any() and (bad > clean)[shared].mean() >= BORNE_OUT:
                            continue  # what a reviewer seems to have missed teaches nothing
                    model.learn(rows[i], 0.0)
                continue
            own = eligible[t]
            if own:  # in the first round, by the mean rather than the sum, so that long sentences have no lead
                model.learn(rows[max(own, key=lambda i: score(i) / (len(rows[i]) ** 0.5 if turn == 0 else 1.0))], 1.0)
    return Model(model.dense(), model.prior)


def reviewed(docs: DataFrame, labels: DataFrame) -> list[tuple[str, bool, bool]]:
    """(text, the majority's verdict, whether it is a tie) of the bounded sample of reviewed documents."""
    votes = labels.where("flagged IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", *(["reviewer"] if "reviewer" in labels.columns else []), "flagged").distinct()
    verdict = votes.groupBy("doc_id").agg((F.avg("flagged") > 0.5).alias("bad"), (F.avg("flagged") == 0.5).alias("tied"))
    chosen = [*hash_sample(verdict.where("bad"), SAMPLE_FLAGGED, "doc_id"), *hash_sample(verdict.where("NOT bad"), SAMPLE_CLEAN, "doc_id")]
    known = docs.sparkSession.createDataFrame([(r.doc_id, r.bad, r.tied) for r in chosen], "doc_id long, bad boolean, tied boolean")
    hit = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(known), "doc_id")  # at most the two bounds
    rows = hit.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("bad").alias("bad"), F.first("tied").alias("tied")).collect()
    return [(r.text, r.bad, r.tied) for r in sorted(rows, key=lambda r: r.doc_id)]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit([(text, bad) for text, bad, tied in reviewed(docs, labels) if not tied]))  # at most 2**20 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(p, 6)), pa.array(p >= THRESHOLD)], names=["doc_id", "source", "score", "flagged"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double, flagged boolean")


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).where("flagged").select("doc_id")


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) of each source."""
    return scored(docs, labels).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
