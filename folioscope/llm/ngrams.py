"""Character n-gram models in numpy: naive Bayes over languages, and how likely a text ends where it ends."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np

#: Hashed n-grams that languages, and ends of texts, are told by: the models are of fixed size, however many texts they are counted from.
BUCKETS, END_BUCKETS = 1 << 16, 1 << 20
PACK_CHARS = 1_000_000
#: A letter that no text has, between texts that are counted together; n-grams over it don't count.
APART = "\U00010380"
_other = re.compile(r"(?:[^\w'’]|[\d_])+")


def packs(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about ``PACK_CHARS`` characters."""
    pack, size = [], 0
    for t in texts:
        pack.append(t)
        size += len(t)
        if size >= PACK_CHARS:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_ids(text: str) -> np.ndarray:
    """Hashed 2- and 3-grams of a lower-cased text, with digits and other non-letters as one class each; none over ``APART``."""
    s = f" {_other.sub(' ', text.lower()).replace('’', chr(39)).strip()} "
    c = codes(s)
    if len(c) < 3:
        return np.empty(0, dtype=np.int64)
    two = c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(40503)
    three = two[:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
    if APART in s:
        within = c != ord(APART)
        pair = within[:-1] & within[1:]
        two, three = two[pair], three[pair[:-1] & within[2:]]
    h = np.concatenate([two, three])
    h ^= h >> np.uint32(15)
    return (h % np.uint32(BUCKETS)).astype(np.int64)


def gram_counts(texts: list[str]) -> np.ndarray:
    """How often each hashed n-gram stands in the texts."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    for pack in packs(texts):
        out += np.bincount(gram_ids(f"\n{APART}\n".join(pack)), minlength=BUCKETS)
    return out


class LanguageBayes:
    """Multinomial naive Bayes over hashed character n-grams with equal priors."""

    def __init__(self, langs: list[str], counts: np.ndarray, even: float = 0.05):
        """counts: ``gram_counts`` of each language; even: the weight of the uniform distribution, so that what a language never showed costs the same in each."""
        self.langs = langs
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
        self.logp = np.log((1 - even) * share + even / BUCKETS).astype(np.float32)

    def log_odds(self, text: str) -> dict[str, float]:
        """Log-likelihood of the text in each language less that of the best one."""
        ids = gram_ids(text)
        scores = self.logp[:, ids].sum(axis=1, dtype=np.float64)
        return dict(zip(self.langs, (scores - scores.max()).tolist(), strict=True))


def shape(text: str) -> str:
    """Characters by class: capitals, other letters and digits, spaces; others as they are."""
    return "".join("A" if c.isupper() else "a" if c.isalnum() else " " if c.isspace() else c for c in text)


_unknown = 0xFFFFFFFF
_shapes = np.full(0x110000, _unknown, dtype=np.uint32)


def shape_codes(c: np.ndarray) -> np.ndarray:
    """``shape`` of code points."""
    out = _shapes[c]
    new = out == _unknown
    if new.any():
        for x in np.unique(c[new]).tolist():
            _shapes[x] = ord(shape(chr(x)))
        out = _shapes[c]
    return out


_MIX, _STEP = 2654435761, 2246822519


class EndModel:
    """P(the text ends here | its last characters), from n-grams of characters on top of n-grams of their shapes.

    The estimate begins with how often any place is an end; each longer context that was seen, first of shapes and then of
    the characters themselves, draws it towards its own share of ends by as much as it was seen often. N-grams are hashed.
    """

    SHAPES, CHARS = 3, 4
    #: How many sights of a context weigh as much as the shorter ones together.
    TRUST_SHAPES, TRUST_CHARS = 2.0, 600.0

    def __init__(self, counts: np.ndarray, chars: int, texts: int):
        """counts: ``counted`` of the texts; chars, texts: how many there were."""
        # What was seen once or twice says nothing.
        self.all, self.ends = np.where(counts[0] > 2, counts, 0)
        self.start = (texts + 0.02) / (chars + 1.0)

    @classmethod
    def counted(cls, texts: list[str]) -> tuple[np.ndarray, int, int]:
        """(how often each hashed n-gram stands anywhere and at an end, characters, texts) of stripped texts that aren't empty."""
        out, chars = np.zeros((2, END_BUCKETS), dtype=np.int64), 0
        for pack in packs(texts):
            c = codes(APART.join(pack) + APART)
            last = np.flatnonzero(c == ord(APART)) - 1
            chars += len(c) - len(last)
            for tag, s, order in ((1, shape_codes(c), cls.SHAPES), (2, c, cls.CHARS)):
                h = np.full(len(c), tag, dtype=np.uint32)
                inside = np.ones(len(c), dtype=bool)
                for n in range(1, order + 1):  # h[i] is of the n characters from i on
                    h = (h[: len(c) - n + 1] + s[n - 1 :]) * np.uint32(_MIX)
                    h ^= h >> np.uint32(15)
                    inside = inside[: len(c) - n + 1] & (c[n - 1 :] != ord(APART))
                    ids = ((h * np.uint32(_STEP)) >> np.uint32(12)).astype(np.int64)
                    out[0] += np.bincount(ids[inside], minlength=END_BUCKETS)
                    at = last - n + 1
                    at = at[at >= 0]
                    out[1] += np.bincount(ids[at[inside[at]]], minlength=END_BUCKETS)
        return out, chars, len(texts)

    @staticmethod
    def bucket(tag: int, text: str) -> int:
        h = tag
        for c in text:
            h = ((h + ord(c)) * _MIX) & 0xFFFFFFFF
            h ^= h >> 15
        return ((h * _STEP) & 0xFFFFFFFF) >> 12

    def log_likelihood(self, text: str) -> float:
        t = text.strip()[-max(self.SHAPES, self.CHARS) :]
        p = self.start
        for tag, s, order, trust in ((1, shape(t), self.SHAPES, self.TRUST_SHAPES), (2, t, self.CHARS, self.TRUST_CHARS)):
            for n in range(1, min(order, len(s)) + 1):
                i = self.bucket(tag, s[-n:])
                p = (int(self.ends[i]) + trust * p) / (int(self.all[i]) + trust)
        return math.log(max(p, 1e-9))
