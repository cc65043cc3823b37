"""FTRL-proximal logistic regression over hashed n-grams and skip-grams, and the text normalisation before it."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

BITS = 20
MASK = (1 << BITS) - 1
#: Characters that are left out, and look-alikes of Latin letters.
DROPPED = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E, *range(0xFE00, 0xFE10)])
ALIKE = {ord(a): b for a, b in zip("аеорсхуіѕјԁһӏкмтвнАЕОРСХУІЅЈКМТВНαοενρτικυ", "aeopcxyisjdhlkmtbhaeopcxyisjkmtbhaoevptiku", strict=True)}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_odd = re.compile("[" + re.escape("".join(map(chr, [*DROPPED, *ALIKE]))) + "]")
_mapped = {chr(k): v or "" for k, v in (DROPPED | ALIKE).items()}
_wide = re.compile("[^\x00-\u024f]+")
# What is looked for comes first and its neighbours are looked back at, so that the search skips from one to the next.
_leet = re.compile(r"[0134578@$!](?:(?<=[^\W\d_].)(?:(?=[\w@$])|(?<!!)(?!\w))|(?<![\w@$!].)(?<!!)(?=[^\W\d_]))", re.DOTALL)
_spaced = re.compile(r"(?<![\w*])[^\W\d_](?:([ .·_-])[^\W\d_](?:\1[^\W\d_])+)(?![\w*])")
_broken = re.compile(r"[-\xad¬‐‑](?<=[^\W\d_].)[ \t]*\n\s*(?=[a-zà-ÿ])", re.DOTALL)
#: Stands between texts that are read together. It is no white space, so no pattern runs over it.
APART = "\ue000"
#: Words, and what parts sentences: stops, closing brackets, cells, comments, blank lines and lines that begin a list, table or heading.
TOKEN = re.compile(r"[^\W\d_]+(?:\*+[^\W\d_]+)*|[.!?;)](?=\s)|\ue000|-->|\||\n\s*(?=[-*|#<]|\n)")


def unstretched(text: str) -> str:
    """Letters that stand three times or more in a row once."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(c) < 3:
        return text
    same = c[1:] == c[:-1]
    runs = np.flatnonzero(same[1:] & same[:-1] & (c[2:] >= 97))
    if not len(runs):
        return text
    keep = np.ones(len(c), dtype=bool)
    for i in runs.tolist():
        if chr(c[i]).isalpha():
            keep[i + 1 : i + 3] = False
    return c[keep].tobytes().decode("utf-32-le", "surrogatepass")


def plain(text: str) -> str:
    """Lower case with disguises taken off: hidden characters, look-alikes, digits for letters, spaced and stretched words."""
    text = _broken.sub("", text)
    if not text.isascii():
        text = _wide.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
        text = _odd.sub(lambda m: _mapped[m[0]], text)
    s = _leet.sub(lambda m: LEET[m[0]], text.lower())
    s = _spaced.sub(lambda m: "".join(c for c in m[0] if c.isalpha()), s)
    return unstretched(s)


class WordHash(dict):
    """Stable hash of a word, remembered; forgets all when full, so a worker's memory is bounded."""

    def __missing__(self, word: str) -> int:
        h = 2166136261
        for b in word.encode("utf-8", "surrogatepass"):
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        if len(self) > 500_000:
            self.clear()
        self[word] = h
        return h


def grams(h: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, segment) of words, pairs, triples and pairs over one or two skipped words, none across segments."""
    h = h.astype(np.uint32)
    mix = lambda x, y, k: (x * np.uint32(0x9E3779B1) ^ (y + np.uint32(k)) * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE35)
    feats, segs = [h * np.uint32(0x27D4EB2F)], [seg]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = seg[gap:] == seg[:-gap]
            feats.append(mix(h[:-gap], h[gap:], gap)[same])
            segs.append(seg[gap:][same])
    if len(h) > 2:
        same = seg[2:] == seg[:-2]
        feats.append(mix(mix(h[:-2], h[1:-1], 7), h[2:], 11)[same])
        segs.append(seg[2:][same])
    f, s = np.concatenate(feats), np.concatenate(segs)
    f ^= f >> np.uint32(15)
    return (f & np.uint32(MASK)).astype(np.int64), s


class FTRL:
    """Per-coordinate learning rates; L1 keeps only features that pay, so the weights stay compact."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.5, prior: float = -1.5):
        """prior: the log-odds of a sentence without evidence. It is given, not learnt: samples of reviews are no fair draw."""
        self.alpha, self.beta, self.l1, self.l2, self.prior = alpha, beta, l1, l2, prior
        self.z, self.n = np.zeros(MASK + 1), np.zeros(MASK + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + self.prior, -30, 30)))
        g = (p - label) * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def dense(self) -> np.ndarray:
        """All weights as float32."""
        return self.weights(np.arange(MASK + 1)).astype(np.float32)
