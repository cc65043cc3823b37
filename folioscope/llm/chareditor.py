"""Averaged perceptrons over characters that propose how a misread word was written and whether a line end parts a word.

:class:`CharEditor` scores for each character of a word ``keep``, ``delete``, ``replace`` by another character, and
``replace`` with ``insert`` of a second one behind it. It is trained on words of the corpus's own lexicon that are damaged with
confusions of scanned type, and learns which of them fit which neighbours. :class:`JoinEditor` scores, for a mark at a
line end, ``join`` (the mark and the line end go) against ``keep`` (the mark belongs to a compound).
"""

from __future__ import annotations

import random
from collections import defaultdict

#: What type is misread as, true string and printed string.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("o", "0"), ("l", "1"), ("i", "1"), ("l", "I"), ("i", "l"), ("l", "i"), ("a", "@"), ("t", "f"), ("f", "t"), ("s", "5"), ("s", "ſ"), ("h", "b"), ("b", "h"), ("b", "6"), ("g", "9"), ("g", "q"),
    ("n", "u"), ("u", "n"), ("n", "ii"), ("u", "ii"), ("w", "vv"), ("m", "rn"), ("rn", "m"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("li", "h"), ("h", "li"), ("in", "m"), ("nn", "m"), ("fi", "h"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "l"), ("l", "|"), ("s", "$"), ("i", "!"), ("r", "n"), ("y", "v"), ("v", "y"),
)
KEEP, DELETE = "=", ""


def damaged(word: str, edits: int, rng: random.Random) -> tuple[str, list[str]] | None:
    """A damaged word with the op that mends each of its characters; None if no confusion applies."""
    spots = [(i, a, b) for a, b in CONFUSIONS for i in range(len(word)) if word.startswith(a, i)]
    if not spots:
        return None
    chosen: list[tuple[int, str, str]] = []
    for i, a, b in rng.sample(spots, min(len(spots), edits * 3)):
        if len(chosen) < edits and all(i + len(a) <= j or j + len(x) <= i for j, x, _ in chosen):
            chosen.append((i, a, b))
    out, ops, at = [], [], 0
    for i, a, b in sorted(chosen):
        out += word[at:i]
        ops += [KEEP] * (i - at)
        out += b
        ops += [a] + [DELETE] * (len(b) - 1)
        at = i + len(a)
    out += word[at:]
    ops += [KEEP] * (len(word) - at)
    return "".join(out), ops


def features(word: str, i: int) -> list[str]:
    w = f"^^{word}$$"
    p, q, c, r, s = w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]
    return [c, "1" + q + c, "2" + c + r, "3" + q + c + r, "4" + p + q + c, "5" + c + r + s, "6" + p + q + c + r]


class CharEditor:
    def __init__(self, lexicon: list[str], seed: int = 5, rounds: int = 2, examples_wanted: int = 6000):
        """lexicon: at most a few thousand frequent words; the caller bounds it. A small one is damaged more often."""
        rng = random.Random(seed)
        examples = []
        copies = min(40, max(2, examples_wanted // max(1, len(lexicon))))
        for word in lexicon:
            for _ in range(copies):
                if got := damaged(word, 1 + (rng.random() < 0.2), rng):
                    examples.append(got)
            examples.append((word, [KEEP] * len(word)))
        self.ops: dict[str, list[str]] = defaultdict(lambda: [KEEP])
        for true, printed in CONFUSIONS if lexicon else ():
            for c, op in zip(printed, [true, DELETE], strict=False):
                if op not in self.ops[c]:
                    self.ops[c].append(op)
        for word, ops in examples:
            for c, op in zip(word, ops, strict=True):
                if op not in self.ops[c]:
                    self.ops[c].append(op)
        self.ops = dict(self.ops)
        weights: dict[tuple[str, str], float] = defaultdict(float)
        totals: dict[tuple[str, str], float] = defaultdict(float)
        t = 0
        for _ in range(rounds):
            rng.shuffle(examples)
            for word, ops in examples:
                for i, gold in enumerate(ops):
                    options = self.ops[word[i]]
                    if len(options) == 1:
                        continue
                    t += 1
                    fs = features(word, i)
                    guess = max(options, key=lambda op: sum(weights.get((f, op), 0.0) for f in fs))
                    if guess != gold:
                        for f in fs:
                            weights[f, gold] += 1.0
                            totals[f, gold] += t
                            weights[f, guess] -= 1.0
                            totals[f, guess] -= t
        self.weights = {k: v - totals[k] / max(t, 1) for k, v in weights.items() if v}

    def proposals(self, word: str) -> list[str]:
        """Mended forms of a word: every single edit, best first, pairs of the best five, and all odd characters mended at once."""
        scored = []
        for i, c in enumerate(word):
            options = self.ops.get(c, [KEEP])
            if len(options) == 1:
                continue
            fs = features(word, i)
            score = {op: sum(self.weights.get((f, op), 0.0) for f in fs) for op in options}
            scored += [(s - score[KEEP], i, op) for op, s in score.items() if op != KEEP]
        scored.sort(key=lambda x: (-x[0], x[1], x[2]))
        edits: list[tuple[tuple[int, str], ...]] = [((i, op),) for _, i, op in scored if op != DELETE]
        # A replacement of two printed characters by one deletes the one beside it.
        edits += [((i, op), (i + 1, DELETE)) for _, i, op in scored if op != DELETE and i + 1 < len(word) and (word[i : i + 2] in PRINTED)]
        top = [(i, op) for _, i, op in scored[:5] if op != DELETE]
        edits += [(a, b) for k, a in enumerate(top) for b in top[k + 1 :] if a[0] != b[0]]
        odd: dict[int, str] = {}
        for _, i, op in scored:
            if not word[i].isalpha() or word[i] == "ſ":
                odd.setdefault(i, op)
        if len(odd) > 1:
            edits.append(tuple(odd.items()))
        out = []
        for edit in edits:
            change = dict(edit)
            mended = "".join(change.get(i, c) if i in change else c for i, c in enumerate(word))
            if mended != word and mended not in out:
                out.append(mended)
        return out


PRINTED = {b for _, b in CONFUSIONS if len(b) == 2}


def join_cues(soft: bool, small: bool, whole: int, compound: int, tail: int, known: int) -> dict[str, bool]:
    """What is told of a word broken at a line end: its mark, whether it goes on in small letters, and how often the corpus has its readings.

    Works on plain values and on Catalyst columns alike.
    """
    return {
        "soft": soft, "hyphen": ~soft if not isinstance(soft, bool) else not soft, "small": small, "whole": whole > 0, "no_whole": whole == 0, "compound": compound > 0, "no_compound": compound == 0,
        "more_whole": whole > compound, "more_compound": compound > whole, "tail": tail >= known, "no_tail": tail < known,
    }


#: Cues that count together as well as alone.
TOGETHER = (("hyphen", "no_whole", "no_compound", "small", "no_tail"), ("hyphen", "no_whole", "no_compound", "tail"), ("soft", "no_compound"), ("soft", "whole"), ("hyphen", "more_compound"), ("hyphen", "no_whole", "no_compound"), ("soft", "no_whole", "compound"))


class JoinEditor:
    """The line-join operation, learnt from words and compounds of the corpus that are broken at a line end on purpose."""

    def __init__(self, counts: dict[str, int], known: int, marks_soft: float = 0.5, seed: int = 5, rounds: int = 4, most: int = 3000):
        """counts: frequent words and compounds of the corpus, bounded by the caller; known: from how many sights a word is known.

        Each is broken once as it is, less this one sight of it, and once as if the corpus had it nowhere else. Compounds,
        which are fewer, are broken as often as words in all.
        """
        rng = random.Random(seed)
        words = sorted((w for w in counts if w.isalpha() and len(w) >= 5), key=lambda w: (-counts[w], w))[:most]
        compounds = sorted((w for w in counts if w.count("-") == 1 and w.replace("-", "").isalpha()), key=lambda w: (-counts[w], w))[:most]
        examples: list[tuple[dict[str, bool], bool]] = []
        for w in words:
            at = rng.randrange(2, len(w) - 1)
            soft, tail = rng.random() < marks_soft, counts.get(w[at:], 0)
            for n in (counts[w] - 1, 0):
                examples.append((join_cues(soft, True, n, 0, tail, known), True))
        for w in compounds * max(1, len(words) // max(1, len(compounds))):
            tail = counts.get(w.split("-")[1], 0)
            for n in (counts[w] - 1, 0):
                examples.append((join_cues(False, True, counts.get(w.replace("-", ""), 0), n, max(tail, n and known), known), False))
        weights: dict[tuple[str, ...], float] = defaultdict(float)
        totals: dict[tuple[str, ...], float] = defaultdict(float)
        t = 0
        for _ in range(rounds):
            rng.shuffle(examples)
            for cues, join in examples:
                t += 1
                active = [k for k in self.keys() if all(cues[c] for c in k)]
                if (sum(weights[k] for k in active) > 0) != join:
                    for k in active:
                        weights[k] += 1.0 if join else -1.0
                        totals[k] += t if join else -t
        self.weights = {k: weights[k] - totals[k] / max(t, 1) for k in self.keys() if weights[k] or totals[k]}

    @staticmethod
    def keys() -> tuple[tuple[str, ...], ...]:
        return (*((c,) for c in join_cues(True, True, 0, 0, 0, 1)), *TOGETHER)
