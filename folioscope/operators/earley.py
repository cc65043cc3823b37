"""A weighted Earley parser over token classes that builds its chart once per sequence of classes.

Lines of one program share the classes of their first tokens, so the chart columns are kept in a trie keyed by class: a
line walks the trie, and only a sequence that was never seen runs the predictor, scanner and completer. A node of the trie
holds the last column and the nodes at which its items began, no other columns, and the trie is forgotten when it has
``MOST`` nodes, so memory is bounded whatever the lines are. Rules have
weights; of several derivations the one of the highest total weight is kept at each item (Viterbi). ``REST`` is the
terminal of everything that follows: where the grammar allows it, the parse may end and the rest of the line is free text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

REST = "REST"
MOST = 50_000


@dataclass(frozen=True)
class Rule:
    left: str
    right: tuple[str, ...]
    weight: float = 0.0


def grammar(text: str) -> list[Rule]:
    """Rules of the lines ``weight Left = right right | right``; a right side may be written as ``A B``."""
    rules = []
    for line in text.strip().splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            head, _, alternatives = line.partition(" = ")
            weight, left = head.split()
            rules += [Rule(left, tuple(a.split()), float(weight)) for a in alternatives.split("|")]
    return rules


@dataclass
class Node:
    """The chart after some sequence of classes: its last column, and the best complete parse if the rest is free text."""

    at: int
    column: dict
    origins: dict[int, Node]
    expects: frozenset[str] = frozenset()
    best: tuple[float, tuple] | None = None
    next: dict[str, Node | None] = field(default_factory=dict)


class Earley:
    def __init__(self, rules: list[Rule], start: str, scanner: re.Pattern[str]):
        self.rules, self.start, self.scanner = rules, start, scanner
        self.by_left: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            self.by_left.setdefault(r.left, []).append(i)
        self.nodes = 0
        self.root = self._close(Node(0, {(i, 0, 0): (rules[i].weight, ()) for i in self.by_left[start]}, {}))

    def _close(self, node: Node) -> Node:
        """Run predictor and completer over a column. An item is (rule, dot, origin) with its best (weight, parts)."""
        here, column, origins = node.at, node.column, node.origins
        agenda = list(column)
        while agenda:
            item = agenda.pop()
            rule, dot, origin = item
            weight, parts = column[item]
            r = self.rules[rule]
            new: list[tuple[tuple, tuple]] = []
            if dot < len(r.right):
                new = [((i, 0, here), (self.rules[i].weight, ())) for i in self.by_left.get(r.right[dot], ())]
            elif origin != here:
                done = (r.left, origin, here, parts)
                began = origins[origin]
                for (i, d, o), (w, p) in list(began.column.items()):
                    if d < len(self.rules[i].right) and self.rules[i].right[d] == r.left:
                        origins[o] = began if o == origin else began.origins[o]
                        new.append(((i, d + 1, o), (w + weight, (*p, done))))
            for k, v in new:
                if k not in column or v[0] > column[k][0]:
                    column[k] = v
                    agenda.append(k)
        # Origins of finished items only are needed no more.
        live = {o for i, d, o in column if d < len(self.rules[i].right)}
        node.origins = {o: n for o, n in origins.items() if o in live}
        expects = {self.rules[i].right[d] for i, d, _ in column if d < len(self.rules[i].right)} - self.by_left.keys()
        node.expects = frozenset(expects - {REST})
        complete = [(w, (*p, (REST, here, here, ()))) for (i, d, o), (w, p) in column.items() if o == 0 and self.rules[i].left == self.start and d == len(self.rules[i].right) - 1 and self.rules[i].right[d] == REST]
        node.best = max(complete, key=lambda x: x[0], default=None)
        return node

    def step(self, node: Node, kind: str) -> Node | None:
        """The chart after one more token, from the trie or newly scanned."""
        if kind not in node.next:
            scanned, origins = {}, {}
            for (i, d, o), (w, p) in node.column.items():
                r = self.rules[i]
                if d < len(r.right) and r.right[d] == kind:
                    scanned[(i, d + 1, o)] = (w, (*p, (kind, node.at, node.at + 1, ())))
                    origins[o] = node if o == node.at else node.origins[o]
            node.next[kind] = self._close(Node(node.at + 1, scanned, origins)) if scanned else None
            self.nodes += 1
        return node.next[kind]

    def parse(self, line: str) -> tuple[tuple, list[tuple[str, str]], int] | None:
        """The best parse of a line as (parts, tokens, where the free text begins), or None if no header fits."""
        if self.nodes > MOST:
            self.root.next.clear()
            self.nodes = 0
        node, at, tokens, best = self.root, 0, [], None
        while True:
            if node.best and (best is None or node.best[0] > best[0]):
                best = (node.best[0], node.best[1], len(tokens), at)
            if not node.expects:
                break
            m = self.scanner.match(line, at)
            if m is None:
                break
            following = self.step(node, m.lastgroup or "")
            if following is None:
                break
            tokens.append((m.lastgroup or "", m.group()))
            node, at = following, m.end()
        return best and (best[1], tokens[: best[2]], best[3])


def slots(parts: tuple, wanted: frozenset[str]) -> dict[str, tuple[int, int]]:
    """The token spans of the wanted nonterminals in a parse, the first of each name."""
    out: dict[str, tuple[int, int]] = {}
    stack = list(reversed(parts))
    while stack:
        name, a, b, below = stack.pop()
        if name in wanted:
            out.setdefault(name, (a, b))
        stack.extend(reversed(below))
    return out
