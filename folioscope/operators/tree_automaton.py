"""A deterministic bottom-up tree automaton over JSON-like trees.

A rule gives the state of a node from its symbol and the states of its children. Scalars are leaves, arrays take the
set of their elements' states, objects the mapping of key to state. The first matching rule wins; a node that no rule
matches gets the state ``other``. States name the structural variant of a node and so the table that it is routed to.
The same rules run in two ways: :meth:`TreeAutomaton.state` walks parsed JSON of any depth without recursion, and
:meth:`TreeAutomaton.column` compiles the rules into a Catalyst expression over a typed struct and the states of its
children, which are compiled first.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ObjectRule:
    """``state`` for an object that has all of ``needs`` (non-null), none of ``bars`` and, if ``only`` is set, no other keys.

    ``children`` allows, for a key, only these states below it; ``some`` asks for at least one of these.
    """

    state: str
    needs: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()
    only: tuple[str, ...] | None = None
    children: dict[str, frozenset[str]] = field(default_factory=dict, hash=False)
    some: dict[str, frozenset[str]] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class TreeAutomaton:
    scalars: dict[str, str]
    objects: tuple[ObjectRule, ...]
    list_state: str = "group"
    other: str = "other"

    def leaf(self, value: object) -> str:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        return self.scalars.get(kind, self.other)

    def object_state(self, states: Mapping[str, frozenset[str]], present: set[str]) -> str:
        for rule in self.objects:
            if any(k not in present for k in rule.needs) or any(k in present for k in rule.bars):
                continue
            if rule.only is not None and not states.keys() <= set(rule.only):
                continue
            if all(states.get(k, frozenset()) <= allowed for k, allowed in rule.children.items()) and all(states.get(k, frozenset()) & wanted for k, wanted in rule.some.items()):
                return rule.state
        return self.other

    def state(self, root: object) -> tuple[str, dict[int, str]]:
        """The state of the root and of every object or array below it, by ``id``; children come before parents."""
        order, stack, states = [], [root], {}
        while stack:
            node = stack.pop()
            if isinstance(node, (dict, list)):
                order.append(node)
                stack.extend(node.values() if isinstance(node, dict) else node)
        for node in reversed(order):
            if isinstance(node, list):
                states[id(node)] = self.list_state
            else:
                below = {k: frozenset(self._of(x, states) for x in (v if isinstance(v, list) else [v]) if x is not None) for k, v in node.items()}
                states[id(node)] = self.object_state(below, {k for k, v in node.items() if v is not None})
        return self._of(root, states), states

    def _of(self, value: object, states: dict[int, str]) -> str:
        return states[id(value)] if isinstance(value, (dict, list)) else self.leaf(value)

    def column(self, struct: Column, states: Mapping[str, Column] | None = None) -> Column:
        """The rules as one CASE expression over a typed struct; ``states`` has, for a key, the array of the states below it.

        ``only`` is settled by the type of the struct. A rule on child states whose key has no column here is an error.
        """
        out = None
        for rule in self.objects:
            test = F.lit(True)
            for k in rule.needs:
                test = test & struct[k].isNotNull()
            for k in rule.bars:
                test = test & struct[k].isNull()
            for k, allowed in rule.children.items():
                test = test & (F.size(F.array_except(self._below(states, k), _array(allowed))) == 0)
            for k, wanted in rule.some.items():
                test = test & F.arrays_overlap(self._below(states, k), _array(wanted))
            out = F.when(F.coalesce(test, F.lit(False)), rule.state) if out is None else out.when(F.coalesce(test, F.lit(False)), rule.state)
        return out.otherwise(self.other) if out is not None else F.lit(self.other)

    @staticmethod
    def _below(states: Mapping[str, Column] | None, key: str) -> Column:
        if not states or key not in states:
            raise ValueError(f"no states for {key}")
        return F.coalesce(states[key], F.array().cast("array<string>"))


def _array(names: frozenset[str]) -> Column:
    return F.array(*map(F.lit, sorted(names)))


ITEM_STATES = frozenset({"item_text", "item_scalar", "item_branch", "item_node", "group"})

#: List items: a bare string, or an object of text and children whose children are items again.
ITEMS = TreeAutomaton(
    scalars={"string": "item_text", "number": "item_scalar", "boolean": "item_scalar", "null": "nothing"},
    objects=(
        ObjectRule("item_branch", needs=("text", "children"), only=("text", "children"), children={"children": ITEM_STATES}),
        ObjectRule("item_node", only=("text", "children"), children={"children": ITEM_STATES}),
    ),
    other="item_other",
)

#: Warnings: those that name the block they are about, and others.
WARNINGS = TreeAutomaton(scalars={}, objects=(ObjectRule("warning_of_block", needs=("block_id",)), ObjectRule("warning_plain", needs=("code",)), ObjectRule("warning_plain", needs=("message",))), other="warning_bare")

#: Table rows, as an object of their cells: with all cells, with some or with none.
ROWS = TreeAutomaton(
    scalars={"string": "cell", "null": "gap"},
    objects=(ObjectRule("row_full", children={"cells": frozenset({"cell"})}, some={"cells": frozenset({"cell"})}), ObjectRule("row_gapped", some={"cells": frozenset({"cell"})})),
    other="row_empty",
)

#: Blocks, most specific first. A table with a row that has a cell, or with headers, is filled.
BLOCKS = TreeAutomaton(
    scalars={},
    objects=(
        ObjectRule("table_block", needs=("table",)),
        ObjectRule("list_block", needs=("items",)),
        ObjectRule("figure_block", needs=("description",)),
        ObjectRule("figure_block", needs=("diagram_text",)),
        ObjectRule("figure_block", needs=("caption",), bars=("text",)),
        ObjectRule("heading_block", needs=("text", "level")),
        ObjectRule("text_block", needs=("text",)),
    ),
    other="bare_block",
)

#: Where each state is routed: the kind of element that its table holds.
ROUTES = {
    **dict.fromkeys(("table_block", "list_block", "figure_block", "heading_block", "text_block", "bare_block"), "block"),
    **dict.fromkeys((*sorted(ITEM_STATES), "item_other"), "item"),
    **dict.fromkeys(("row_full", "row_gapped", "row_empty"), "table_row"),
    **dict.fromkeys(("warning_of_block", "warning_plain", "warning_bare"), "warning"),
}
