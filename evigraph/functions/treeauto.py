"""A bottom-up tree automaton over JSON values.

Every value gets a state from its own kind and the states of its children; an object's state
is that of the first rule whose required keys carry admitted child states. Keys are compared
by letters and digits in lower case, so ``formattedType`` and ``formatted_type`` agree.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from evigraph.functions.canon import bare_key

TEXTS = frozenset({"text", "array_text", "json_text"})


@dataclass(frozen=True)
class Rule:
    """An object is in ``state`` if each needed key has an admitted state, one of ``any_of`` is
    there and none of ``without``."""

    state: str
    needs: dict[str, frozenset[str]]
    any_of: frozenset[str] = frozenset()
    without: frozenset[str] = frozenset()


@dataclass
class Tree:
    """A value with its state; ``items`` are (key or None, child) in their order."""

    state: str
    value: object = None
    items: list[tuple[str | None, Tree]] = field(default_factory=list)

    def child(self, name: str) -> Tree | None:
        return next((t for k, t in self.items if k is not None and bare_key(k) == name), None)

    def text(self, name: str) -> str | None:
        t = self.child(name)
        if t is None or t.value is None or t.items:
            return None
        return t.value if isinstance(t.value, str) else json.dumps(t.value)


class TreeAutomaton:
    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules

    def run(self, value: object) -> Tree:
        """The value's tree, states from the leaves up. Texts that hold JSON arrays or objects are opened."""
        if isinstance(value, dict):
            items = [(k, self.run(v)) for k, v in value.items()]
            return Tree(self._object_state(items), value, items)
        if isinstance(value, list):
            items = [(None, self.run(v)) for v in value]
            states = {t.state for _, t in items}
            one = states.pop() if len(states) == 1 else "mixed" if states else "empty"
            return Tree(f"list:{'text' if one in TEXTS else one}", value, items)
        if value is None:
            return Tree("null")
        if isinstance(value, bool):
            return Tree("bool", value)
        if isinstance(value, int | float):
            return Tree("number", value)
        head = value.lstrip()[:1]
        if head in ("[", "{"):
            try:
                opened = json.loads(value)
            except (ValueError, RecursionError):
                opened = None
            if isinstance(opened, dict | list):
                return self.run(opened)
            if head == "{" and value.rstrip().endswith("}"):
                return Tree("array_text", value, [(None, Tree("text" if v is not None else "null", v)) for v in array_text(value)])
        return Tree("text", value)

    def _object_state(self, items: list[tuple[str, Tree]]) -> str:
        states = {bare_key(k): t.state for k, t in items}
        for rule in self.rules:
            if (
                all(states.get(k) in ok for k, ok in rule.needs.items())
                and (not rule.any_of or rule.any_of & states.keys())
                and not rule.without & states.keys()
            ):
                return rule.state
        members = set(states.values())
        if len(members) == 1:
            return f"map:{members.pop()}"
        if members and all(s.endswith("_body") or s == "object" for s in members):
            return "map:mixed"
        return "object" if members else "map:empty"


def array_text(text: str) -> list[str | None]:
    """Items of a PostgreSQL array literal such as ``{a,"b,c",NULL}``."""
    out: list[str | None] = []
    body, i = text.strip()[1:-1], 0
    if not body.strip():
        return out
    while i <= len(body):
        while i < len(body) and body[i].isspace():
            i += 1
        if i < len(body) and body[i] == '"':
            item, i = [], i + 1
            while i < len(body) and body[i] != '"':
                if body[i] == "\\" and i + 1 < len(body):
                    i += 1
                item.append(body[i])
                i += 1
            i = body.find(",", i)
            out.append("".join(item))
            if i < 0:
                break
        else:
            end = body.find(",", i)
            raw = body[i : end if end >= 0 else len(body)].strip()
            out.append(None if raw.upper() == "NULL" else raw)
            if end < 0:
                break
            i = end
        i += 1
    return out
