"""YAML mapping keys by dotted path, with aliases and merge keys resolved, from parser events.

A document's events become a tree once. Listing then goes through a work list of (value, path,
anchors being expanded): a mapping there gives its entries, which are its own keys and, behind them,
the keys that its merges add. Nothing recurses, so nesting is limited by memory only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import yaml

from symquarry.extract.base import Symbol

MAX_DEPTH = 10
MERGE = "<<"


@dataclass
class _Value:
    """A scalar, alias ("*"), sequence ("[") or mapping ("{", keys and values in turn)."""

    form: str
    line: int
    name: str = ""
    parts: list[_Value] = field(default_factory=list)

    def entries(self) -> list[tuple[str, int, _Value]]:
        """(name, line, value) of a mapping's keys as they stand."""
        return [(k.key_name(), k.line, v) for k, v in zip(self.parts[::2], self.parts[1::2])]

    def key_name(self) -> str:
        return f"*{self.name}" if self.form == "*" else self.name

    def below(self) -> Iterator[_Value]:
        """This value and all inside it, in the order of the text; aliases stay as they are."""
        todo = [self]
        while todo:
            value = todo.pop()
            yield value
            todo += reversed(value.parts)


def _scalar_name(e: yaml.ScalarEvent, text: str) -> str:
    """A scalar as it is written: without its quotes, escapes kept."""
    if e.style in ("'", '"'):
        raw = text[e.start_mark.index : e.end_mark.index]
        first, last = raw.find(e.style), raw.rfind(e.style)
        if 0 <= first < last:
            return raw[first + 1 : last]
    return e.value


def _trees(text: str) -> Iterator[tuple[_Value, dict[str, _Value]]]:
    """(root, anchors) of each document; the first of equal anchors counts; an error ends the stream after what was read."""
    loader = getattr(yaml, "CLoader", yaml.Loader)(text)
    nested: list[_Value] = []
    root, anchors = None, {}
    try:
        while loader.check_event():
            e = loader.get_event()
            if isinstance(e, yaml.DocumentStartEvent):
                root, anchors = None, {}
            elif isinstance(e, yaml.DocumentEndEvent):
                if root:
                    yield root, anchors
                root = None
            elif isinstance(e, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
                nested.pop()
            elif isinstance(e, yaml.NodeEvent):
                line = e.start_mark.line + 1
                if isinstance(e, yaml.AliasEvent):
                    value = _Value("*", line, e.anchor)
                elif isinstance(e, yaml.ScalarEvent):
                    value = _Value("", line, _scalar_name(e, text))
                else:
                    value = _Value("{" if isinstance(e, yaml.MappingStartEvent) else "[", line)
                if e.anchor and value.form != "*":
                    anchors.setdefault(e.anchor, value)
                if nested:
                    nested[-1].parts.append(value)
                else:
                    root = value
                if value.form in ("{", "["):
                    nested.append(value)
    except yaml.YAMLError:
        if root:
            yield root, anchors
    finally:
        loader.dispose()


def _merged(mapping: _Value, anchors: dict[str, _Value], inside: frozenset[str]) -> Iterator[tuple[str, int, _Value, frozenset[str]]]:
    """A mapping's own keys, then those its merges add; of keys that merges add the first stays.

    Any alias inside a merge's value is a source, whose own merges come right behind its keys.
    ``inside``: anchors being expanded, which are no sources again.
    """
    sources = lambda m, seen: [(v.name, seen) for name, _, value in m.entries() if name == MERGE for v in value.below() if v.form == "*"]
    known = {name for name, _, _ in mapping.entries()}
    yield from ((*entry, inside) for entry in mapping.entries() if entry[0] != MERGE)
    todo = sources(mapping, inside)[::-1]
    while todo:
        name, seen = todo.pop()
        found = None if name in seen or name not in anchors else next((v for v in anchors[name].below() if v.form == "{"), None)
        if found is None:
            continue
        seen = seen | {name}
        for entry in found.entries():
            if entry[0] != MERGE and entry[0] not in known:
                known.add(entry[0])
                yield (*entry, seen)
        todo += sources(found, seen)[::-1]


def _keys(root: _Value, anchors: dict[str, _Value]) -> Iterator[Symbol]:
    todo: list[tuple[int | None, _Value, tuple[str, ...], frozenset[str]]] = [(None, root, (), frozenset())]
    while todo:
        line, value, path, inside = todo.pop()
        if line is not None:
            yield Symbol(line, "key", ".".join(path))
        if value.form == "{":
            entries = list(_merged(value, anchors, inside)) if len(path) < MAX_DEPTH else []
            todo += [(at, v, (*path, name), seen) for name, at, v, seen in reversed(entries)]
        elif value.form == "[":
            todo += [(None, v, path, inside) for v in reversed(value.parts)]
        elif value.form == "*" and value.name in anchors and value.name not in inside:
            todo.append((None, anchors[value.name], path, inside | {value.name}))


def yaml_keys(text: str, resolve: bool = True) -> list[Symbol]:
    """Every mapping key; without ``resolve`` aliases and merges add nothing."""
    text = text.removeprefix("\ufeff")
    return [s for root, anchors in _trees(text) for s in _keys(root, anchors if resolve else {})]
