"""JSONPath over the documents of a capture: a pattern is read once into steps, and each document is looked at by itself."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd

_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_STEP = re.compile(rf"(?P<deep>\.\.)?(?:\.?(?P<name>\*|[^\W\d][\w-]*)|\[(?:(?P<all>\*)|(?P<index>\d+)|(?P<key>{_QUOTED})|\?(?P<test>(?:[^\]'\"]|{_QUOTED})*))\])")
_TERM = re.compile(rf"\s*(?P<no>!)?\s*@(?P<path>[^=!<>\s]*)\s*(?:(?P<how>[!=]=)\s*(?P<value>{_QUOTED}|-?\d[\d.eE+-]*|true|false|null))?\s*")
_ABSENT = object()

Step = tuple[str, object, bool]


def _text(quoted: str) -> str:
    return re.sub(r"\\(.)", r"\1", quoted[1:-1])


def _split(test: str, sign: str) -> list[str]:
    """test at each sign that isn't within quotes."""
    pieces, at = [], 0
    for found in re.finditer(rf"{_QUOTED}|{re.escape(sign)}", test):
        if found[0] == sign:
            pieces.append(test[at : found.start()])
            at = found.end()
    return [*pieces, test[at:]]


def _term(text: str) -> Callable[[object], bool]:
    found = _TERM.fullmatch(text)
    if not found:
        raise ValueError(f"a test that isn't known: {text}")
    path, how, no = steps("$" + found["path"]), found["how"], bool(found["no"])
    value = found["value"] and (_text(found["value"]) if found["value"][0] in "'\"" else json.loads(found["value"]))

    def holds(node: object) -> bool:
        met = list(matches(path, node))
        if not how:
            return bool(met) != no
        one = met[0] if len(met) == 1 else _ABSENT
        return (type(one) is type(value) or {type(one), type(value)} == {int, float}) and (one == value) if how == "==" else not ((type(one) is type(value) or {type(one), type(value)} == {int, float}) and one == value)

    return holds


def _test(text: str) -> Callable[[object], bool]:
    anyone = [[_term(t) for t in _split(part, "&&")] for part in _split(text, "||")]
    return lambda node: any(all(t(node) for t in every) for every in anyone)


def steps(pattern: str) -> list[Step]:
    """Names, indexes, wildcards, descendants and tests (==, !=, being there, joined by && and ||) of a pattern; any other raises ValueError."""
    if not pattern.startswith("$"):
        raise ValueError(f"a path begins with $: {pattern}")
    out, at = [], 1
    while at < len(pattern):
        found = _STEP.match(pattern, at)
        if not found or (found["name"] and not pattern[at] == "."):
            raise ValueError(f"a path that isn't known: {pattern}")
        deep, at = bool(found["deep"]), found.end()
        if found["name"] not in (None, "*"):
            out.append(("name", found["name"], deep))
        elif found["key"]:
            out.append(("name", _text(found["key"]), deep))
        elif found["index"]:
            out.append(("index", int(found["index"]), deep))
        elif found["test"] is not None:
            out.append(("test", _test(found["test"]), deep))
        else:
            out.append(("all", None, deep))
    return out


def _children(node: object) -> list[object]:
    return list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []


def _down(node: object) -> Iterator[object]:
    yield node
    for child in _children(node):
        yield from _down(child)


def matches(path: list[Step], node: object) -> Iterator[object]:
    """What path finds below node, in its order."""
    if not path:
        yield node
        return
    (kind, what, deep), rest = path[0], path[1:]
    for here in _down(node) if deep else [node]:
        if kind == "name":
            found = [here[what]] if isinstance(here, dict) and what in here else []
        elif kind == "index":
            found = here[what : what + 1] if isinstance(here, list) else []
        else:
            found = [c for c in _children(here) if kind == "all" or what(c)]
        for one in found:
            yield from matches(rest, one)


def in_document(path: list[Step], document: object, position: int, whole: bool) -> object:
    """The last non-null match in one document; with `whole`, of a path over the array of all of them, in which it stands at position."""
    if whole and path and not path[0][2]:
        kind, what, _ = path[0]
        if kind == "name" or (kind == "index" and what != position) or (kind == "test" and not what(document)):
            return None
        path = path[1:]
    return next((m for m in reversed(list(matches(path, document))) if m is not None), None)


def hits(declared: dict[tuple[str, str], list[tuple[str, list[Step], bool]]], adapters: pd.Series, streams: pd.Series, positions: pd.Series, lines: pd.Series) -> pd.Series:
    """For each line what the captures declared for its adapter and stream find in it, as a JSON object of JSON texts; null for a line that isn't JSON."""

    def of(adapter: str, stream: str, position: int, line: str) -> str | None:
        try:
            document = json.loads(line)
        except ValueError:
            return None
        found = {name: in_document(path, document, position, whole) for name, path, whole in declared.get((adapter, stream), [])}
        return json.dumps({name: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for name, v in found.items() if v is not None}, ensure_ascii=False)

    return pd.Series([of(*x) for x in zip(adapters, streams, positions, lines, strict=True)], dtype=object)
