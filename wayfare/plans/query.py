"""The compact query language: vertex lookup, BFS, reachability and path patterns.

    predicate := name ":" type "[" text "]"          type: string, int, float, double; others read as string
    lookup    := predicate
    bfs       := predicate ":" depth [ "//" start "//" end ]       start and end are read and ignored
    reach     := depth "@" predicate "@" predicate [ "//" side ]   side: 0 from the sources, 1 from the sinks
    path      := step ("@" step)* [ "//" position ]
    step      := predicate | direction "?" [ predicate ]           "out", any other word is IN
    batch     := query (";" query)*

Text in brackets is taken as it is, so it may hold any of ``@ : ? ; /`` and spaces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

OUT, IN = "out", "in"


class QueryError(ValueError):
    """The text is no query of the kind asked for."""


@dataclass(frozen=True)
class Predicate:
    """One property equals one literal; compared as text, or by value where both are numbers."""

    name: str
    value: str
    type: str = "string"

    @property
    def text(self) -> str:
        """The literal as it is compared: numbers in their plain form."""
        if self.type == "int":
            return str(int(self.value))
        if self.type in ("float", "double"):
            return str(float(self.value))
        return self.value

    @property
    def number(self) -> Decimal | None:
        """The literal's value, where its type is a number."""
        return Decimal(self.value.strip()) if self.type in ("int", "float", "double") else None


@dataclass(frozen=True)
class EdgeStep:
    direction: str
    predicate: Predicate | None = None


@dataclass(frozen=True)
class BfsQuery:
    roots: Predicate
    depth: int


@dataclass(frozen=True)
class ReachQuery:
    depth: int
    source: Predicate
    sink: Predicate
    side: int | None = None


@dataclass(frozen=True)
class PathQuery:
    """Vertex predicates (None: any vertex) around edge steps; one more vertex than edges."""

    vertices: tuple[Predicate | None, ...]
    edges: tuple[EdgeStep, ...] = field(default=())
    start: int | None = None  # index among the vertices


def split_outside(text: str, separator: str) -> list[str]:
    """Split where the separator stands outside brackets."""
    out, depth, last, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c == "[":
            depth += 1
        elif c == "]":
            depth = max(0, depth - 1)
        elif depth == 0 and text.startswith(separator, i):
            out.append(text[last:i])
            i += len(separator)
            last = i
            continue
        i += 1
    return [*out, text[last:]]


_PREDICATE = re.compile(r"\s*([^:\[\]@?]+):([A-Za-z]\w*)\[(.*)\]\s*", re.S)


def parse_predicate(text: str) -> Predicate:
    m = _PREDICATE.fullmatch(text)
    if not m:
        raise QueryError(f"no predicate name:type[value]: {text!r}")
    p = Predicate(m[1].strip(), m[3], m[2] if m[2] in ("string", "int", "float", "double") else "string")
    try:
        p.text  # noqa: B018
    except ValueError:
        raise QueryError(f"{m[3]!r} is no {m[2]}") from None
    return p


def _number(text: str, what: str) -> int:
    try:
        return int(text.strip())
    except ValueError:
        raise QueryError(f"{what} is no number: {text!r}") from None


def parse_bfs(text: str) -> BfsQuery:
    head = split_outside(text, "//")[0]
    parts = split_outside(head, ":")
    if len(parts) != 3:
        raise QueryError(f"no BFS query name:type[value]:depth: {text!r}")
    depth = _number(parts[2], "depth")
    if depth < 0:
        raise QueryError("depth is negative")
    return BfsQuery(parse_predicate(":".join(parts[:2])), depth)


def parse_reach(text: str) -> ReachQuery:
    head, *rest = split_outside(text, "//")
    parts = split_outside(head, "@")
    if len(parts) != 3:
        raise QueryError(f"no reachability query depth@source@sink: {text!r}")
    side = _number(rest[0], "side") if rest and rest[0].strip() else None
    if side not in (None, 0, 1):
        raise QueryError("side is 0 or 1")
    return ReachQuery(_number(parts[0], "depth"), parse_predicate(parts[1]), parse_predicate(parts[2]), side)


def parse_path(text: str) -> PathQuery:
    head, *rest = split_outside(text, "//")
    vertices: list[Predicate | None] = []
    edges: list[EdgeStep] = []
    for token in split_outside(head, "@"):
        mark = split_outside(token, "?")
        if len(mark) == 1:
            if len(vertices) > len(edges):
                raise QueryError(f"two vertex steps in a row: {text!r}")
            vertices.append(parse_predicate(token))
        else:
            if len(vertices) == len(edges):
                vertices.append(None)  # a pattern that begins with an edge, or two edges in a row
            rest_of = "?".join(mark[1:]).strip()
            edges.append(EdgeStep(OUT if mark[0].strip() == "out" else IN, parse_predicate(rest_of) if rest_of else None))
    if len(vertices) == len(edges):
        vertices.append(None)
    start = None
    if rest and rest[0].strip():
        position = _number(rest[0], "start position")
        if position % 2 or not 0 <= position < 2 * len(vertices):
            raise QueryError(f"start position {position} is no vertex step")
        start = position // 2
    return PathQuery(tuple(vertices), tuple(edges), start)


def parse_batch(text: str) -> list[str]:
    return [q.strip() for q in split_outside(text, ";") if q.strip()]


def without_access_flag(text: str) -> str:
    """Drop a leading ``-i`` or ``-ni``: which access path serves a lookup is the optimiser's choice here."""
    return re.sub(r"^\s*-n?i\s+", "", text)
