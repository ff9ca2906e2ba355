"""What a query reads, without running it."""

from __future__ import annotations

from dataclasses import dataclass

from mdframe.functions.content import NAMES
from mdframe.lang import parse
from mdframe.lang import tree as t


@dataclass(frozen=True)
class Reads:
    """Names that a query uses, the body functions among them, and whether it needs bodies or file data at all."""

    names: frozenset[str]
    elements: frozenset[str]
    body: bool
    metadata: bool


def prefilter(query: str | t.Select) -> Reads:
    """What the scan of a select has to deliver; Catalyst prunes and pushes down accordingly."""
    select = parse(query) if isinstance(query, str) else query
    nodes = list(t.walk(select))
    names = {n.name for n in nodes if isinstance(n, t.Name | t.Call)} | {n.key for n in nodes if isinstance(n, t.Get)}
    elements = names & NAMES
    return Reads(frozenset(names), frozenset(elements), bool(elements or names & {"body", "content", "_content"}), "file" in names)
