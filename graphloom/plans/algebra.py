"""What a parsed query consists of."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..terms import Term


@dataclass(frozen=True)
class Var:
    name: str
    hidden: bool = False  # anonymous and blank nodes: never projected by *


Node = Var | Term


@dataclass(frozen=True)
class Pattern:
    s: Node
    p: Node
    o: Node

    @property
    def nodes(self) -> tuple[Node, Node, Node]:
        return self.s, self.p, self.o


@dataclass(frozen=True)
class Call:
    """An expression: an operator or function with its arguments."""

    op: str
    args: tuple


@dataclass
class TableFunction:
    name: str
    inputs: list[Node]
    outputs: list[Var]


@dataclass
class Group:
    patterns: list[Pattern] = field(default_factory=list)
    filters: list = field(default_factory=list)
    functions: list[TableFunction] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    gjoins: list[list[Group]] = field(default_factory=list)


@dataclass
class Query:
    projection: list[Var]  # empty: all
    group: Group
    mode: str = "all"  # all, distinct, reduced, count, duplicates
    order: list[tuple[str | None, bool]] = field(default_factory=list)  # (variable or None for the count, descending)
    limit: int | None = None


def variables(expr) -> set[str]:
    if isinstance(expr, Var):
        return {expr.name}
    if isinstance(expr, Call):
        return set().union(*(variables(a) for a in expr.args)) if expr.args else set()
    return set()


def group_variables(group: Group) -> dict[str, Var]:
    """All variables that patterns, functions and inner groups may bind, by name."""
    found: dict[str, Var] = {}
    for p in group.patterns:
        found.update({n.name: n for n in p.nodes if isinstance(n, Var)})
    for f in group.functions:
        found.update({v.name: v for v in f.outputs})
    for inner in [*group.optionals, *(g for parts in [*group.unions, *group.gjoins] for g in parts)]:
        found.update(group_variables(inner))
    return found
