"""Logical algebra of queries and updates."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quadlight.terms import Node, Var


@dataclass
class Bgp:
    triples: list[tuple]  # (subject, predicate, object): nodes


@dataclass
class PathPattern:
    start: Node
    path: Any
    end: Node


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class Union:
    parts: list


@dataclass
class Graph:
    name: Node
    pattern: Any


@dataclass
class Service:
    endpoint: Node
    pattern: Any
    silent: bool = False


@dataclass
class Extend:
    pattern: Any
    var: str
    expr: Any


@dataclass
class Filter:
    pattern: Any
    expr: Any


@dataclass
class Table:
    names: list[str]
    rows: list[list]  # nodes or None


@dataclass
class SubSelect:
    query: Query


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    where: Any
    items: list = field(default_factory=list)  # (name, expression or None); empty: all
    distinct: bool = False
    group: list | None = None  # (expression, name or None)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (ascending, expression)
    limit: int | None = None
    offset: int | None = None
    template: list = field(default_factory=list)
    targets: list = field(default_factory=list)
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    trailing: Any = None  # VALUES after the groups
    base: str = ""


@dataclass
class Update:
    kind: str  # modify, load, clear, create, copy, move, add
    delete: list = field(default_factory=list)  # (s, p, o, g)
    insert: list = field(default_factory=list)
    where: Any = None
    graph: Any = None  # IRI, or default, named, all
    target: Any = None
    url: str | None = None
    silent: bool = False
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    base: str = ""


# Expressions: Node, or ("op", args...) with op a lower-case name; ("call", iri, [args], distinct);
# ("agg", name, [args], distinct, separator); ("exists", pattern).
# Paths: ("iri", iri), ("inv", p), ("seq", a, b), ("alt", a, b), ("opt", p), ("star", p), ("plus", p),
# ("not", [iris], [inverse iris]), ("repeat", p, low, high or None).


def variables(x: Any) -> set[str]:
    """Names of the variables that a pattern can bind."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Bgp):
        return {n.name for t in x.triples for n in t if isinstance(n, Var)}
    if isinstance(x, PathPattern):
        return {n.name for n in (x.start, x.end) if isinstance(n, Var)}
    if isinstance(x, (Join, LeftJoin)):
        return variables(x.left) | variables(x.right)
    if isinstance(x, Minus):
        return variables(x.left)
    if isinstance(x, Union):
        return set().union(*map(variables, x.parts))
    if isinstance(x, Graph):
        return variables(x.pattern) | (variables(x.name) if isinstance(x.name, Var) else set())
    if isinstance(x, Service):
        return variables(x.pattern) | (variables(x.endpoint) if isinstance(x.endpoint, Var) else set())
    if isinstance(x, Extend):
        return variables(x.pattern) | {x.var}
    if isinstance(x, Filter):
        return variables(x.pattern)
    if isinstance(x, Table):
        return set(x.names)
    if isinstance(x, SubSelect):
        q = x.query
        return {n for n, _ in q.items} if q.items else variables(q.where)
    return set()


def expression_variables(e: Any) -> set[str]:
    """Names of the variables that an expression reads."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, tuple):
        if e[0] == "exists":
            return variables(e[1])
        return set().union(set(), *(expression_variables(x) for x in e[1:]))
    if isinstance(e, list):
        return set().union(set(), *(expression_variables(x) for x in e))
    return set()


def mentions(x: Any) -> set[str]:
    """Names of all variables that stand anywhere in a pattern or expression, but for what subqueries keep to themselves."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, SubSelect):
        return variables(x)
    if isinstance(x, Table):
        return set(x.names)
    if isinstance(x, Extend):
        return {x.var} | mentions(x.pattern) | mentions(x.expr)
    if isinstance(x, (list, tuple)):
        return set().union(set(), *map(mentions, x))
    if hasattr(x, "__dataclass_fields__"):
        return set().union(set(), *(mentions(getattr(x, f)) for f in x.__dataclass_fields__))
    return set()


def has_aggregate(e: Any) -> bool:
    if isinstance(e, tuple):
        return e[0] == "agg" or e[0] != "exists" and any(has_aggregate(x) for x in e[1:])
    return isinstance(e, list) and any(has_aggregate(x) for x in e)
