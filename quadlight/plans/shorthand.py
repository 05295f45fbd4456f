"""Short builders of algebra, for programs that make queries without text.

    solve(project("n", "c")(where(triple("?x", NS + "name", "?n"), triple("?x", NS + "acctbal", "?b"), gt("?b", 0)))
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from quadlight.plans import algebra as A
from quadlight.terms import XSD, Iri, Literal, Node, Var


def node(x: Any) -> Any:
    """A term or expression as it is; of plain values, "?x" is a variable, other text an IRI, and the rest literals."""
    if isinstance(x, bool):
        return Literal("true" if x else "false", None, XSD + "boolean")
    if isinstance(x, int):
        return Literal(str(x), None, XSD + "integer")
    if isinstance(x, float):
        return Literal(repr(x), None, XSD + "double")
    if isinstance(x, str):
        return Var(x[1:]) if x.startswith("?") else Iri(x)
    return x


def text(x: str, lang: str | None = None, datatype: str | None = None) -> Literal:
    return Literal(x, lang, datatype)


def triple(s: Any, p: Any, o: Any) -> A.Bgp:
    return A.Bgp([(node(s), node(p), node(o))])


def path(s: Any, p: tuple, o: Any) -> A.PathPattern:
    return A.PathPattern(node(s), p, node(o))


def step(iri: str) -> tuple:
    return ("iri", iri)


def repeat(p: tuple, low: int, high: int | None = None) -> tuple:
    """From ``low`` to ``high`` steps; without ``high`` any number from ``low``."""
    return ("repeat", p, low, high)


def _operator(op: str) -> Callable[..., tuple]:
    return lambda *args: (op, *map(node, args))


eq, ne, lt, le, gt, ge = map(_operator, ("=", "!=", "<", "<=", ">", ">="))
plus, minus, times, over = map(_operator, "+-*/")
both, either, negated, bound = map(_operator, ("and", "or", "not", "bound"))


def call(iri: str, *args: Any) -> tuple:
    return ("call", iri, [node(a) for a in args], False)


def aggregate(name: str, *args: Any, distinct: bool = False, separator: str = " ") -> tuple:
    return ("agg", name, [node(a) for a in args], distinct, separator)


def where(*parts: Any) -> Any:
    """Patterns joined, under the filters among the parts; triples that stand together are one pattern."""
    found: list = []
    for p in parts:
        if isinstance(p, A.Bgp) and found and isinstance(found[-1], A.Bgp):
            found[-1] = A.Bgp([*found[-1].triples, *p.triples])
        elif not isinstance(p, tuple):
            found.append(p)
    out = reduce(A.Join, found) if found else A.Bgp([])
    return reduce(A.Filter, [p for p in parts if isinstance(p, tuple)], out)


def optional(left: Any, right: Any, condition: Any = None) -> A.LeftJoin:
    return A.LeftJoin(left, right, condition)


def union(*parts: Any) -> A.Union:
    return A.Union(list(parts))


def without(left: Any, right: Any) -> A.Minus:
    return A.Minus(left, right)


def graph(name: Any, pattern: Any) -> A.Graph:
    return A.Graph(node(name), pattern)


def extend(pattern: Any, var: str, expr: Any) -> A.Extend:
    return A.Extend(pattern, var, node(expr))


def table(names: list[str], rows: list[list]) -> A.Table:
    return A.Table(names, [[None if x is None else node(x) for x in r] for r in rows])


def project(*items: str | tuple[str, Any], **how: Any) -> Callable[[Any], A.Query]:
    """A SELECT of variables, or of (name, expression); ``how`` holds any other field of a query."""
    made: list[tuple[str, Any]] = [(x, None) if isinstance(x, str) else (x[0], node(x[1])) for x in items]
    return lambda pattern: A.Query("select", pattern, made, **how)


def terms(*found: Node) -> list[Node]:
    return list(map(node, found))
