"""Algebra and expressions as S-expressions, for people and logs to read."""

from __future__ import annotations

import json
from typing import Any

from quadlight.plans import algebra as A
from quadlight.terms import Blank, Iri, Literal, Var


def _term(n: Any) -> str:
    if isinstance(n, Var):
        return f"?{n.name}"
    if isinstance(n, Iri):
        return f"<{n.value}>"
    if isinstance(n, Blank):
        return f"_:{n.label}"
    tail = f"@{n.lang}" if n.lang else f"^^<{n.dt}>" if n.dt else ""
    return json.dumps(n.value, ensure_ascii=False) + tail


def _flat(x: Any) -> str:
    """A term, an expression or a path on one line."""
    if x is None:
        return "undef"
    if isinstance(x, (Var, Iri, Blank, Literal)):
        return _term(x)
    if isinstance(x, (tuple, list)):
        return f"({' '.join(_flat(y) for y in x)})"
    if isinstance(x, (str, int, float, bool)):
        return str(x)
    return " ".join(text(x).split())


def _line(depth: int, *parts: str) -> str:
    return "  " * depth + " ".join(parts)


def text(x: Any, depth: int = 0) -> str:
    """A pattern or a query, one operator a line, what it holds indented below it."""
    inner = lambda *below: "".join("\n" + text(b, depth + 1) for b in below) + ")"
    if isinstance(x, A.Bgp):
        return _line(depth, "(bgp" + "".join(f" (triple {' '.join(map(_term, t))})" for t in x.triples) + ")")
    if isinstance(x, A.PathPattern):
        return _line(depth, "(path", _term(x.start), _flat(x.path), _term(x.end) + ")")
    if isinstance(x, A.Join):
        return _line(depth, "(join") + inner(x.left, x.right)
    if isinstance(x, A.LeftJoin):
        return _line(depth, "(leftjoin", *([_flat(x.condition)] if x.condition is not None else [])) + inner(x.left, x.right)
    if isinstance(x, A.Minus):
        return _line(depth, "(minus") + inner(x.left, x.right)
    if isinstance(x, A.Union):
        return _line(depth, "(union") + inner(*x.parts)
    if isinstance(x, A.Graph):
        return _line(depth, "(graph", _term(x.name)) + inner(x.pattern)
    if isinstance(x, A.Service):
        return _line(depth, "(service", _term(x.endpoint)) + inner(x.pattern)
    if isinstance(x, A.Extend):
        return _line(depth, "(extend", f"((?{x.var} {_flat(x.expr)}))") + inner(x.pattern)
    if isinstance(x, A.Filter):
        return _line(depth, "(filter", _flat(x.expr)) + inner(x.pattern)
    if isinstance(x, A.Table):
        rows = "".join(" (row" + "".join(f" (?{n} {_flat(v)})" for n, v in zip(x.names, r, strict=True)) + ")" for r in x.rows)
        return _line(depth, f"(table (vars{''.join(f' ?{n}' for n in x.names)}){rows})")
    if isinstance(x, A.SubSelect):
        return text(x.query, depth)
    return _query(x, depth)


def _query(q: A.Query, depth: int) -> str:
    """From the outside in: slice, distinct, project, order, having, the select expressions, group, pattern."""
    names = [f"?{n}" for n, _ in q.items] or ["*"]
    shells = []
    if q.offset or q.limit is not None:
        shells.append(f"(slice {q.offset or 0} {'_' if q.limit is None else q.limit}")
    if q.distinct:
        shells.append("(distinct")
    shells.append(f"(project ({' '.join(names)})" if q.form == "select" else f"({q.form}")
    if q.order:
        shells.append("(order (" + " ".join(f"({'asc' if up else 'desc'} {_flat(e)})" for up, e in q.order) + ")")
    shells += [f"(filter {_flat(e)}" for e in q.having]
    if made := [f"(?{n} {_flat(e)})" for n, e in q.items if e is not None]:
        shells.append(f"(extend ({' '.join(made)})")
    if q.group is not None:
        shells.append("(group (" + " ".join(_flat(e) if n is None else f"(?{n} {_flat(e)})" for e, n in q.group) + ")")
    lines = [_line(depth + k, s) for k, s in enumerate(shells)]
    return "\n".join([*lines, text(q.where, depth + len(shells))]) + ")" * len(shells)
