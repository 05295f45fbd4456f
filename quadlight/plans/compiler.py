"""Algebra to DataFrames.

A pattern becomes a ``Solution``: a lazy frame, a typed value for each variable, and the variables that may be unbound.
Patterns with one subject over one mapped table collapse into one scan (never a self-join), references between tables
are joins on native keys, and only what is not mapped is matched against quads. Equal definite variables are equality
conjuncts; variables that may be unbound are compatible with anything.
"""

from __future__ import annotations

import contextvars
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlight import terms as T
from quadlight.functions.expressions import LIST_MEMBER, Scope, _common, _number_term, _rank, evaluate, list_member
from quadlight.plans import algebra as A
from quadlight.plans.parser import SparqlError
from quadlight.sources.dataset import Dataset, row_label
from quadlight.sources.mapping import TableMap
from quadlight.terms import Iri, Literal, Node, Value, Var

_count = itertools.count(1)
TYPE = T.RDF + "type"
RANK_OF_DOUBLES = ("float", "double")
EXTREMES = ("integer", "float", "double", "dateTime")
#: Join strategies that a query may ask for, as Spark's hints; None leaves the choice to Spark.
JOINS = {"broadcast": "broadcast", "merge": "merge", "hash": "shuffle_hash", "nested": "shuffle_replicate_nl"}
join_strategy: contextvars.ContextVar[str | None] = contextvars.ContextVar("join_strategy", default=None)
#: Compilers of patterns that live in modules of their own.
EXTENSIONS: dict[type, Callable] = {}


def fresh(hint: str) -> str:
    clean = "".join(c if c.isalnum() else "_" for c in hint)
    return f"{clean}_{next(_count)}"


@dataclass
class Solution:
    df: DataFrame
    values: dict[str, Value]
    maybe: set[str] = field(default_factory=set)

    def only(self, names: list[str] | None = None) -> Solution:
        """Drops all columns but those of the named variables, under fresh names."""
        columns, values = [], {}
        for n in self.values if names is None else names:
            v = self.values.get(n) or T.null()
            c = fresh(n)
            columns.append(v.col.alias(c))
            lang = None
            if v.lang is not None:
                columns.append(v.lang.alias(f"{c}_lang"))
                lang = F.col(f"{c}_lang")
            values[n] = replace(v, col=F.col(c), lang=lang)
        df = self.df.select(*columns) if columns else self.df.select(F.lit(1).alias(fresh("unit")))
        return Solution(df, values, {n for n in values if n in self.maybe or n not in self.values})


@dataclass
class Context:
    dataset: Dataset
    graph: Node | None = None  # None: the default graph
    base: str = ""
    outer: dict[str, Value] = field(default_factory=dict)  # what a nested pattern's filters may also see
    domain: Domain | None = None  # the rows that an EXISTS stands in
    bound: Solution | None = None  # what the patterns joined with a closure bind
    strict: bool = False  # MIN and MAX over values of several kinds are an error
    wanted: dict[str, str] | None = None  # inside an EXISTS: the variables that decide (see ``_modes``); None: all rows count


class Domain:
    """The bindings of the rows around an EXISTS, for the parts of its pattern that speak of them.

    A part that reads a variable of the rows without binding it is joined with their distinct bindings, and so carries
    the variable up to the semi join. Where a variable may be unbound in the rows, ``UNBOUND`` and its name is a second
    variable that says so: rows without a binding match their own kind alone.
    """

    UNBOUND = "_:unbound "

    def __init__(self, rows: Solution):
        self.rows, self.marked = rows, set()

    def beside(self, s: Solution, names: set[str]) -> Solution:
        """``s`` joined with the bindings of those ``names`` that it does not surely bind itself."""
        need = self.needs(s, names)
        if not need:
            return s
        shared = {n for n in s.values if n in self.rows.values and n not in s.maybe and n not in self.rows.maybe}
        self.marked |= need & self.rows.maybe
        return join(s, distinct(self.with_marks(self.rows, need).only([*sorted(need | shared), *(self.UNBOUND + n for n in sorted(need & self.rows.maybe))])))

    def needs(self, s: Solution, names: set[str]) -> set[str]:
        return {n for n in names if n in self.rows.values and (n not in s.values or n in s.maybe)}

    def with_marks(self, s: Solution, names: set[str]) -> Solution:
        marks = {self.UNBOUND + n: Value(s.values[n].col.isNull(), "boolean") for n in sorted(names & self.rows.maybe)}
        return Solution(s.df, {**s.values, **marks}, s.maybe)


# What decides whether a pattern inside an EXISTS has a solution


def _modes(e) -> dict[str, str]:
    """The variables that an expression reads: all values of each count, but of one that is compared by < or > with what
    it has no part in only the least or the greatest."""
    if isinstance(e, tuple) and e[0] == "and":
        return reduce(_also, map(_modes, e[1:]), {})
    out = dict.fromkeys(A.mentions(e), "all")
    if isinstance(e, tuple) and e[0] in ("<", "<=", ">", ">="):
        for side, other, up in ((e[1], e[2], e[0][0] == ">"), (e[2], e[1], e[0][0] == "<")):
            if isinstance(side, Var) and side.name not in A.mentions(other):
                out[side.name] = "max" if up else "min"
    return out


def _also(wanted: dict[str, str] | None, more: dict[str, str] | set[str]) -> dict[str, str] | None:
    more = more if isinstance(more, dict) else dict.fromkeys(more, "all")
    return None if wanted is None else {**wanted, **{n: m if wanted.get(n, m) == m else "all" for n, m in more.items()}}


def _extreme(s: Solution, wanted: dict[str, str]) -> str | None:
    return next((n for n in s.values if wanted.get(n) in ("max", "min") and s.values[n].type in EXTREMES), None)


def _witnesses(s: Solution, wanted: dict[str, str] | None) -> Solution:
    """As few rows as show the same of the ``wanted`` variables: none twice, and of one variable of which an extreme
    decides that value alone, for each combination of the others."""
    if wanted is None:
        return s
    keep, top = [n for n in s.values if n in wanted or n.startswith(Domain.UNBOUND)], _extreme(s, wanted)
    if top is None:
        return s if len(keep) == len(s.values) else distinct(Solution(s.df, {n: s.values[n] for n in keep}, s.maybe & set(keep)))
    s = s.only(keep)
    (column,) = s.df.select(s.values[top].col).columns
    keys = [F.col(c) for c in s.df.columns if c != column] or [F.lit(1).alias(fresh("unit"))]  # of no rows there is no extreme
    df = s.df.groupBy(*keys).agg((F.max if wanted[top] == "max" else F.min)(column).alias(column))
    return Solution(df, s.values, s.maybe)


# Joins


def _alike(a: Solution, b: Solution, names: list[str]) -> list[Column]:
    out = []
    for n in names:
        x, y = a.values[n], b.values[n]
        same = T.same_term(x, y)
        if n in a.maybe or n in b.maybe:
            tests = [v.col.isNull() for v, s in ((x, a), (y, b)) if n in s.maybe]
            same = reduce(lambda p, q: p | q, [*tests, same])
        out.append(same)
    return out


def _shared(a: Solution, b: Solution) -> list[str]:
    return [n for n in a.values if n in b.values]


def _merged(a: Solution, b: Solution, optional: bool = False) -> tuple[dict[str, Value], set[str]]:
    values, maybe = dict(b.values) | dict(a.values), set()
    for n in values:
        if n in a.values and n in b.values:
            if n in a.maybe:
                columns, kind, template = _common([a.values[n], b.values[n]])
                values[n] = Value(F.coalesce(*columns), kind, template)
                if n in b.maybe or optional:
                    maybe.add(n)
        elif n in a.values and n in a.maybe or n in b.values and n not in a.values and (n in b.maybe or optional):
            maybe.add(n)
    return values, maybe


def join(a: Solution, b: Solution) -> Solution:
    names = _shared(a, b)
    doubtful = [n for n in names if n in a.maybe or n in b.maybe]
    if doubtful and len(doubtful) == len(names):
        # No equality to hash on: rows with the variable bound on both sides get one, the others are few kinds.
        n = doubtful[0]
        parts = []
        for left, right in ((True, True), (True, False), (False, True), (False, False)):
            if not left and n not in a.maybe or not right and n not in b.maybe:
                continue
            test = lambda s, yes: Solution(s.df.where(s.values[n].col.isNotNull() if yes else s.values[n].col.isNull()), s.values, s.maybe - {n} if yes else s.maybe)
            x, y = test(a, left), test(b, right)
            if not (left and right):  # one side has no value: it takes the other's
                rest = lambda s: Solution(s.df, {k: v for k, v in s.values.items() if k != n}, s.maybe - {n})
                x, y = (x if left or not right else rest(x)), (y if right else rest(y))
            parts.append(join(x, y))
        return union(parts)
    values, maybe = _merged(a, b)
    on = _alike(a, b, names)
    if on and (wanted := join_strategy.get()):
        b = Solution(b.df.hint(JOINS[wanted]), b.values, b.maybe)
    df = a.df.join(b.df, reduce(lambda p, q: p & q, on), "inner") if on else a.df.crossJoin(b.df)
    return Solution(df, values, maybe)


def left_join(a: Solution, b: Solution, condition: Callable[[dict[str, Value]], Column] | None = None) -> Solution:
    on = _alike(a, b, _shared(a, b))
    if condition is not None:
        on.append(condition({**b.values, **{n: v for n, v in _merged(a, b)[0].items()}}))
    values, maybe = _merged(a, b, optional=True)
    df = a.df.join(b.df, reduce(lambda p, q: p & q, on) if on else F.lit(True), "left")
    return Solution(df, values, maybe)


def semi_join(a: Solution, b: Solution, anti: bool, condition: Callable[[dict[str, Value]], Column] | None = None) -> Solution:
    on = _alike(a, b, _shared(a, b))
    if condition is not None:
        on.append(condition({**a.values, **b.values}))
    return Solution(a.df.join(b.df, reduce(lambda p, q: p & q, on) if on else F.lit(True), "left_anti" if anti else "left_semi"), a.values, a.maybe)


def minus(a: Solution, b: Solution, given: set[str] = frozenset()) -> Solution:
    """Drops rows of a that are compatible with a row of b and share a bound variable with it. Variables that are
    ``given`` from outside must agree, but do not count as shared."""
    names = _shared(a, b)
    own = [n for n in names if n not in given and not n.startswith(Domain.UNBOUND)]
    if not own:
        return a
    on = _alike(a, b, names)
    if not any(n not in a.maybe and n not in b.maybe for n in own):
        on.append(reduce(lambda p, q: p | q, [a.values[n].col.isNotNull() & b.values[n].col.isNotNull() for n in own]))
    return Solution(a.df.join(b.df, reduce(lambda p, q: p & q, on), "left_anti"), a.values, a.maybe)


def union(parts: list[Solution]) -> Solution:
    if len(parts) == 1:
        return parts[0]
    names = list(dict.fromkeys(n for p in parts for n in p.values))
    kinds = {}
    for n in names:
        have = [p.values[n] for p in parts if n in p.values]
        _, kind, template = _common(have)
        plain = {v.type for v in have} == {"iri"} and len({v.template for v in have}) == 1
        kinds[n] = (kind, have[0].template if plain else template)
    frames, columns = [], {n: fresh(n) for n in names}
    for p in parts:
        made = []
        for n in names:
            kind, template = kinds[n]
            v = p.values.get(n)
            if v is None:
                c = T.null(kind).col if template is None else F.lit(None)
            elif kind == "term":
                c = v.box()
            elif kind == "iri" and template is None:
                c = v.lex()
            else:
                c = v.col
            made.append(c.alias(columns[n]))
        frames.append(p.df.select(*made) if made else p.df.select(F.lit(1).alias("_unit")))
    df = reduce(lambda x, y: x.union(y), frames)
    values = {n: Value(F.col(columns[n]), *kinds[n]) for n in names}
    return Solution(df, values, {n for n in names if any(n not in p.values or n in p.maybe for p in parts)})


def distinct(s: Solution) -> Solution:
    s = s.only()
    return Solution(s.df.distinct(), s.values, s.maybe)


def unit(dataset: Dataset) -> Solution:
    return Solution(dataset.spark.range(1).select(F.lit(1).alias(fresh("unit"))), {})


# Scans


def _key(template: str, iri: str, df: DataFrame, column: str) -> Column | None:
    """The key that an IRI holds, as a literal of the column's type; None if the template cannot give the IRI."""
    if not iri.startswith(template):
        return None
    text = iri[len(template) :]
    if df.schema[column].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint"):
        return F.lit(int(text)).cast(df.schema[column].dataType) if text.lstrip("-").isdigit() and str(int(text)) == text else None
    return F.lit(text)


class Star:
    """Patterns of one subject over one mapped table: one scan."""

    def __init__(self, table: TableMap, subject: Node, graph: Node | None, view):
        self.table, self.df, self.values = table, table.read(), {}
        self.tests: list[Column] = []
        if graph is not None:
            self.match(Value(F.col(table.graph.column), "iri", table.graph.template), graph, table.graph.column)
        elif table.graph:
            inside = [k for g in view[0] if (k := _key(table.graph.template, g, self.df, table.graph.column)) is not None]
            self.tests.append(F.col(table.graph.column).isin(*inside) if inside else F.lit(False))
        if graph is not None and view and table.graph:
            inside = [k for g in view[1] if (k := _key(table.graph.template, g, self.df, table.graph.column)) is not None]
            self.tests.append(F.col(table.graph.column).isin(*inside) if inside else F.lit(False))
        value = Value(F.col(table.key), "iri", table.template) if table.key else Value(row_label(self.df), "blank")
        self.match(value, subject, table.key)

    def match(self, value: Value, node: Node, column: str | None) -> None:
        if isinstance(node, Var):
            if node.name in self.values:
                self.tests.append(T.same_term(self.values[node.name], value))
            else:
                self.values[node.name] = value
                if column:
                    self.tests.append(F.col(column).isNotNull())
        elif isinstance(node, Iri) and value.template is not None:
            key = _key(value.template, node.value, self.df, column)
            self.tests.append(F.lit(False) if key is None else F.col(column) == key)
        else:
            self.tests.append(T.same_term(value, T.constant(node)))

    def add(self, predicate: Node, node: Node) -> None:
        if predicate.value == TYPE:
            if isinstance(node, Var):
                self.match(Value(F.lit(self.table.classes[0]), "iri"), node, None)
            elif not (isinstance(node, Iri) and node.value in self.table.classes):
                self.tests.append(F.lit(False))
            return
        p = self.table.properties[predicate.value]
        self.match(Value(F.col(p.column), p.type, p.template, F.col(p.lang_column) if p.lang_column else None), node, p.column)

    def solution(self) -> Solution:
        df = self.df.where(reduce(lambda a, b: a & b, self.tests)) if self.tests else self.df
        return Solution(df, self.values).only()


def _has(table: TableMap, predicate: str) -> bool:
    return predicate == TYPE and bool(table.classes) or predicate in table.properties


def _visible(ctx: Context, table: TableMap) -> bool:
    """Whether a table's triples can be in the active graph."""
    view = ctx.dataset.view
    if ctx.graph is not None:
        return table.graph is not None
    return table.graph is None and view is None or table.graph is not None and bool(view and view[0])


def _tables_of(ctx: Context, triples: list[tuple]) -> dict[int, list[TableMap]]:
    """The tables that may answer each pattern, narrowed by classes and by templates of variables until nothing changes."""
    tables = [t for t in ctx.dataset.tables if _visible(ctx, t)]
    found = {}
    for k, (_, p, o) in enumerate(triples):
        if isinstance(p, Iri):
            mine = [t for t in tables if _has(t, p.value)]
            if p.value == TYPE and isinstance(o, Iri):
                mine = [t for t in mine if o.value in t.classes]
            if mine:
                found[k] = mine
    while True:
        allowed: dict[str, set] = {}

        def narrow(node: Node, templates: set, allowed=allowed) -> None:
            if isinstance(node, Var):
                allowed[node.name] = allowed[node.name] & templates if node.name in allowed else templates

        for k, mine in found.items():
            s, p, o = triples[k]
            narrow(s, {t.template or t.name for t in mine})
            if p.value != TYPE and all(t.properties[p.value].template for t in mine):
                narrow(o, {t.properties[p.value].template for t in mine})
        before = sum(map(len, found.values()))
        for k, mine in found.items():
            s, p, o = triples[k]
            if isinstance(s, Var):
                mine = [t for t in mine if (t.template or t.name) in allowed[s.name]]
            elif isinstance(s, Iri):
                mine = [t for t in mine if t.template and s.value.startswith(t.template)]
            if isinstance(o, Var) and o.name in allowed and p.value != TYPE:
                mine = [t for t in mine if t.properties[p.value].template is None or t.properties[p.value].template in allowed[o.name]]
            found[k] = mine
        if sum(map(len, found.values())) == before:
            return found


def bgp(ctx: Context, triples: list[tuple]) -> Solution:
    if not triples:
        return unit(ctx.dataset)
    found = _tables_of(ctx, triples)
    parts: list[Solution] = []
    groups: dict[tuple, list[int]] = {}
    for k, (s, p, _) in enumerate(triples):
        if k in found:
            groups.setdefault((s, tuple(sorted(t.name for t in found[k]))), []).append(k)
        elif isinstance(p, Iri) and p.value in ctx.dataset.computed:
            parts.append(_match(ctx.dataset.computed[p.value](ctx.dataset), triples[k], ("s", "o")))
        else:
            parts.append(quad_scan(ctx, triples[k]))
    for (s, names), members in groups.items():
        stars = []
        for table in [t for t in ctx.dataset.tables if t.name in names and _visible(ctx, t)]:
            star = Star(table, s, ctx.graph, ctx.dataset.view)
            for k in members:
                star.add(triples[k][1], triples[k][2])
            stars.append(star.solution())
        parts.append(union(stars) if stars else _nothing(ctx, {n for k in members for n in A.variables(A.Bgp([triples[k]]))}))
    if len(parts) > 1:
        parts = [_witnesses(p, _also(ctx.wanted, {n for q in parts if q is not p for n in q.values})) for p in parts]
    return _chain(parts)


def _nothing(ctx: Context, names: set[str]) -> Solution:
    s = unit(ctx.dataset)
    return Solution(s.df.where(F.lit(False)), {n: T.null() for n in names})


def _chain(parts: list[Solution]) -> Solution:
    """Joins parts so that each one shares a variable with those before it, if any does."""
    out, rest = parts[0], parts[1:]
    while rest:
        k = next((i for i, p in enumerate(rest) if _shared(out, p)), 0)
        out = join(out, rest.pop(k))
    return out


def _active(ctx: Context, predicate: Node | None = None) -> DataFrame:
    """The quads of the active graph, or those of a constant predicate in it where the store finds them on its own. Of
    mapped tables only the columns of that predicate are read. A graph that is made up of several holds each triple once."""
    quads, view = ctx.dataset.quads, ctx.dataset.view
    if ctx.dataset.scan is not None and isinstance(predicate, Iri):
        quads = ctx.dataset.scan(predicate.value)
    if tables := [t for t in ctx.dataset.tables if _visible(ctx, t)]:
        if isinstance(predicate, Iri):
            tables = [t.only(lambda p: p == predicate.value) for t in tables]
        quads = replace(ctx.dataset, quads=quads, scan=None, tables=tuple(tables)).all_quads()
    if quads is None:
        quads = ctx.dataset.spark.createDataFrame([], "s {0}, p {0}, o {0}, g string".format(T.TERM))
    if ctx.graph is None:
        if view is None:
            return quads.where("g is null")
        return quads.where(F.col("g").isin(*view[0]) if view[0] else F.lit(False)).select("s", "p", "o", F.lit(None).cast("string").alias("g")).distinct()
    if isinstance(ctx.graph, Iri):
        quads = quads.where(F.col("g") == ctx.graph.value)
    else:
        quads = quads.where("g is not null")
    return quads if view is None else quads.where(F.col("g").isin(*view[1]) if view[1] else F.lit(False))


def _match(df: DataFrame, triple: tuple, columns: tuple[str, ...] = ("s", "p", "o"), graph: Node | None = None) -> Solution:
    values: dict[str, Value] = {}
    nodes = dict(zip(("s", "p", "o"), triple, strict=True))
    pairs = [(Value(F.col(c), "term"), nodes[c]) for c in columns]
    if isinstance(graph, Var):
        pairs.append((Value(F.col("g"), "iri"), graph))
    for value, node in pairs:
        if not isinstance(node, Var):
            c = T.constant(node).box()
            if isinstance(node, Iri):  # fields reach the scan
                df = df.where((value.col["kind"] == T.IRI) & (value.col["lex"] == node.value))
            else:
                df = df.where(value.col == c)
        elif node.name in values:
            df = df.where(T.same_term(values[node.name], value))
        else:
            values[node.name] = value
    return Solution(df, values).only()


def quad_scan(ctx: Context, triple: tuple) -> Solution:
    return _match(_active(ctx, triple[1]), triple, graph=ctx.graph)


# Patterns


def pattern(x, ctx: Context) -> Solution:
    if type(x) in EXTENSIONS:
        return EXTENSIONS[type(x)](x, replace(ctx, wanted=None))
    if isinstance(x, A.Bgp):
        return bgp(ctx, x.triples)
    if isinstance(x, A.Join):
        return _joined(_operands(x), ctx)
    if isinstance(x, A.LeftJoin):
        left, right = (_decisive(p, [q, x.condition], ctx) for p, q in ((x.left, x.right), (x.right, x.left)))
        left = _given(left, [x.right, x.condition], ctx)
        condition = None if x.condition is None else lambda values: T.ebv(evaluate(x.condition, Scope({**ctx.outer, **values}, ctx.base, ctx.dataset.functions)))
        return left_join(left, right, condition)
    if isinstance(x, A.Minus):
        left = pattern(x.left, replace(ctx, wanted=_also(ctx.wanted, A.mentions(x.right))))
        whole = _given(left, x.right, ctx)
        return minus(whole, pattern(x.right, replace(ctx, wanted=None)), set(whole.values) - set(left.values))
    if isinstance(x, A.Union):
        return union([pattern(p, ctx) for p in x.parts])
    if isinstance(x, A.Graph):
        inner = pattern(x.pattern, replace(ctx, graph=x.name, wanted=_also(ctx.wanted, A.mentions(x.name))))
        if isinstance(x.name, Var) and x.name.name not in inner.values:
            names = _graph_names(ctx, x.name)
            return join(names, inner)
        return inner
    if isinstance(x, A.Service):
        return service(x, replace(ctx, wanted=None))
    if isinstance(x, A.Extend):
        near = replace(ctx, wanted=_also(ctx.wanted, A.mentions(x.expr)))
        return extend(_given(pattern(x.pattern, near), x.expr, ctx), x.var, x.expr, ctx)
    if isinstance(x, A.Filter):
        near = replace(ctx, wanted=_also(ctx.wanted, _modes(x.expr)))
        s = pattern(x.pattern, near)
        if ctx.domain is not None and ctx.domain.needs(s, A.mentions(x.expr)):
            s = _witnesses(s, near.wanted)
        return filtered(_given(s, x.expr, ctx), x.expr, ctx)
    if isinstance(x, A.Table):
        return table(x, ctx)
    if isinstance(x, A.SubSelect):
        return select(x.query, replace(ctx, outer={}, domain=None, wanted=None))
    raise SparqlError(f"unknown pattern {type(x).__name__}")


def _decisive(x, beside, ctx: Context) -> Solution:
    """A pattern that others ``beside`` it are joined with; inside an EXISTS only what decides there."""
    wanted = _also(ctx.wanted, A.mentions(beside))
    return _witnesses(pattern(x, replace(ctx, wanted=wanted)), wanted)


def _operands(x) -> list:
    if isinstance(x, A.Join):
        return [*_operands(x.left), *_operands(x.right)]
    return [] if isinstance(x, A.Bgp) and not x.triples else [x]


def _joined(parts: list, ctx: Context) -> Solution:
    """Joins patterns. Closures come last: one whose end the others bind is explored from there alone."""
    closures = [p for p in parts if isinstance(p, A.PathPattern) and p.path[0] in ("star", "plus")]
    others = [p for p in parts if not any(p is c for c in closures)]
    if len(parts) == 0:
        return unit(ctx.dataset)
    if len(parts) == 1:
        return pattern(parts[0], replace(ctx, bound=None))
    beside = lambda p: [q for q in parts if q is not p]
    out = None
    while others or closures:
        near = lambda p, out=out: out is None or A.variables(p) & set(out.values)
        k = next((i for i, p in enumerate(others) if near(p)), None)
        if k is None and closures:
            k = next((i for i, p in enumerate(closures) if near(p)), 0)
            p = closures.pop(k)
            found = _decisive(p, beside(p), replace(ctx, bound=out))
        else:
            p = others.pop(k or 0)
            found = _decisive(p, beside(p), ctx)
        out = found if out is None else join(out, found)
    return out


def _given(s: Solution, reader, ctx: Context) -> Solution:
    """``s`` with the bindings that ``reader``, a pattern or an expression beside it, takes from the rows around an EXISTS."""
    return s if ctx.domain is None else ctx.domain.beside(s, A.mentions(reader))


def _graph_names(ctx: Context, var: Var) -> Solution:
    names = ctx.dataset.graphs()
    if ctx.dataset.view is not None:
        names = names.where(F.col("g").isin(*ctx.dataset.view[1]) if ctx.dataset.view[1] else F.lit(False))
    return Solution(names, {var.name: Value(F.col("g"), "iri")}).only()


def service(x: A.Service, ctx: Context) -> Solution:
    """The pattern over another dataset that is registered for the endpoint."""

    def at(iri: str) -> Solution:
        if iri not in ctx.dataset.services:
            if x.silent:
                return unit(ctx.dataset)
            raise SparqlError(f"no dataset is registered for <{iri}>")
        return pattern(x.pattern, replace(ctx, dataset=ctx.dataset.services[iri], graph=None))

    if isinstance(x.endpoint, Iri):
        return at(x.endpoint.value)
    parts = []
    for iri in ctx.dataset.services:
        s = at(iri)
        parts.append(extend(s, x.endpoint.name, Iri(iri), ctx))
    return union(parts) if parts else _nothing(ctx, A.variables(x))


def table(x: A.Table, ctx: Context) -> Solution:
    if not x.names:
        s = unit(ctx.dataset)
        return s if len(x.rows) == 1 else Solution(s.df.where(F.lit(False)) if not x.rows else s.df.select(F.explode(F.sequence(F.lit(1), F.lit(len(x.rows)))).alias(fresh("unit"))), {})
    if not x.rows:
        return _nothing(ctx, set(x.names))
    columns = {}
    for i, name in enumerate(x.names):
        have = [T.constant(r[i]) for r in x.rows if r[i] is not None] or [T.null()]
        cols, kind, template = _common(have)
        it = iter(cols)
        columns[name] = ([next(it) if r[i] is not None else T.null(kind).col for r in x.rows], kind)
    aliases = {n: fresh(n) for n in x.names}
    rows = F.array(*[F.struct(*[columns[n][0][k].alias(aliases[n]) for n in x.names]) for k in range(len(x.rows))])
    df = ctx.dataset.spark.range(1).select(F.explode(rows).alias("_r")).select("_r.*")
    return Solution(df, {n: Value(F.col(aliases[n]), columns[n][1]) for n in x.names}, {n for i, n in enumerate(x.names) if any(r[i] is None for r in x.rows)})


def extend(s: Solution, name: str, e, ctx: Context) -> Solution:
    scope, s = _scope(s, e, ctx)
    v = evaluate(e, scope)
    c = fresh(name)
    df, lang = s.df.withColumn(c, v.col), None
    if v.lang is not None:
        df, lang = df.withColumn(f"{c}_lang", v.lang), F.col(f"{c}_lang")
    sure = isinstance(e, (Iri, Literal)) or isinstance(e, Var) and e.name in s.values and e.name not in s.maybe
    return Solution(df, {**s.values, name: replace(v, col=F.col(c), lang=lang)}, s.maybe if sure else s.maybe | {name})


def _exists_in(e) -> list:
    if isinstance(e, tuple):
        if e[0] == "call" and e[1] in LIST_MEMBER:
            return [("exists", list_member(e[2]))]
        return [e] if e[0] == "exists" else [x for a in e[1:] for x in _exists_in(a)]
    return [x for a in e for x in _exists_in(a)] if isinstance(e, list) else []


def _scope(s: Solution, e, ctx: Context, aggregates: dict[str, Value] | None = None) -> tuple[Scope, Solution]:
    """The scope of an expression. Each EXISTS inside it becomes a flag column."""
    flags = {}
    for x in _exists_in(e):
        flags[repr(x)], s = _flagged(s, x[1], ctx)
    row = None
    if "bnode" in repr(e):
        row = F.md5(F.to_json(F.struct(*[v.box().alias(f"c{i}") for i, v in enumerate(s.values.values())]))) if s.values else F.lit("")
    return Scope({**ctx.outer, **s.values}, ctx.base, ctx.dataset.functions, lambda p: flags[repr(("exists", p))], aggregates or {}, row), s


def _flagged(s: Solution, x, ctx: Context) -> tuple[Column, Solution]:
    """Rows with a flag that says whether the pattern matches: by one left join to the distinct keys of the matches
    where keys decide alone, else as the rows with a match beside the others."""
    name = fresh("exists")
    rows, right, condition = _matches(s, x, ctx)
    shared = _shared(rows, right)
    if condition is None and shared and not any(n in rows.maybe or n in right.maybe for n in shared):
        keys = distinct(right.only(shared))
        on = reduce(lambda p, q: p & q, _alike(rows, keys, shared))
        df = rows.df.join(keys.df.withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
        return F.col(name), Solution(df, s.values, s.maybe)
    yes, no = (semi_join(rows, right, anti, condition) for anti in (False, True))
    return F.col(name), Solution(yes.df.withColumn(name, F.lit(True)).union(no.df.withColumn(name, F.lit(False))), s.values, s.maybe)


def _matches(s: Solution, x, ctx: Context) -> tuple[Solution, Solution, Callable | None]:
    """Rows, the solutions of an EXISTS pattern, and a condition on both, so that a semi join of them is the EXISTS.

    Filters at the pattern's top that speak of the rows are that condition; whatever speaks of them further inside is
    joined with their distinct bindings.
    """
    conditions = []
    while isinstance(x, A.Filter):
        every = list(x.expr[1:]) if isinstance(x.expr, tuple) and x.expr[0] == "and" else [x.expr]
        inner = A.variables(x.pattern)
        local = [e for e in every if A.expression_variables(e) <= inner or _exists_in(e)]
        conditions += [e for e in every if e not in local]
        if local:
            x = A.Filter(x.pattern, ("and", *local) if len(local) > 1 else local[0])
            break
        x = x.pattern
    domain = Domain(s)
    wanted = reduce(_also, map(_modes, conditions), dict.fromkeys(s.values, "all"))
    right = pattern(x, replace(ctx, outer={}, domain=domain, wanted=wanted))
    if _extreme(right, wanted):
        right = _witnesses(right, wanted)
    rows = domain.with_marks(s, domain.marked)
    if not conditions:
        return rows, right, None
    return rows, right, lambda values: reduce(lambda a, b: a & b, [T.ebv(evaluate(e, Scope({**ctx.outer, **values}, ctx.base, ctx.dataset.functions))) for e in conditions])


def exists(s: Solution, x, anti: bool, ctx: Context) -> Solution:
    """Rows with (or without) a match."""
    rows, right, condition = _matches(s, x, ctx)
    return Solution(semi_join(rows, right, anti, condition).df, s.values, s.maybe)


def filtered(s: Solution, e, ctx: Context, aggregates: dict[str, Value] | None = None) -> Solution:
    for part in e[1:] if isinstance(e, tuple) and e[0] == "and" else [e]:
        if isinstance(part, tuple) and part[0] == "exists":
            s = exists(s, part[1], False, ctx)
        elif isinstance(part, tuple) and part[0] == "not" and isinstance(part[1], tuple) and part[1][0] == "exists":
            s = exists(s, part[1][1], True, ctx)
        else:
            scope, s = _scope(s, part, ctx, aggregates)
            s = Solution(s.df.where(T.ebv(evaluate(part, scope))), s.values, s.maybe)
    return s


# Aggregates and modifiers


def _aggregates(e) -> list[tuple]:
    if isinstance(e, tuple):
        return [e] if e[0] == "agg" else [x for a in e[1:] for x in _aggregates(a)] if e[0] != "exists" else []
    return [x for a in e for x in _aggregates(a)] if isinstance(e, list) else []


def _aggregate(e: tuple, s: Solution, scope: Scope, strict: bool = False) -> tuple[list[Column], Callable[[list[Column]], Value]]:
    """Aggregate columns, and the value that their results give."""
    _, name, args, is_distinct, separator = e
    values = [evaluate(a, scope) for a in args]
    if name == "count":
        if not values:
            whole = F.struct(*[v.box().alias(f"c{i}") for i, v in enumerate(v for n, v in s.values.items() if not n.startswith("_:"))]) if is_distinct and s.values else F.lit(1)
            return [F.count_distinct(whole) if is_distinct else F.count(F.lit(1))], lambda c: Value(c[0], "integer")
        v = values[0]
        whole = v.col if v.type != "lang" else v.box()
        return [F.count_distinct(whole) if is_distinct else F.count(whole)], lambda c: Value(c[0], "integer")
    if name == "group_concat":
        texts = [Value(v.lex() if v.type != "term" else v.col["lex"], "string").col for v in values]
        text = F.concat(*texts) if len(texts) > 1 else texts[0]
        items = F.collect_set(text) if is_distinct else F.collect_list(text)
        return [F.array_join(F.array_sort(items), separator)], lambda c: Value(c[0], "string")
    v = values[0]
    if name in ("min", "max", "sample"):
        if name == "sample":
            out = F.min(v.col) if v.type == "string" else F.min_by(v.box() if v.type == "lang" else v.col, v.lex())
        elif v.type not in ("term", "lang") and not (v.type == "iri" and v.template):
            out = (F.min if name == "min" else F.max)(v.col)
        else:
            by = F.when(v.col.isNotNull(), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(T.sort_key(v))]))
            out = (F.min_by if name == "min" else F.max_by)(v.box() if v.type == "lang" else v.col, by)
            if strict and v.type == "term":
                kind = F.when(T.number(v).isNotNull(), "number").otherwise(F.coalesce(v.col["dt"], v.col["kind"].cast("string")))
                mixed = F.min(F.when(v.col.isNotNull(), kind)) != F.max(F.when(v.col.isNotNull(), kind))
                out = F.when(F.coalesce(mixed, F.lit(False)), F.raise_error(F.lit(f"{name.upper()} over values of several kinds")).cast(T.TERM)).otherwise(out)
        kind = "term" if v.type == "lang" else v.type
        return [out], lambda c: Value(c[0], kind, v.template)
    # SUM and AVG: one value that is no number makes the result an error.
    add, count = (F.sum_distinct, F.count_distinct) if is_distinct else (F.try_sum, F.count)
    if v.type in RANK_OF_DOUBLES:
        zero = F.lit(0.0)
        total = F.coalesce(add(v.col), zero) if name == "sum" else F.coalesce(add(v.col) / F.nullif(count(v.col), F.lit(0)), zero)
        return [F.when(F.count_if(v.col.isNull()) == 0, total)], lambda c: Value(c[0], v.type)
    if v.numeric:
        good, total = F.count_if(v.col.isNull()) == 0, add(v.col)
        if name == "sum":
            zero = F.lit(0).cast("bigint" if v.type == "integer" else "decimal(1,0)")
            return [F.when(good, F.coalesce(total, zero))], lambda c: Value(c[0], v.type)
        mean = F.try_divide(total.cast("decimal(20,0)") if v.type == "integer" else total, count(v.col).cast("decimal(20,0)"))
        return [F.when(good, F.coalesce(mean, F.lit(0).cast("decimal(1,0)")))], lambda c: Value(c[0], "decimal")
    rank, number, n = _rank(v), T.number(v), count(v.col)
    columns = [add(T.whole(v)), add(T.exact(v)), add(number), F.max(rank), F.count_if(rank.isNull() | number.isNull()), n]

    def result(c: list[Column]) -> Value:
        whole, exact, double, rank, bad, n = c
        none, rank = F.coalesce(n, F.lit(0)) == 0, F.coalesce(rank, F.lit(0))
        if name == "sum":
            out = _number_term(F.when(none, F.lit(0).cast(T.WHOLE)).otherwise(whole), exact, double, rank)
        else:
            mean = F.try_divide(exact, n.cast("decimal(20,0)")).try_cast(T.DECIMAL)
            out = _number_term(F.lit(0).cast(T.WHOLE), mean, F.try_divide(double, n.cast("double")), F.when(none, 0).otherwise(F.greatest(rank, F.lit(1))))
        return Value(F.when(bad == 0, out.col), "term")

    return columns, result


def grouped(q: A.Query, s: Solution, ctx: Context) -> tuple[Solution, dict[str, Value]]:
    wanted = {repr(a): a for e in [*[e for _, e in q.items], *q.having, *[e for _, e in q.order]] for a in _aggregates(e)}
    keys, names = [], {}
    for e, name in q.group or []:
        scope, s = _scope(s, e, ctx)
        v = evaluate(e, scope)
        v = Value(v.box(), "term") if v.type == "lang" else v
        c = fresh(name or "key")
        keys.append(v.col.alias(c))
        names[name or (e.name if isinstance(e, Var) else repr(e))] = replace(v, col=F.col(c))
    aggregated, results = [], {}
    for text, a in wanted.items():
        scope, s = _scope(s, a[2], ctx)
        columns, result = _aggregate(a, s, scope, ctx.strict)
        aliases = [fresh(a[1]) for _ in columns]
        aggregated += [c.alias(n) for c, n in zip(columns, aliases, strict=True)]
        results[text] = result([F.col(n) for n in aliases])
    df = s.df.groupBy(*keys).agg(*(aggregated or [F.count(F.lit(1)).alias(fresh("n"))]))
    return Solution(df, names, {n for n in names}), results


def select(q: A.Query, ctx: Context) -> Solution:
    ctx = replace(ctx, base=q.base or ctx.base)
    if q.default_graphs or q.named_graphs:
        ctx = replace(ctx, dataset=_loaded(ctx.dataset, q).with_view(q.default_graphs, q.named_graphs))
    s, aggregates = pattern(q.where, ctx), {}
    order = list(q.order)
    if q.group is not None or A.has_aggregate([[e for _, e in q.items], q.having, [e for _, e in q.order]]):
        s, aggregates = grouped(q, s, ctx)
    elif q.having:
        raise SparqlError("HAVING without groups")
    for name, e in q.items:
        if e is not None:
            scope, s = _scope(s, e, ctx, aggregates)
            v = evaluate(e, scope)
            c = fresh(name)
            df, lang = s.df.withColumn(c, v.col), None
            if v.lang is not None:
                df, lang = df.withColumn(f"{c}_lang", v.lang), F.col(f"{c}_lang")
            s = Solution(df, {**s.values, name: replace(v, col=F.col(c), lang=lang)}, s.maybe | {name})
    if q.trailing is not None:
        s = join(s, table(q.trailing, ctx))
    for e in q.having:
        s = filtered(s, e, ctx, aggregates)
    names = [n for n, _ in q.items] or [n for n in s.values if not n.startswith("_:")]
    early = q.distinct and all(A.expression_variables(e) <= set(names) and not A.has_aggregate(e) for _, e in order)
    if early:
        s = distinct(s.only(names))
    if order:
        keys = []
        for up, e in order:
            scope, s = _scope(s, e, ctx, aggregates)
            keys += [c.asc_nulls_first() if up else c.desc_nulls_last() for c in T.sort_key(evaluate(e, scope))]
        s = Solution(s.df.orderBy(*keys), s.values, s.maybe)
    if not early:
        s = s.only(names)
        if q.distinct:
            s = distinct(s)
    df = s.df
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return Solution(df, s.values, s.maybe)


def _loaded(dataset: Dataset, q) -> Dataset:
    """Graphs of FROM that are registered documents are added under their own names."""
    quads = [dataset.documents[g].all_quads().select("s", "p", "o", F.lit(g).alias("g")) for g in dict.fromkeys([*q.default_graphs, *q.named_graphs]) if g in dataset.documents]
    if not quads:
        return dataset
    old = [dataset.quads] if dataset.quads is not None else []
    return dataset.with_quads(reduce(lambda a, b: a.union(b), [*old, *quads]))
