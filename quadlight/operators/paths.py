"""Property paths. Simple steps are rewritten to patterns by the parser; the rest is evaluated here.

``*`` and ``+`` are semi-naive: each round extends only the pairs that are new, drops those seen already by an anti
join and is written to the shared folder. A constant end is the only seed, so its closure alone is explored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlight import terms as T
from quadlight.plans import algebra as A
from quadlight.plans.compiler import EXTENSIONS, Context, Solution, _active, _common, bgp, distinct, fresh, join, union
from quadlight.storage import staged
from quadlight.terms import Iri, Node, Value, Var


def path_pattern(x: A.PathPattern, ctx: Context) -> Solution:
    return _path(x.path, x.start, x.end, ctx)


def _path(p: tuple, s: Node, o: Node, ctx: Context) -> Solution:
    op = p[0]
    if op == "iri":
        return bgp(ctx, [(s, Iri(p[1]), o)])
    if op == "inv":
        return _path(p[1], o, s, ctx)
    if op == "seq":
        middle = Var(fresh("_:m"))
        out = join(_path(p[1], s, middle, ctx), _path(p[2], middle, o, ctx))
        return Solution(out.df, {n: v for n, v in out.values.items() if n != middle.name}, out.maybe)
    if op == "alt":
        return union([_path(q, s, o, ctx) for q in p[1:]])
    if op == "not":
        return _negated(p, s, o, ctx)
    if op == "repeat":
        return _repeat(p, s, o, ctx)
    if op == "opt":
        return distinct(union([_zero(s, o, ctx), _path(p[1], s, o, ctx)]))
    return _closure(p[1], s, o, ctx, zero=op == "star")


def _negated(p: tuple, s: Node, o: Node, ctx: Context) -> Solution:
    """One step by any predicate but those listed, forward, backward or both."""
    from quadlight.plans.compiler import _match

    parts = []
    for iris, a, b in ((p[1], s, o), (p[2], o, s)):
        if iris or not p[2] and a is s:
            quads = _active(ctx).where(~F.col("p.lex").isin(*iris)) if iris else _active(ctx)
            parts.append(_match(quads, (a, Var("_:p"), b), ("s", "o"), ctx.graph))
    return union(parts)


def _repeat(p: tuple, s: Node, o: Node, ctx: Context) -> Solution:
    """{low,high}: that many steps in a row; without a high end, any further ones."""
    _, step, low, high = p

    def steps(n: int, a: Node, b: Node) -> Solution:
        if n == 0:
            return _zero(a, b, ctx)
        chain = reduce(lambda x, y: ("seq", y, x), [step] * n)
        return _path(chain, a, b, ctx)

    if high is None:
        middle = Var(fresh("_:r"))
        out = join(steps(low, s, middle), _path(("star", step), middle, o, ctx)) if low else _path(("star", step), s, o, ctx)
        return distinct(Solution(out.df, {n: v for n, v in out.values.items() if n != middle.name}, out.maybe))
    return distinct(union([steps(n, s, o) for n in range(low, high + 1)]))


def _nodes(ctx: Context) -> DataFrame:
    """All subjects and objects of the active graph, with the graph where that is a variable."""
    keep = ["g"] if isinstance(ctx.graph, Var) else []
    quads = _active(ctx)
    return quads.select(F.col("s").alias("n"), *keep).union(quads.select(F.col("o").alias("n"), *keep)).distinct()


def _zero(s: Node, o: Node, ctx: Context) -> Solution:
    """Every node to itself; a constant end is a node whether the graph has it or not."""
    if not isinstance(s, Var) and not isinstance(o, Var):
        from quadlight.plans.compiler import unit

        here = unit(ctx.dataset)
        return here if s == o else Solution(here.df.where(F.lit(False)), {})
    if isinstance(s, Var) and isinstance(o, Var):
        values = {s.name: Value(F.col("n"), "term"), o.name: Value(F.col("n"), "term")}
        if isinstance(ctx.graph, Var):
            values[ctx.graph.name] = Value(F.col("g"), "iri")
        return Solution(_nodes(ctx), values).only()
    var, node = (s, o) if isinstance(s, Var) else (o, s)
    c = fresh(var.name)
    df = ctx.dataset.spark.range(1).select(T.constant(node).col.alias(c))
    return Solution(df, {var.name: replace(T.constant(node), col=F.col(c))})


def _closure(step: tuple, s: Node, o: Node, ctx: Context, zero: bool) -> Solution:
    if not isinstance(s, Var) and isinstance(o, Var):
        return _reach(step, s, o, ctx, zero)
    if isinstance(s, Var) and not isinstance(o, Var):
        return _reach(("inv", step), o, s, ctx, zero)
    if not isinstance(s, Var):
        end = Var(fresh("_:e"))
        found = _reach(step, s, end, ctx, zero)
        return Solution(found.df.where(T.same_term(found.values[end.name], T.constant(o))).select(F.lit(1).alias(fresh("unit"))).distinct(), {})
    ends = _bound_ends(s, o, ctx)
    if ends == "o":
        return _closure(("inv", step), o, s, ctx, zero)
    pairs, kind, graph = _edges(step, ctx, zero or ends is not None)
    keys = ["a", "b", *graph]
    edges = staged(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), *graph).distinct(), "edges")
    first, seeds = edges.select(F.col("b").alias("a"), F.col("c").alias("b"), *graph), None
    if ends is not None:
        seeds = staged(ctx.bound.df.select(ctx.bound.values[s.name].box().alias("a")).where("a is not null").distinct(), "seeds")
        first = first.join(seeds, "a", "left_semi")
    known = _grown(staged(first.distinct(), "paths"), keys, lambda new: new.join(edges, ["b", *graph]).select("a", F.col("c").alias("b"), *graph))
    values = {"a": replace(kind, col=F.col("a")), "b": replace(kind, col=F.col("b"))}
    out = known
    if zero:
        nodes = _nodes(ctx).select(F.col("n").alias("a"), F.col("n").alias("b"), *graph)
        nodes = nodes if seeds is None else nodes.join(seeds, "a", "left_semi").select(nodes.columns)
        out = known.union(nodes).distinct()
    if s == o:
        out = out.where(F.col("a") == F.col("b"))
    named = {s.name: values["a"], o.name: values["b"]}
    if graph:
        named[ctx.graph.name] = Value(F.col("g"), "iri")
    return Solution(out, named).only()


def _bound_ends(s: Var, o: Var, ctx: Context) -> str | None:
    """The end of a closure that the patterns beside it bind: it need only be explored from there."""
    for end, name in ((s, "s"), (o, "o")):
        if ctx.bound is not None and end.name in ctx.bound.values and end.name not in ctx.bound.maybe:
            return name
    return None


def _grown(first: DataFrame, keys: list[str], step: Callable[[DataFrame], DataFrame], compact: int = 8) -> DataFrame:
    """``first`` and all that ``step`` gives from what is new, round by round. What is known is written anew every few
    rounds, so that no round reads more than a few tables."""
    known = new = first
    for k in itertools.count(1):
        if new.isEmpty():
            return known
        new = staged(step(new).distinct().join(known, keys, "left_anti"), "paths")
        known = known.union(new) if k % compact else staged(known.union(new), "known")


def _edges(step: tuple, ctx: Context, box: bool) -> tuple[DataFrame, Value, list[str]]:
    """Pairs (a, b) of one step, of one type; boxed if they will meet other nodes."""
    a, b = Var(fresh("_:a")), Var(fresh("_:b"))
    found = _path(step, a, b, replace(ctx, bound=None))
    x, y = found.values[a.name], found.values[b.name]
    columns, kind, template = ([x.box(), y.box()], "term", None) if box else _common([x, y])
    graph = ["g"] if isinstance(ctx.graph, Var) and ctx.graph.name in found.values else []
    extra = [found.values[ctx.graph.name].lex().alias("g")] if graph else []
    return found.df.select(columns[0].alias("a"), columns[1].alias("b"), *extra), Value(F.lit(None), kind, template), graph


def _reach(step: tuple, start: Node, end: Var, ctx: Context, zero: bool) -> Solution:
    """Everything that a constant reaches."""
    # The first hop is a scan for the constant alone; all edges are only read if it leads anywhere.
    near = _path(step, start, end, replace(ctx, bound=None))
    graph = ["g"] if isinstance(ctx.graph, Var) and ctx.graph.name in near.values else []
    extra = [near.values[ctx.graph.name].lex().alias("g")] if graph else []
    known = staged(near.df.select(near.values[end.name].box().alias("b"), *extra).distinct(), "reach")
    if not known.isEmpty():
        edges = staged(_edges(step, ctx, True)[0], "edges")
        known = _grown(known, ["b", *graph], lambda new: new.withColumnRenamed("b", "a").join(edges, ["a", *graph]).select("b", *graph))
    if zero:
        seed = T.constant(start).box()
        own = _nodes(ctx).select(seed.alias("b"), *graph) if graph else ctx.dataset.spark.range(1).select(seed.alias("b"))
        known = known.union(own).distinct()
    values = {end.name: Value(F.col("b"), "term")}
    if graph:
        values[ctx.graph.name] = Value(F.col("g"), "iri")
    return Solution(known, values).only()


EXTENSIONS[A.PathPattern] = path_pattern
