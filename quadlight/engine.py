"""Entry points: queries and updates over a dataset."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlight import terms as T
from quadlight.operators import paths  # noqa: F401  (registers property paths)
from quadlight.plans import algebra as A
from quadlight.plans import compiler as C
from quadlight.plans import sse
from quadlight.plans.parser import parse_query, parse_update
from quadlight.sources.dataset import Dataset
from quadlight.storage import staged
from quadlight.terms import Iri, Node, Var

#: Called with (query, dataset) before and (query, frame) after each query.
HOOKS: dict[str, list[Callable]] = {"before": [], "after": []}


def native(s: C.Solution) -> DataFrame:
    """A column for each variable: native types where they are known, IRIs and other terms as text."""
    out = []
    for n, v in s.values.items():
        c = v.col if v.type not in ("term", "iri", "blank") else v.lex()
        out.append(c.alias(n))
    return s.df.select(*out)


def boxed(s: C.Solution) -> DataFrame:
    """A column of boxed terms for each variable."""
    return s.df.select(*[v.box().alias(n) for n, v in s.values.items()])


def solve(q: A.Query, dataset: Dataset, base: str = "", strict: bool = False) -> C.Solution:
    return C.select(q, C.Context(dataset, base=base, strict=strict))


def explain(text: str, dataset: Dataset, base: str = "", prefixes: dict[str, str] | None = None) -> str:
    """The algebra of a query as an S-expression, and Spark's plan for it."""
    df = query(text, dataset, base=base, prefixes=prefixes)
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return f"{sse.text(parse_query(text, base, prefixes))}\n\n{plan}"


def query_each(text: str, datasets: list[Dataset], base: str = "", prefixes: dict[str, str] | None = None) -> DataFrame:
    """Distinct solutions (boxed terms) of a SELECT over each of several datasets, each answering it alone. Spark runs the
    parts side by side, so none is tried first against a time limit."""
    parts = [query(text, d, terms=True, base=base, prefixes=prefixes) for d in datasets]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def query(text: str, dataset: Dataset, terms: bool = False, base: str = "", prefixes: dict[str, str] | None = None, strict: bool = False, join: str | None = None) -> DataFrame:
    """Runs a query lazily.

    SELECT gives a column for each variable (native, or boxed with ``terms``), ASK one boolean column ``result``,
    CONSTRUCT and DESCRIBE distinct triples (s, p, o: boxed terms). ``strict``: MIN and MAX over values of several kinds
    fail. ``join``: a strategy of ``compiler.JOINS`` for all inner joins, where Spark's own choice is not wanted.
    """
    if join is not None and join not in C.JOINS:
        raise ValueError(f"no join strategy {join}; there are {', '.join(sorted(C.JOINS))}")
    q = parse_query(text, base, prefixes)
    asked = C.join_strategy.set(join)
    try:
        return _run(q, dataset, terms, base, strict)
    finally:
        C.join_strategy.reset(asked)


def _run(q: A.Query, dataset: Dataset, terms: bool, base: str, strict: bool) -> DataFrame:
    for hook in HOOKS["before"]:
        hook(q, dataset)
    if q.form == "select":
        s = solve(q, dataset, base, strict)
        out = boxed(s) if terms else native(s)
    elif q.form == "ask":
        out = ask(q, dataset, base)
    elif q.form == "construct":
        out = construct(q, dataset, base)
    else:
        out = describe(q, dataset, base)
    for hook in HOOKS["after"]:
        hook(q, out)
    return out


def ask(q: A.Query, dataset: Dataset, base: str = "") -> DataFrame:
    return solve(q, dataset, base).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))


def _template(quads: list[tuple], s: C.Solution, default: Column | None = None) -> DataFrame:
    """Distinct quads that a template makes of the solutions. Blank nodes of the template are new for each solution:
    their labels depend on the solution alone, so a task that is retried makes the same. Quads with an unbound part, a
    literal subject or a predicate that is no IRI are left out."""
    keys = [v.box().alias(f"c{i}") for i, v in enumerate(v for n, v in s.values.items() if not n.startswith("_:"))]
    row = F.md5(F.to_json(F.struct(*keys))) if keys else F.lit("")

    def part(n: Node) -> Column:
        if isinstance(n, Var):
            if n.name in s.values:
                return s.values[n.name].box()
            if n.name.startswith("_:"):
                return T.boxed(T.BLANK, F.concat(F.lit("b"), F.md5(F.concat_ws("|", row, F.lit(n.name)))))
            return T.null().col
        return T.constant(n).box()

    made = []
    for quad in quads:
        a, p, o = (part(n).cast(T.TERM) for n in quad[:3])
        g = part(quad[3])["lex"] if len(quad) > 3 and quad[3] is not None else F.lit(None).cast("string")
        made.append(F.struct(a.alias("s"), p.alias("p"), o.alias("o"), g.alias("g"), F.lit(len(quad) > 3 and quad[3] is not None).alias("named")))
    out = s.df.select(F.explode(F.array(*made)).alias("x")).select("x.*")
    return out.where((F.col("s.kind") != T.LITERAL) & (F.col("p.kind") == T.IRI) & F.col("o").isNotNull() & (~F.col("named") | F.col("g").isNotNull())).drop("named").distinct()


def construct(q: A.Query, dataset: Dataset, base: str = "") -> DataFrame:
    if not q.template:
        return dataset.spark.createDataFrame([], f"s {T.TERM}, p {T.TERM}, o {T.TERM}")
    return _template(q.template, solve(q, dataset, base)).select("s", "p", "o").distinct()


def describe(q: A.Query, dataset: Dataset, base: str = "") -> DataFrame:
    """Triples with a described node as subject or object, and so on through blank nodes, in both directions."""
    s = solve(q, dataset, base)
    nodes = [s.df.select(s.values[t.name].box().alias("n")) for t in q.targets if isinstance(t, Var) and t.name in s.values]
    nodes += [dataset.spark.range(1).select(T.constant(t).box().alias("n")) for t in q.targets if isinstance(t, Iri)]
    triples = C._active(C.Context(dataset)).select("s", "p", "o")
    if not nodes:
        return triples.where(F.lit(False))
    known = new = staged(reduce(lambda a, b: a.union(b), nodes).where("n is not null").distinct(), "describe")
    if not dataset.tables:
        triples = staged(triples, "triples")
    while not new.isEmpty():
        ahead = triples.join(new, F.col("s") == F.col("n"), "left_semi").select(F.col("o").alias("n"))
        back = triples.join(new, F.col("o") == F.col("n"), "left_semi").select(F.col("s").alias("n"))
        new = staged(ahead.union(back).where(F.col("n.kind") == T.BLANK).distinct().join(known, "n", "left_anti"), "describe")
        known = known.union(new)
    found = triples.join(known, F.col("s") == F.col("n"), "left_semi").union(triples.join(known, F.col("o") == F.col("n"), "left_semi"))
    return found.distinct()


# Updates


def update(text: str, dataset: Dataset, base: str = "", prefixes: dict[str, str] | None = None, allow: bool = True, log: Callable[[DataFrame], None] | None = None) -> Dataset:
    """Runs updates in order; gives a new dataset. What no update can touch of mapped tables stays mapped, all else is
    quads. ``allow``: else any update fails. ``log`` is called after each with its changes, as RDF Patch rows (seq, op, s,
    p, o, g) whose seq counts the updates."""
    from quadlight.streaming import patch

    for seq, op in enumerate(parse_update(text, base, prefixes, allow)):
        before = _opened(op, dataset)
        dataset = apply(op, dataset)
        if log is not None:  # what both hold as tables is the same
            old, new = (replace(d, tables=()).all_quads() for d in (before, dataset))
            log(patch.difference(old, new).withColumn("seq", F.lit(seq).cast("long")))
    return dataset


def _opened(u: A.Update, dataset: Dataset) -> Dataset:
    """The same statements, with all that an update may touch as quads. Tables without a graph column hold statements of the
    default graph alone, and templates with constant predicates touch no others."""

    def touched(t) -> set[str] | None:
        if u.kind == "create":
            return set()
        if u.kind == "modify":
            mine = [q for q in (*u.delete, *u.insert) if t.graph is not None or len(q) < 4 or q[3] is None]
            return {q[1].value for q in mine} if all(isinstance(q[1], Iri) for q in mine) else None
        ends = (u.graph or "default",) if u.kind == "load" else (u.graph, u.target)
        return None if t.graph is not None or "default" in ends or "all" in ends else set()

    out = dataset.opened(touched)
    if not u.insert:
        return out
    # An insertion leaves each statement once: equal rows of a table without a key are one blank node.
    once = tuple(t if t.key or t.once else replace(t, once=True, read=functools.cache(lambda t=t: t.read().distinct())) for t in out.tables)
    return replace(out, tables=once)


def apply(u: A.Update, dataset: Dataset) -> Dataset:
    """One update. The quads of the result are written to the shared folder, so a sequence of updates has a short lineage."""
    before = dataset
    if u.kind == "create":
        return dataset
    dataset = _opened(u, dataset)
    quads = replace(dataset, tables=()).all_quads()
    if u.kind == "clear":
        quads = quads.where(_not_in(u.graph))
    elif u.kind == "load":
        if u.url not in dataset.documents:
            if u.silent:
                return dataset
            raise FileNotFoundError(u.url)
        g = F.lit(u.graph.value if u.graph else None).cast("string")
        quads = quads.union(dataset.documents[u.url].all_quads().select("s", "p", "o", g.alias("g"))).distinct()
    elif u.kind in ("copy", "move", "add"):
        if u.graph == u.target:
            return dataset
        target = F.lit(None if u.target == "default" else u.target.value).cast("string")
        moved = quads.where(_in(u.graph)).select("s", "p", "o", target.alias("g"))
        kept = quads if u.kind == "add" else quads.where(_not_in(u.target))
        if u.kind == "move":
            kept = kept.where(_not_in(u.graph))
        quads = kept.union(moved).distinct()
    else:
        view = C._loaded(before, u).with_view(u.default_graphs, u.named_graphs)
        s = C.pattern(u.where, C.Context(view, base=u.base))
        s = C.Solution(staged(s.only().df, "where"), {}, s.maybe) if not s.values else _staged(s)
        if u.delete:
            gone = _template(u.delete, s)
            same = [quads[c].eqNullSafe(gone[c]) if c == "g" else quads[c] == gone[c] for c in ("s", "p", "o", "g")]
            quads = quads.join(gone, reduce(lambda a, b: a & b, same), "left_anti")
        if u.insert:
            quads = quads.union(_template(u.insert, s)).distinct()
    return dataset.with_quads(staged(quads, "quads"))


def _staged(s: C.Solution) -> C.Solution:
    s = s.only()
    return C.Solution(staged(s.df, "where"), s.values, s.maybe)


def _in(graph) -> Column:
    if graph == "all":
        return F.lit(True)
    if graph in ("default", "named"):
        return F.col("g").isNull() if graph == "default" else F.col("g").isNotNull()
    return F.coalesce(F.col("g") == graph.value, F.lit(False))


def _not_in(graph) -> Column:
    return ~_in(graph)
