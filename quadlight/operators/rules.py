"""Forward chaining: CONSTRUCT rules run to a fixpoint, and the entailments of RDFS.

Each round runs all rules, keeps what is new by an anti join and writes it to the shared folder; the end is a round
that gives nothing new. Blank nodes of a template depend on the solution alone, so rules that make them settle too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlight.engine import _template
from quadlight.plans import compiler as C
from quadlight.plans.parser import parse_query
from quadlight.sources.dataset import Dataset
from quadlight.storage import staged
from quadlight.terms import RDF, RDFS

_PREFIX = f"PREFIX rdf: <{RDF}> PREFIX rdfs: <{RDFS}> "
#: The entailments of RDFS, as rules.
RDFS_RULES = [
    _PREFIX + rule
    for rule in (
        "CONSTRUCT { ?p rdf:type rdf:Property } WHERE { ?s ?p ?o }",
        "CONSTRUCT { ?s rdf:type ?c } WHERE { ?p rdfs:domain ?c . ?s ?p ?o }",
        "CONSTRUCT { ?o rdf:type ?c } WHERE { ?p rdfs:range ?c . ?s ?p ?o }",
        "CONSTRUCT { ?s rdf:type rdfs:Resource . ?o rdf:type rdfs:Resource } WHERE { ?s ?p ?o }",
        "CONSTRUCT { ?p rdfs:subPropertyOf ?r } WHERE { ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r }",
        "CONSTRUCT { ?p rdfs:subPropertyOf ?p } WHERE { ?p rdf:type rdf:Property }",
        "CONSTRUCT { ?s ?q ?o } WHERE { ?p rdfs:subPropertyOf ?q . ?s ?p ?o }",
        "CONSTRUCT { ?c rdfs:subClassOf rdfs:Resource } WHERE { ?c rdf:type rdfs:Class }",
        "CONSTRUCT { ?s rdf:type ?d } WHERE { ?c rdfs:subClassOf ?d . ?s rdf:type ?c }",
        "CONSTRUCT { ?c rdfs:subClassOf ?c } WHERE { ?c rdf:type rdfs:Class }",
        "CONSTRUCT { ?c rdfs:subClassOf ?e } WHERE { ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e }",
        "CONSTRUCT { ?p rdfs:subPropertyOf rdfs:member } WHERE { ?p rdf:type rdfs:ContainerMembershipProperty }",
        "CONSTRUCT { ?d rdfs:subClassOf rdfs:Literal } WHERE { ?d rdf:type rdfs:Datatype }",
    )
]


def infer(dataset: Dataset, rules: list[str], graph: str | None = None, most_rounds: int = 100) -> Dataset:
    """``dataset`` with everything that the rules give, added to the default graph or to ``graph``."""
    dataset = dataset.materialised()
    plans = [parse_query(r) for r in rules]
    known = staged(dataset.all_quads().select("s", "p", "o").distinct(), "facts")
    start = known
    for _ in range(most_rounds):
        facts = Dataset(dataset.spark, known.select("*", F.lit(None).cast("string").alias("g")), functions=dataset.functions, computed=dataset.computed)
        made = [_template(q.template, C.select(q, C.Context(facts))).select("s", "p", "o") for q in plans]
        new = staged(reduce(lambda a, b: a.union(b), made).distinct().join(known, ["s", "p", "o"], "left_anti"), "inferred")
        if new.isEmpty():
            break
        known = known.union(new)
    else:
        raise RuntimeError(f"the rules gave new statements for {most_rounds} rounds")
    inferred = known.join(start, ["s", "p", "o"], "left_anti").select("s", "p", "o", F.lit(graph).cast("string").alias("g"))
    return dataset.with_quads(dataset.all_quads().union(inferred))


def rdfs(dataset: Dataset, graph: str | None = None) -> Dataset:
    return infer(dataset, RDFS_RULES, graph)


def clear_inferences(dataset: Dataset, graph: str) -> Dataset:
    """Drops the graph that ``infer`` filled."""
    return dataset.with_quads(dataset.all_quads().where(F.coalesce(F.col("g") != graph, F.lit(True))))


def list_members(dataset: Dataset) -> DataFrame:
    """Members of all RDF collections: (head, pos, member), by doubling the rest links instead of walking them. Rest links
    that lead back to a cell of their own list are an error."""
    quads = dataset.all_quads()
    rest = quads.where(F.col("p.lex") == RDF + "rest").select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    first = quads.where(F.col("p.lex") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("member"))
    heads = rest.select("a").join(rest.select(F.col("b").alias("a")), "a", "left_anti")
    hops = staged(rest.select("a", "b", F.lit(1).cast("long").alias("n")), "hops")
    reach = heads.select(F.col("a").alias("head"), F.col("a").alias("cell"), F.lit(0).cast("long").alias("pos"))
    step, cells = 1, hops.count()
    while not hops.isEmpty():
        if step > cells:  # a hop of more links than there are
            raise ValueError("a collection's rest links lead in a circle")
        reach = staged(reach.union(reach.join(hops, F.col("cell") == F.col("a")).select("head", F.col("b").alias("cell"), (F.col("pos") + F.col("n")).alias("pos"))), "reach")
        again = hops.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("n").alias("m"))
        hops = staged(hops.join(again, F.col("b") == F.col("c")).select("a", F.col("d").alias("b"), (F.col("n") + F.col("m")).alias("n")), "hops")
        step *= 2
    return reach.join(first, "cell").select("head", "pos", "member")
