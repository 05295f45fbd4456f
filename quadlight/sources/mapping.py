"""Relational tables seen as RDF.

A table gives every row a subject IRI (a template and a key column) or a blank node (the row itself), and every mapped
column a predicate with one static type, so patterns over mapped tables compile to column-pruned scans.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from quadlight.terms import RDF

BASE = "http://example.org/"
NS = BASE + "ns#"
TYPE = RDF + "type"


@dataclass(frozen=True)
class Property:
    column: str
    type: str  # a type of terms.Value
    template: str | None = None  # of the IRIs that it refers to
    lang_column: str | None = None


@dataclass
class TableMap:
    name: str
    read: Callable[[], DataFrame]
    properties: dict[str, Property]
    key: str | None = None
    template: str | None = None  # None: subjects are blank nodes
    classes: list[str] = field(default_factory=list)
    graph: Property | None = None  # triples are in these named graphs instead of the default graph
    once: bool = False  # ``read`` gives no row twice

    def only(self, wanted: Callable[[str], bool]) -> TableMap:
        """The same table with those of its predicates alone."""
        return replace(self, properties={p: x for p, x in self.properties.items() if wanted(p)}, classes=self.classes if wanted(TYPE) else [])


def _table(spark: SparkSession, sf_dir: str, name: str, key: str | None, properties: dict[str, tuple], kind: str | None = None, subject: str | None = None, graph: Property | None = None) -> TableMap:
    made = {}
    for predicate, (column, type, *ref) in properties.items():
        template = f"{BASE}{ref[0]}/" if ref and type == "iri" else None
        made[NS + predicate] = Property(column, type, template, ref[0] if ref and type == "lang" else None)
    kind = kind or name.capitalize()
    return TableMap(name, functools.cache(lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")), made, key, f"{BASE}{subject or name}/" if key else None, [NS + kind], graph)


def sample_tables(spark: SparkSession, sf_dir: str, document_graphs: bool = False) -> list[TableMap]:
    """The mapping of the sample tables. ``document_graphs``: documents are in a named graph for each source."""
    s, i, d, t, o = "string", "integer", "double", "dateTime", "iri"
    table = lambda *a, **k: _table(spark, sf_dir, *a, **k)
    graph = Property("source", "iri", BASE + "source/") if document_graphs else None
    return [
        table("region", "r_regionkey", {"name": ("r_name", s)}),
        table("nation", "n_nationkey", {"name": ("n_name", s), "region": ("n_regionkey", o, "region")}),
        table("customer", "c_custkey", {"name": ("c_name", s), "nation": ("c_nationkey", o, "nation"), "acctbal": ("c_acctbal", d), "mktsegment": ("c_mktsegment", s)}),
        table("supplier", "s_suppkey", {"name": ("s_name", s), "nation": ("s_nationkey", o, "nation"), "acctbal": ("s_acctbal", d)}),
        table("part", "p_partkey", {"name": ("p_name", s), "brand": ("p_brand", s), "type": ("p_type", s), "size": ("p_size", i), "retailprice": ("p_retailprice", d)}),
        table("orders", "o_orderkey", {"customer": ("o_custkey", o, "customer"), "orderstatus": ("o_orderstatus", s), "totalprice": ("o_totalprice", d), "orderdate": ("o_orderdate", t), "orderpriority": ("o_orderpriority", s)}, kind="Order", subject="order"),
        table("lineitem", None, {"order": ("l_orderkey", o, "order"), "part": ("l_partkey", o, "part"), "supplier": ("l_suppkey", o, "supplier"), "linenumber": ("l_linenumber", i), "quantity": ("l_quantity", d), "extendedprice": ("l_extendedprice", d), "discount": ("l_discount", d), "tax": ("l_tax", d), "returnflag": ("l_returnflag", s), "linestatus": ("l_linestatus", s), "shipdate": ("l_shipdate", t)}, kind="LineItem"),
        table("events", "event_id", {"ts": ("ts", t), "user": ("user_id", o, "user"), "eventType": ("event_type", s), "value": ("value", d), "props": ("props", s)}, kind="Event", subject="event"),
        table("documents", "doc_id", {"text": ("text", s), "textLang": ("text", "lang", "lang"), "lang": ("lang", s), "source": ("source", s), "chars": ("n_chars", i)}, kind="Document", subject="doc", graph=graph),
        table("labels", "doc_id", {"quality": ("quality", i), "toxic": ("toxic", i)}, kind="Label", subject="doc"),
        table("pages", "page_id", {"url": ("url", s), "html": ("html", s)}, kind="Page", subject="page"),
        table("benchmark", "item_id", {"itemText": ("text", s)}, kind="Item", subject="item"),
        table("conversations", None, {"conversation": ("conv_id", o, "conversation"), "turn": ("turn", i), "role": ("role", s), "utterance": ("text", s)}, kind="Turn"),
    ]
