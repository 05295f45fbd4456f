"""An RDF dataset: mapped tables and a quads frame. Immutable; updates give new datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlight import terms as T
from quadlight.sources.mapping import TableMap
from quadlight.terms import Value

QUAD = f"s {T.TERM}, p {T.TERM}, o {T.TERM}, g string"


@dataclass(frozen=True)
class Dataset:
    """``quads``: (s, p, o: boxed terms, g: graph IRI, NULL for the default graph).

    ``tables``: mapped tables. ``services``: endpoint IRI to dataset, for SERVICE. ``documents``: URL to dataset, for
    FROM and LOAD. ``computed``: predicate IRI to a function of the dataset that gives a frame (s, o: boxed terms) for
    statements that are computed. ``view``: the graphs that make up the default graph and those that are named, or None
    for all as they are.
    """

    spark: SparkSession
    quads: DataFrame | None = None
    tables: tuple[TableMap, ...] = ()
    services: dict[str, Dataset] = field(default_factory=dict)
    documents: dict[str, Dataset] = field(default_factory=dict)
    computed: dict[str, Callable[[Dataset], DataFrame]] = field(default_factory=dict)
    functions: dict[str, Callable[..., Value]] = field(default_factory=dict)
    view: tuple[tuple[str, ...], tuple[str, ...]] | None = None
    #: Gives those of ``quads`` with a predicate, for stores that find them without reading all.
    scan: Callable[[str], DataFrame] | None = None

    def with_view(self, default: list[str], named: list[str]) -> Dataset:
        return replace(self, view=(tuple(default), tuple(named))) if default or named else self

    def all_quads(self) -> DataFrame:
        """Every statement as a quad, those of mapped tables included."""
        parts = [self.quads] if self.quads is not None else []
        for t in self.tables:
            if not (t.properties or t.classes):
                continue
            df = t.read()
            subject = Value(F.col(t.key), "iri", t.template) if t.key else Value(row_label(df), "blank")
            graph = Value(F.col(t.graph.column), "iri", t.graph.template).lex() if t.graph else F.lit(None).cast("string")
            made = [(p, Value(F.col(x.column), x.type, x.template, F.col(x.lang_column) if x.lang_column else None)) for p, x in t.properties.items()]
            made += [(T.RDF + "type", Value(F.lit(c), "iri")) for c in t.classes]
            pairs = F.array(*[F.struct(T.boxed(T.IRI, F.lit(p)).alias("p"), v.box().alias("o")) for p, v in made])
            rows = df.select(subject.box().alias("s"), F.explode(pairs).alias("x"), graph.alias("g"))
            parts.append(rows.select("s", "x.p", "x.o", "g").where("o is not null and s is not null"))
        if not parts:
            return self.spark.createDataFrame([], QUAD)
        return reduce(lambda a, b: a.union(b), parts)

    def materialised(self) -> Dataset:
        """The same statements, all of them quads."""
        return replace(self, quads=self.all_quads(), tables=(), scan=None) if self.tables else self

    def opened(self, predicates: Callable[[TableMap], set[str] | None]) -> Dataset:
        """The same statements; those with the ``predicates`` of a table (None: any) become quads, all others stay mapped."""
        out, kept = [], []
        for t in self.tables:
            names = predicates(t)
            moved = t if names is None else t.only(names.__contains__)
            if not (moved.properties or moved.classes):
                kept.append(t)
                continue
            out.append(moved)
            if names is not None:
                kept.append(t.only(lambda p, names=names: p not in names))
        return replace(self, quads=replace(self, tables=tuple(out)).all_quads(), tables=tuple(kept), scan=None) if out else self

    def with_quads(self, quads: DataFrame) -> Dataset:
        return replace(self, quads=quads, scan=None)

    # Accessors

    def _distinct(self, position: str, **bound) -> DataFrame:
        quads = self.all_quads()
        for k, v in bound.items():
            if v is not None:
                quads = quads.where(F.col(k) == T.constant(v).box() if k != "g" else F.col("g") == v.value)
        return quads.select(position).distinct()

    def subjects(self, p=None, o=None) -> DataFrame:
        return self._distinct("s", p=p, o=o)

    def predicates(self, s=None, o=None) -> DataFrame:
        return self._distinct("p", s=s, o=o)

    def objects(self, s=None, p=None, type: str | None = None, lang: str | None = None, datatype: str | None = None) -> DataFrame:
        """Distinct objects; ``type`` is literal, resource or blank."""
        out = self._distinct("o", s=s, p=p)
        if type:
            out = out.where(F.col("o.kind") == {"blank": T.BLANK, "resource": T.IRI, "literal": T.LITERAL}[type])
        if lang:
            out = out.where(F.lower("o.lang") == lang.lower())
        if datatype:
            out = out.where(F.col("o.dt") == datatype)
        return out

    def graphs(self) -> DataFrame:
        """The names of all graphs. Of a mapped table only the column of its graphs is read."""
        parts = [] if self.quads is None else [self.quads.select("g")]
        for t in self.tables:
            if t.graph and (t.properties or t.classes):
                parts.append(t.read().select(Value(F.col(t.graph.column), "iri", t.graph.template).lex().alias("g")).distinct())
        if not parts:
            return self.spark.createDataFrame([], "g string")
        return reduce(lambda a, b: a.union(b), parts).where("g is not null").distinct()

    def count_statements(self, quads: bool = False) -> int:
        """Distinct triples over all graphs, or distinct quads."""
        return self.all_quads().select("s", "p", "o", *(["g"] if quads else [])).distinct().count()

    def etag(self) -> str:
        """Equal for equal sets of quads."""
        h = F.xxhash64("s.kind", "s.lex", "p.lex", "o.kind", "o.lex", "o.lang", "o.dt", "g")
        n, a = self.all_quads().distinct().agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first()
        return f"{n:x}-{a or 0}"

    # Views

    def filtered(self, condition) -> Dataset:
        """Only the statements for which ``condition``, a column over (s, p, o, g), holds."""
        return replace(self.materialised(), quads=self.all_quads().where(condition), scan=None)

    def union(self, *others: Dataset) -> Dataset:
        quads = reduce(lambda a, b: a.union(b), [d.all_quads() for d in (self, *others)])
        return replace(self, quads=quads.distinct(), tables=(), scan=None)

    def preferring(self, languages: dict[str, float]) -> Dataset:
        """For each subject and predicate keeps the literals of the language of the best weight; all else stays."""
        from pyspark.sql import Window

        quads = self.all_quads()
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in languages.items() for x in (k.lower(), float(v))]), F.lower("o.lang")), F.lit(0.0))
        best = Window.partitionBy("s", "p", "g")
        ranked = quads.where("o.lang is not null").withColumn("_w", weight)
        ranked = ranked.withColumn("_top", F.max(F.struct("_w", F.lower("o.lang").alias("l"))).over(best))
        kept = ranked.where(F.col("_top.l") == F.lower("o.lang")).drop("_w", "_top")
        return replace(self, quads=quads.where("o.lang is null").union(kept), tables=(), scan=None)


def row_label(df: DataFrame):
    """A label that only depends on a row's content."""
    return F.sha2(F.to_json(F.struct(*df.columns)), 256)
