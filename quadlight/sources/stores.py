"""Datasets from configurations, Parquet snapshots, and dictionary-coded statements in SQL databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlight import terms as T
from quadlight.sources import documents
from quadlight.sources.dataset import Dataset
from quadlight.sources.mapping import sample_tables


def open_dataset(spark: SparkSession, config: dict | str) -> Dataset:
    """``config``: a path of RDF files; or a dict with any of ``files`` (paths, or paths by graph IRI), ``snapshot`` (a
    folder that ``save`` wrote), ``tables`` (a folder of the sample tables), ``jdbc`` (options of ``read_dictionary``)."""
    config = {"files": [config]} if isinstance(config, str) else config
    unknown = set(config) - {"files", "snapshot", "tables", "jdbc"}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if set(config) == {"snapshot"}:
        path = config["snapshot"]
        return Dataset(spark, load(spark, path), scan=lambda p: load(spark, path, p))
    parts = []
    files = config.get("files", [])
    for graph, path in files.items() if isinstance(files, dict) else [(None, f) for f in files]:
        quads = documents.read(spark, path)
        parts.append(quads if graph is None else quads.withColumn("g", F.lit(graph)))
    if "snapshot" in config:
        parts.append(load(spark, config["snapshot"]))
    if "jdbc" in config:
        parts.append(read_dictionary(spark, **config["jdbc"]))
    quads = None
    for p in parts:
        quads = p if quads is None else quads.union(p)
    return Dataset(spark, quads, tuple(sample_tables(spark, config["tables"])) if "tables" in config else ())


def save(quads: DataFrame, path: str, mode: str = "errorifexists", buckets: int = 64) -> None:
    """A snapshot for pattern matching: a folder for each bucket of predicates, sorted by predicate and subject, so a
    pattern with a constant predicate reads few row groups of one folder."""
    bucket = F.concat(F.lit(f"{buckets}-"), F.pmod(F.xxhash64("p.lex"), F.lit(buckets)).cast("string"))
    # Rows of one predicate are dealt over tasks by subject: a predicate may hold most of the data.
    dealt = quads.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("s.lex"), F.lit(16)))
    dealt.sortWithinPartitions("bucket", "p.lex", "s.lex").write.mode(mode).partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str, predicate: str | None = None) -> DataFrame:
    """The quads of a snapshot, or those of a predicate, from its bucket alone. The folders' names hold their number."""
    quads = spark.read.parquet(path)
    if predicate is not None:
        bucket = F.split("bucket", "-")
        at = F.pmod(F.xxhash64(F.lit(predicate)), bucket[0].cast("int")).cast("string")
        quads = quads.where((bucket[1] == at) & (F.col("p.lex") == predicate))
    return quads.select("s", "p", "o", "g")


def bgp_sql(triples: list[tuple], model: str, quote: str = '"') -> str:
    """A basic graph pattern as one SQL query over dictionary-coded tables: the text of each variable, by its name.

    Terms that are constant are looked up in the dictionaries by a subquery, patterns join on coded ids, and only the
    variables' ids are decoded, so nothing but the solutions leaves the database.
    """
    text = lambda x: "'" + x.replace("'", "''") + "'"
    name = lambda x: quote + x.replace(quote, quote * 2) + quote
    places: dict[str, list[str]] = {}
    tables, tests = [], []
    for k, triple in enumerate(triples):
        tables.append(f"{name('Statements' + model)} t{k}")
        for column, node in zip(("Subject", "Predicate", "Object"), triple, strict=True):
            here = f"t{k}.{name(column)}"
            if isinstance(node, T.Var):
                places.setdefault(node.name, []).append(here)
            elif isinstance(node, T.Iri):
                tests.append(f"{here} = (SELECT {name('ID')} FROM {name('Resources')} WHERE {name('URI')} = {text(node.value)})")
            elif isinstance(node, T.Literal):
                same = [f"{name('Value')} = {text(node.value)}", f"coalesce({name('Language')}, '') = {text((node.lang or '').lower())}", f"coalesce({name('Datatype')}, '') = {text('' if node.dt == T.XSD + 'string' else node.dt or '')}"]
                tests.append(f"{here} = (SELECT {name('ID')} FROM {name('Literals')} WHERE {' AND '.join(same)})")
            else:
                raise ValueError("a blank node of a pattern is a variable")
    columns = []
    for v, found in places.items():
        tests += [f"{found[0]} = {other}" for other in found[1:]]
        if v.startswith("_:"):
            continue
        i = len(columns)
        tables.append(f"LEFT JOIN {name('Resources')} r{i} ON r{i}.{name('ID')} = {found[0]} LEFT JOIN {name('Literals')} l{i} ON l{i}.{name('ID')} = {found[0]} LEFT JOIN {name('Bnodes')} b{i} ON b{i}.{name('ID')} = {found[0]}")
        columns.append(f"coalesce(r{i}.{name('URI')}, l{i}.{name('Value')}, b{i}.{name('Name')}) AS {name(v)}")
    first = [t for t in tables if not t.startswith("LEFT JOIN")]
    rest = [t for t in tables if t.startswith("LEFT JOIN")]
    return f"SELECT {', '.join(columns) or '1 AS ' + name('unit')} FROM {' CROSS JOIN '.join(first)} {' '.join(rest)} WHERE {' AND '.join(tests) or '1 = 1'}"


def query_dictionary(spark: SparkSession, url: str, model: str, triples: list[tuple], **options: str) -> DataFrame:
    """The solutions of a basic graph pattern, found by the database itself."""
    return spark.read.format("jdbc").options(url=url, query=bgp_sql(triples, model), **options).load()


def decode(statements: DataFrame, resources: DataFrame, literals: DataFrame, blanks: DataFrame) -> DataFrame:
    """Quads of dictionary-coded statements (Subject, Predicate, Object, Context), Resources (ID, URI), Literals (ID,
    Value, Language, Datatype) and Bnodes (ID, Name). Context 0 is the default graph."""
    none = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    terms = resources.select(F.col("ID").alias("id"), T.boxed(T.IRI, F.col("URI")).cast(T.TERM).alias("term"))
    terms = terms.union(blanks.select("ID", T.boxed(T.BLANK, F.col("Name")).cast(T.TERM)))
    terms = terms.union(literals.select("ID", T.boxed(T.LITERAL, F.col("Value"), none("Language"), F.nullif(none("Datatype"), F.lit(T.XSD + "string"))).cast(T.TERM)))
    df = statements
    for column, to in (("Subject", "s"), ("Predicate", "p"), ("Object", "o")):
        df = df.join(terms.select(F.col("id").alias(f"_{to}"), F.col("term").alias(to)), F.col(column) == F.col(f"_{to}"))
    graphs = resources.select(F.col("ID").alias("_g"), F.col("URI").alias("g"))
    return df.join(graphs, F.col("Context") == F.col("_g"), "left").select("s", "p", "o", "g")


def read_dictionary(spark: SparkSession, url: str, model: str, **options: str) -> DataFrame:
    """Quads of a SQL database by JDBC; ``model`` is the suffix of its statements table."""
    read = lambda table: spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return decode(read(f"Statements{model}"), read("Resources"), read("Literals"), read("Bnodes"))
