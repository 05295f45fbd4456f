"""The catalogue's second part: formats, stores, extension functions and the programming interface."""

from __future__ import annotations

import hashlib
import json
import types
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlight import engine
from quadlight import terms as T
from quadlight.engine import query, update
from quadlight.functions import plugins
from quadlight.plans import compiler as C
from quadlight.plans import shorthand as S
from quadlight.plans.parser import SparqlError, parse_query, parse_update
from quadlight.queries import ALL_NAMES, CLOSURE, GRAPH_COUNTS, NEXT, PREFIXES, TEXT_QUADS, _iri, _quads_as_text, mapped, nation_quads
from quadlight.sources import documents, ntriples, serializers, stores
from quadlight.sources.dataset import Dataset
from quadlight.sources.mapping import BASE, NS
from quadlight.storage import shared_dir
from quadlight.streaming import patch

SPARQL: dict[str, str] = {}
QUADS: dict[str, str] = {}
MADE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NAMES = f"SELECT {_iri('n_nationkey')} AS s, n_name AS n FROM nation"


def _made(name: str, sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        MADE[name], SQL[name] = f, sql
        return f

    return keep


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """Writes one document (lines in order) and gives its path."""
    path = _path(spark, name)
    lines.coalesce(1).write.text(path)
    return path


def _row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def _names(dataset: Dataset) -> DataFrame:
    return query(ALL_NAMES, dataset, prefixes=PREFIXES)


# EXISTS whose inner parts speak of the row outside

SPARQL["exists_union"] = "SELECT ?c WHERE { ?c a :Customer ; :acctbal ?b FILTER EXISTS { { ?o :customer ?c ; :totalprice ?p FILTER(?p > ?b * 45) } UNION { ?c :nation ?n . ?s a :Supplier ; :nation ?n ; :acctbal ?q FILTER(?q > ?b + 9000) } } }"
SQL["exists_union"] = f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 45) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal + 9000)"
SPARQL["exists_optional"] = "SELECT ?n WHERE { ?n a :Nation ; :name ?t FILTER EXISTS { ?s a :Supplier ; :nation ?n OPTIONAL { ?c a :Customer ; :nation ?n ; :name ?m FILTER(STRLEN(?m) > STRLEN(?t) + 11) } FILTER(!BOUND(?m)) } }"
SQL["exists_optional"] = f"SELECT {_iri('n_nationkey')} AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND length(c_name) > length(n_name) + 11)"
SPARQL["exists_nested"] = "SELECT ?c WHERE { ?c a :Customer ; :acctbal ?b FILTER EXISTS { ?c :nation ?n FILTER NOT EXISTS { ?s a :Supplier ; :nation ?n ; :acctbal ?q FILTER(?q > ?b) } } }"
SQL["exists_nested"] = f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE c_nationkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal)"
SPARQL["exists_minus"] = "SELECT ?r WHERE { ?r a :Region ; :name ?t FILTER EXISTS { ?n :region ?r MINUS { ?n :name ?m FILTER(?m < ?t) } } }"
SQL["exists_minus"] = f"SELECT '{BASE}region/' || r_regionkey AS r FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND NOT n_name < r_name)"

# Exact numbers

SPARQL["decimal_sum"] = "SELECT (0.1 + 0.2 = 0.3 AS ?a) (STR(SUM(?x)) AS ?s) (STR(AVG(?x)) AS ?m) (SUM(?x) = 0.6 AS ?e) (STR(SUM(?y)) AS ?t) WHERE { VALUES (?x ?y) { (0.1 0.1) (0.2 '0.20'^^xsd:decimal) (0.3 3) } }"
SQL["decimal_sum"] = "SELECT true AS a, '0.6' AS s, '0.2' AS m, true AS e, '3.3' AS t"
SPARQL["decimal_prices"] = "SELECT ?b (STR(SUM(xsd:decimal(?p) * 0.05)) AS ?tax) WHERE { ?x a :Part ; :brand ?b ; :retailprice ?p } GROUP BY ?b"
SQL["decimal_prices"] = r"SELECT p_brand AS b, regexp_replace(CAST(sum(CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(20, 6)) * CAST(0.05 AS DECIMAL(4, 2))) AS VARCHAR), '\.?0+$', '') AS tax FROM part GROUP BY 1"
SPARQL["big_integer_compare"] = "SELECT (?x = ?y AS ?a) (?x > ?y AS ?b) (STR(?x - ?y) AS ?c) (STR(?x + 1) AS ?d) WHERE { VALUES (?x ?y) { (9223372036854775807 9223372036854775806) (12345678901234567890 12345678901234567889) (12345678901234567890123456789012345 1) } }"
SQL["big_integer_compare"] = "SELECT x = y AS a, x > y AS b, CAST(x - y AS VARCHAR) AS c, CAST(x + 1 AS VARCHAR) AS d FROM (VALUES (9223372036854775807::HUGEINT, 9223372036854775806::HUGEINT), (12345678901234567890::HUGEINT, 12345678901234567889::HUGEINT), (12345678901234567890123456789012345::HUGEINT, 1::HUGEINT)) t(x, y)"
SPARQL["integer_sum_exact"] = "SELECT (STR(SUM(?x)) AS ?s) (STR(AVG(?z)) AS ?e) WHERE { VALUES (?x ?z) { (9223372036854775807 UNDEF) (9223372036854775807 UNDEF) ('1'^^xsd:byte UNDEF) } OPTIONAL { VALUES ?z { 1 } FILTER(false) } }"
SQL["integer_sum_exact"] = "SELECT '18446744073709551615' AS s, CAST(NULL AS VARCHAR) AS e"
SPARQL["casts_decimal_datetime"] = "SELECT ?z (STR(xsd:decimal(STR(?z))) AS ?a) (STR(xsd:decimal('+01.50')) AS ?b) (xsd:decimal('1e3') AS ?n) (YEAR(xsd:dateTime('2011-01-10T14:45:13Z')) AS ?y) (BOUND(?w) AS ?c) (STR(xsd:decimal(?p)) = STR(xsd:decimal(STR(?p))) AS ?d) WHERE { ?x a :Part ; :size ?z ; :retailprice ?p BIND(xsd:dateTime('2011-13') AS ?w) }"
SQL["casts_decimal_datetime"] = "SELECT p_size AS z, CAST(p_size AS VARCHAR) AS a, '1.5' AS b, CAST(NULL AS DECIMAL(38, 18)) AS n, 2011::BIGINT AS y, false AS c, true AS d FROM part"

# Selection, terms, functions

SPARQL["select_star"] = "SELECT * WHERE { ?r a :Region ; :name ?n }"
SQL["select_star"] = f"SELECT '{BASE}region/' || r_regionkey AS r, r_name AS n FROM region"
SPARQL["bnode_function"] = "SELECT ?n (isBlank(BNODE()) AS ?a) (BNODE('x') = BNODE('x') AS ?b) (BNODE('x') = BNODE('y') AS ?c) WHERE { ?r a :Region ; :name ?n }"
SQL["bnode_function"] = "SELECT r_name AS n, true AS a, true AS b, false AS c FROM region"
SPARQL["fn_numbers"] = "SELECT ?b (fn:abs(?b) AS ?a) (fn:ceiling(?b) AS ?c) (fn:floor(?b) AS ?f) (fn:round(?b) AS ?r) WHERE { ?s a :Supplier ; :acctbal ?b }"
SQL["fn_numbers"] = "SELECT s_acctbal AS b, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(s_acctbal) AS r FROM supplier"
SPARQL["fn_strings"] = "SELECT (fn:concat(?n, '-', ?k) AS ?a) (fn:encode-for-uri(?u) AS ?b) (fn:lower-case(?n) AS ?c) (fn:starts-with(?n, 'A') AS ?d) (fn:ends-with(?n, 'A') AS ?e) WHERE { ?x a :Nation ; :name ?n ; :region/:name ?k BIND(CONCAT(?n, ' /', ?k) AS ?u) }"
SQL["fn_strings"] = "SELECT n_name || '-' || r_name AS a, url_encode(n_name || ' /' || r_name) AS b, lower(n_name) AS c, starts_with(n_name, 'A') AS d, ends_with(n_name, 'A') AS e FROM nation JOIN region ON n_regionkey = r_regionkey"
SPARQL["fn_dates"] = "SELECT ?e (fn:year-from-dateTime(?t) AS ?y) (fn:month-from-dateTime(?t) AS ?m) (fn:day-from-dateTime(?t) AS ?d) (fn:hours-from-dateTime(?t) AS ?h) (fn:minutes-from-dateTime(?t) AS ?i) (xsd:double(fn:floor(fn:seconds-from-dateTime(?t))) AS ?s) WHERE { ?e :ts ?t }"
SQL["fn_dates"] = f"SELECT '{BASE}event/' || event_id AS e, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS i, CAST(floor(second(ts)) AS DOUBLE) AS s FROM events"
SPARQL["fn_timezone"] = "SELECT (STR(fn:timezone-from-dateTime(?d)) AS ?z) WHERE { VALUES ?d { '2011-01-10T14:45:13-05:30'^^xsd:dateTime '2011-01-10T14:45:13Z'^^xsd:dateTime '2011-01-10T14:45:13'^^xsd:dateTime } }"
SQL["fn_timezone"] = "SELECT * FROM (VALUES ('-PT5H30M'), ('PT0S'), (NULL)) t(z)"
JENA = "java:com.hp.hpl.jena.query.function.library."
SPARQL["extension_functions"] = f"SELECT ?d (<{JENA}sha1sum>(?t) AS ?a) (<{JENA}langeq>(?t, 'fr') AS ?b) (YEAR(<{JENA}now>()) > 2000 AS ?c) (<http://kasei.us/2007/09/functions/warn>(?k) AS ?w) WHERE {{ ?d :textLang ?t ; :chars ?k }}"
SQL["extension_functions"] = f"SELECT '{BASE}doc/' || doc_id AS d, sha1(text) AS a, lang = 'fr' AS b, true AS c, n_chars AS w FROM documents"
#: The names in the sample's region table.
REGION_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_digests = ", ".join("('{}', '{}', '{}', '{}')".format(n, *(hashlib.new(h, n.encode()).hexdigest() for h in ("sha224", "sha384", "sha512"))) for n in REGION_NAMES)
SQL["sha224_384_512"] = f"SELECT r_name AS n, a, b, c FROM region LEFT JOIN (VALUES {_digests}) t(n, a, b, c) ON r_name = t.n"


@_made("list_member_filter", "SELECT m, ok FROM (VALUES ('a', true), ('c', true), ('d', false)) t(m, ok)")
def list_member_filter(spark, sf_dir):
    dataset = update("INSERT DATA { e:l e:items ('a' 'b' 'c') . e:q e:asks 'a' , 'c' , 'd' }", Dataset(spark), prefixes=PREFIXES)
    return query("SELECT ?m (<http://jena.hpl.hp.com/ARQ/function#listMember>(?list, ?m) AS ?ok) WHERE { e:l e:items ?list . e:q e:asks ?m }", dataset, prefixes=PREFIXES)


@_made("function_set", "SELECT n_name AS n, length(n_name) * 2 AS x FROM nation")
def function_set(spark, sf_dir):
    made = types.ModuleType("twice")
    made.install = lambda register: register("urn:twice", lambda v: T.Value(F.length(v.col).cast("bigint") * 2, "integer"))
    plugins.install(made)
    return query("SELECT ?n (<urn:twice>(?n) AS ?x) WHERE { ?r a :Nation ; :name ?n }", mapped(spark, sf_dir), prefixes=PREFIXES)


@_made("hooks", "SELECT r_name AS n, 2::BIGINT AS calls FROM region")
def hooks(spark, sf_dir):
    """Both hooks are called once around a query."""
    seen = []
    before, after = lambda q, dataset: seen.append(q.form), lambda q, df: seen.append(df.columns)
    engine.HOOKS["before"].append(before)
    engine.HOOKS["after"].append(after)
    try:
        found = query("SELECT ?n WHERE { ?r a :Region ; :name ?n }", mapped(spark, sf_dir), prefixes=PREFIXES)
    finally:
        engine.HOOKS["before"].remove(before)
        engine.HOOKS["after"].remove(after)
    return found.withColumn("calls", F.lit(len(seen)).cast("long"))


ALGEBRA = f"(slice 0 5 (distinct (project (?n) (order ((asc ?n)) (filter (> ?b 5) (bgp (triple ?x <{NS}name> ?n) (triple ?x <{NS}acctbal> ?b)))))))"


@_made("algebra_text", f"SELECT '{ALGEBRA.replace('(> ?b 5)', '(> ?b ' + json.dumps('5') + '^^<' + T.XSD + 'integer>)')}' AS algebra, true AS plan")
def algebra_text(spark, sf_dir):
    text = "SELECT DISTINCT ?n WHERE { ?x :name ?n ; :acctbal ?b FILTER(?b > 5) } ORDER BY ?n LIMIT 5"
    algebra, _, plan = engine.explain(text, mapped(spark, sf_dir), prefixes=PREFIXES).partition("\n\n")
    return _row(spark, algebra=" ".join(algebra.split()), plan="Physical Plan" in plan)


@_made("algebra_shorthand", "SELECT c_name AS n, c_acctbal * 2 AS d FROM customer WHERE c_acctbal > 5000.5")
def algebra_shorthand(spark, sf_dir):
    q = S.project("n", ("d", S.times("?b", 2)))(S.where(S.triple("?x", T.RDF + "type", NS + "Customer"), S.triple("?x", NS + "name", "?n"), S.triple("?x", NS + "acctbal", "?b"), S.gt("?b", 5000.5)))
    return engine.native(engine.solve(q, mapped(spark, sf_dir)))


@_made("path_repeat_open", f"{CLOSURE}, two(a, b) AS (SELECT e.a, f.b FROM {NEXT} e JOIN {NEXT} f ON e.b = f.a) SELECT DISTINCT {_iri('a')} AS a, {_iri('b')} AS b FROM (SELECT two.a, t.b FROM two JOIN t ON two.b = t.a UNION ALL SELECT a, b FROM two)")
def path_repeat_open(spark, sf_dir):
    """{2,}: two steps or more."""
    return engine.native(C.pattern(S.path("?a", S.repeat(S.step(f"{BASE}step#next"), 2), "?b"), C.Context(nation_quads(spark, sf_dir))))


@_made("join_strategy", "SELECT c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_strategy(spark, sf_dir):
    return query("SELECT ?c ?n WHERE { ?x a :Customer ; :name ?c ; :nation ?y . ?y :name ?n }", mapped(spark, sf_dir), prefixes=PREFIXES, join="merge")


@_made("strict_errors", "SELECT true AS mixed, 1::BIGINT AS least")
def strict_errors(spark, sf_dir):
    text = "SELECT (MIN(?v) AS ?m) WHERE { VALUES ?v { 3 %s 1 } }"
    failed = False
    try:
        query(text % "'x'", Dataset(spark), strict=True).collect()
    except Exception as e:  # Spark wraps what a task raises
        failed = "several kinds" in str(e)
    return query(text % "2.5", Dataset(spark), strict=True).select(F.lit(failed).alias("mixed"), F.col("m").cast("bigint").alias("least"))


@_made("query_each", "SELECT n_name AS n FROM nation UNION SELECT r_name FROM region")
def query_each(spark, sf_dir):
    """One query over two datasets that overlap."""
    other = update("INSERT { ?r e:name ?n } WHERE { ?r a :Region ; :name ?n }", mapped(spark, sf_dir), prefixes=PREFIXES)
    found = engine.query_each("SELECT ?n WHERE { ?s e:name ?n }", [nation_quads(spark, sf_dir), other, nation_quads(spark, sf_dir)], prefixes=PREFIXES)
    return found.select(F.col("n.lex").alias("n"))


# Checks before anything runs


def _refused(f: Callable[[], object]) -> bool:
    try:
        f()
    except SparqlError:
        return True
    return False


@_made("write_permission", "SELECT true AS refused, true AS allowed")
def write_permission(spark, sf_dir):
    text = "INSERT DATA { <urn:a> <urn:b> 1 }"
    return _row(spark, refused=_refused(lambda: parse_update(text, allow=False)), allowed=not _refused(lambda: parse_update(text)))


@_made("projection_check", "SELECT true AS loose, true AS grouped, true AS bound_twice")
def projection_check(spark, sf_dir):
    texts = {"loose": "SELECT ?x (COUNT(*) AS ?n) WHERE { ?x ?y ?z }", "grouped": "SELECT ?z WHERE { ?x ?y ?z } GROUP BY ?x", "bound_twice": "SELECT ?x WHERE { ?x ?y ?z BIND(1 AS ?x) }"}
    return _row(spark, **{k: _refused(lambda t=t: parse_query(t)) for k, t in texts.items()})


# Updates


@_made("create_graph", f"SELECT '{BASE}graph/' || n_regionkey AS g, count(*) AS n FROM nation GROUP BY 1")
def create_graph(spark, sf_dir):
    """A graph is there once it holds a statement: creating one changes no answer."""
    return query(GRAPH_COUNTS, update("CREATE GRAPH g:77", nation_quads(spark, sf_dir), prefixes=PREFIXES), prefixes=PREFIXES)


@_made("update_log", f"SELECT 0::BIGINT AS seq, 'D' AS op, {_iri('n_nationkey')} AS s, n_name AS o FROM nation WHERE length(n_name) > 8 UNION ALL SELECT 1, 'A', '{BASE}nation/99', 'NOWHERE'")
def update_log(spark, sf_dir):
    log: list[DataFrame] = []
    update("DELETE { ?s e:name ?n } WHERE { ?s e:name ?n FILTER(STRLEN(?n) > 8) } ; INSERT DATA { nation:99 e:name 'NOWHERE' }", nation_quads(spark, sf_dir), prefixes=PREFIXES, log=log.append)
    return log[0].union(log[1]).select("seq", "op", F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


# Stores


def _coded(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nations as dictionary-coded tables: ids are hashes of the terms."""
    quads = nation_quads(spark, sf_dir).all_quads()
    code = lambda c: F.xxhash64(F.col(f"{c}.kind"), F.col(f"{c}.lex"))
    graph = F.coalesce(F.when(F.col("g").isNotNull(), F.xxhash64(F.lit(T.IRI).cast("tinyint"), "g")), F.lit(0).cast("long"))
    terms = quads.select(F.explode(F.array("s", "p", "o")).alias("t")).select("t.*")
    terms = terms.union(quads.where("g is not null").select(F.lit(T.IRI).cast("tinyint"), "g", F.lit(None).cast("string"), F.lit(None).cast("string"))).distinct()
    coded = terms.withColumn("ID", F.xxhash64("kind", "lex"))
    return {
        "Statements7": quads.select(code("s").alias("Subject"), code("p").alias("Predicate"), code("o").alias("Object"), graph.alias("Context")),
        "Resources": coded.where(f"kind = {T.IRI}").select("ID", F.col("lex").alias("URI")),
        "Literals": coded.where(f"kind = {T.LITERAL}").select("ID", F.col("lex").alias("Value"), F.coalesce("lang", F.lit("")).alias("Language"), F.coalesce("dt", F.lit("")).alias("Datatype")),
        "Bnodes": coded.where(f"kind = {T.BLANK}").select("ID", F.col("lex").alias("Name")),
    }


@_made("dictionary_store", TEXT_QUADS)
def dictionary_store(spark, sf_dir):
    t = _coded(spark, sf_dir)
    return _quads_as_text(stores.decode(t["Statements7"], t["Resources"], t["Literals"], t["Bnodes"]))


@_made("dictionary_bgp", f"SELECT {_iri('a')} AS a, m.n_name AS m FROM {NEXT} e JOIN nation n ON e.a = n.n_nationkey JOIN nation m ON e.b = m.n_nationkey WHERE n.n_name = 'NATION_7'")
def dictionary_bgp(spark, sf_dir):
    """The SQL that a database gets for a basic graph pattern, run by Spark over the same tables."""
    for name, df in _coded(spark, sf_dir).items():
        df.createOrReplaceTempView(name)
    name, a, b = T.Iri(BASE + "step#name"), T.Var("a"), T.Var("_:b")
    return spark.sql(stores.bgp_sql([(a, name, T.Literal("NATION_7")), (a, T.Iri(BASE + "step#next"), b), (b, name, T.Var("m"))], "7", quote="`"))


@_made("private_predicates", f"{NAMES} UNION ALL SELECT {_iri('a')}, {_iri('b')} FROM {NEXT} WHERE false")
def private_predicates(spark, sf_dir):
    hidden = nation_quads(spark, sf_dir).filtered(f"p.lex <> '{BASE}step#next'")
    return query("SELECT ?s ?n WHERE { { ?s e:name ?n } UNION { ?s e:next ?n } }", hidden, prefixes=PREFIXES)


@_made("snapshot_scan", NAMES)
def snapshot_scan(spark, sf_dir):
    path = _path(spark, "snapshot")
    stores.save(nation_quads(spark, sf_dir).all_quads(), path)
    return _names(stores.open_dataset(spark, {"snapshot": path}))


@_made("sparql_store", "SELECT r_name AS r, count(*) AS k FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sparql_store(spark, sf_dir):
    """A whole query that is answered by another dataset."""
    dataset = Dataset(spark, services={"urn:other": mapped(spark, sf_dir)})
    return query("SELECT ?r ?k WHERE { SERVICE <urn:other> { SELECT ?r (COUNT(?n) AS ?k) WHERE { ?n :region/:name ?r } GROUP BY ?r } }", dataset, prefixes=PREFIXES)


@_made("store_factory", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def store_factory(spark, sf_dir):
    """A dataset made of a file in a named graph and the mapped tables."""
    names = nation_quads(spark, sf_dir).filtered("p.lex like '%name'").all_quads()
    path = _written(spark, ntriples.lines(names, graphs=False), "names")
    spark_path = f"{path}/*.txt"
    quads = ntriples.read(spark, spark_path).withColumn("g", F.lit("urn:names"))
    nq = _path(spark, "names-nq") + ".nq"
    ntriples.write(quads, nq)
    dataset = stores.open_dataset(spark, {"files": {"urn:names": nq}, "tables": sf_dir})
    return query("SELECT ?n ?r WHERE { GRAPH <urn:names> { ?x e:name ?n } ?x :region/:name ?r }", dataset, prefixes=PREFIXES)


@_made("accessors", f"SELECT 's' AS place, {_iri('n_nationkey')} AS t FROM nation UNION ALL SELECT 'p', '{BASE}step#' || p FROM (VALUES ('name'), ('next'), ('in')) x(p) UNION ALL SELECT 'o', n_name FROM nation")
def accessors(spark, sf_dir):
    d = nation_quads(spark, sf_dir)
    parts = [d.subjects(p=T.Iri(BASE + "step#name")).toDF("t"), d.predicates().toDF("t"), d.objects(p=T.Iri(BASE + "step#name"), type="literal").toDF("t")]
    named = [x.select(F.lit(k).alias("place"), F.col("t.lex").alias("t")) for k, x in zip("spo", parts, strict=True)]
    return named[0].union(named[1]).union(named[2])


@_made("dataset_counts", "SELECT 3 * count(*) AS triples, 3 * count(*) AS quads, count(DISTINCT n_regionkey) AS graphs, true AS same, true AS other FROM nation")
def dataset_counts(spark, sf_dir):
    d = nation_quads(spark, sf_dir)
    shuffled = d.with_quads(d.all_quads().repartition(3))
    return _row(spark, triples=d.count_statements(), quads=d.count_statements(quads=True), graphs=d.graphs().count(), same=d.etag() == shuffled.etag(), other=d.etag() != d.filtered("g is null").etag()).selectExpr("cast(triples as bigint) triples", "cast(quads as bigint) quads", "cast(graphs as bigint) graphs", "same", "other")


# Formats


def _document(spark: SparkSession, lines: DataFrame, format: str) -> DataFrame:
    return _quads_as_text(documents.read(spark, _written(spark, lines, format), format=format))


TRIPLES = TEXT_QUADS.split(" UNION ALL ")
PLAIN_TRIPLES = " UNION ALL ".join(TRIPLES[:2])
SHORT = {"e": BASE + "step#", "n": BASE + "nation/"}


def _default_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_quads(spark, sf_dir).filtered("g is null").all_quads()


@_made("turtle_roundtrip", PLAIN_TRIPLES)
def turtle_roundtrip(spark, sf_dir):
    return _document(spark, serializers.turtle_lines(_default_graph(spark, sf_dir), SHORT), "turtle")


@_made("trig_roundtrip", TEXT_QUADS)
def trig_roundtrip(spark, sf_dir):
    return _document(spark, serializers.turtle_lines(nation_quads(spark, sf_dir).all_quads(), SHORT, graphs=True), "trig")


@_made("rdf_xml_roundtrip", PLAIN_TRIPLES)
def rdf_xml_roundtrip(spark, sf_dir):
    text = serializers.rdf_xml(_default_graph(spark, sf_dir))
    return _document(spark, _row(spark, value=text), "rdfxml")


@_made("rdf_json_roundtrip", PLAIN_TRIPLES)
def rdf_json_roundtrip(spark, sf_dir):
    """Each subject is an object of its own; a document holds them all."""
    parts = serializers.rdf_json_lines(_default_graph(spark, sf_dir))
    inner = F.array_join(F.array_sort(F.collect_list(F.expr("substring(value, 2, length(value) - 2)"))), ",")
    return _document(spark, parts.agg(F.concat(F.lit("{"), inner, F.lit("}")).alias("value")), "rdfjson")


@_made("rdfa_document", f"SELECT {_iri('n_nationkey')} AS s, '{BASE}step#name' AS p, n_name AS o, CAST(NULL AS VARCHAR) AS g FROM nation UNION ALL SELECT {_iri('n_nationkey')}, '{BASE}step#in', '{BASE}region/' || n_regionkey, NULL FROM nation")
def rdfa_document(spark, sf_dir):
    one = F.concat(F.lit(f'<div resource="{BASE}nation/'), "n_nationkey", F.lit('"><b property="name">'), "n_name", F.lit(f'</b> <a property="in" href="{BASE}region/'), "n_regionkey", F.lit('">region</a></div>'))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(one.alias("x")).agg(F.array_join(F.collect_list("x"), "\n").alias("x"))
    page = F.concat(F.lit(f'<html><body vocab="{BASE}step#">\n'), "x", F.lit("\n</body></html>"))
    return _document(spark, rows.select(page.alias("value")), "rdfa")


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("SELECT ?n ?r ?k WHERE { ?n a :Nation ; :name ?k ; :region ?r }", mapped(spark, sf_dir), terms=True, prefixes=PREFIXES)


BINDINGS = f"SELECT {_iri('n_nationkey')} AS n, '{BASE}region/' || n_regionkey AS r, n_name AS k FROM nation"


@_made("tsv_lines", f"SELECT chr(63) || 'n' || chr(9) || '?r' || chr(9) || '?k' AS value UNION ALL SELECT '<' || n || '>' || chr(9) || '<' || r || '>' || chr(9) || '\"' || k || '\"' FROM ({BINDINGS})")
def tsv_lines(spark, sf_dir):
    return serializers.tsv_lines(_bindings(spark, sf_dir))


@_made("csv_values", BINDINGS)
def csv_values(spark, sf_dir):
    path = _path(spark, "csv")
    serializers.csv_values(_bindings(spark, sf_dir)).write.option("header", True).csv(path)
    return spark.read.option("header", True).csv(path)


@_made("result_json_roundtrip", BINDINGS)
def result_json_roundtrip(spark, sf_dir):
    found = serializers.read_results(spark, serializers.results_json(_bindings(spark, sf_dir)))
    return found.select(*[F.col(f"{c}.lex").alias(c) for c in found.columns])


@_made("result_xml_roundtrip", BINDINGS)
def result_xml_roundtrip(spark, sf_dir):
    found = serializers.read_results(spark, serializers.results_xml(_bindings(spark, sf_dir)))
    return found.select(*[F.col(f"{c}.lex").alias(c) for c in found.columns])


@_made("result_table", "SELECT '| ' || rpad(r_name, CAST(w AS INTEGER), ' ') || ' |' AS line FROM region, (SELECT max(length(r_name)) AS w FROM region)")
def result_table(spark, sf_dir):
    text = serializers.text_table(query("SELECT ?n WHERE { ?r a :Region ; :name ?n }", mapped(spark, sf_dir), terms=True, prefixes=PREFIXES))
    return spark.createDataFrame([(x,) for x in text.split("\n")[3:-1]], "line string")


@_made("boolean_results", "SELECT true AS a, false AS b, true AS c, false AS d")
def boolean_results(spark, sf_dir):
    yes = bool(query("ASK { ?r a :Region }", mapped(spark, sf_dir), prefixes=PREFIXES).first()[0])
    read = lambda text: serializers.read_results(spark, text)
    return _row(spark, a=read(serializers.boolean_json(yes)), b=read(serializers.boolean_json(not yes)), c=read(serializers.boolean_xml(yes)), d=read(serializers.boolean_xml(not yes)))


@_made("graphviz_lines", f"SELECT '  \"' || {_iri('a')} || '\" -> \"' || {_iri('b')} || '\" [label=\"{BASE}step#next\"];' AS line FROM {NEXT}")
def graphviz_lines(spark, sf_dir):
    text = serializers.graphviz(nation_quads(spark, sf_dir).filtered("p.lex like '%next'").all_quads())
    return spark.createDataFrame([(x,) for x in text.split("\n")[1:-1]], "line string")


@_made("graph_as_dict", f"SELECT {_iri('n_nationkey')} AS s, n_name AS o, 'literal' AS type FROM nation")
def graph_as_dict(spark, sf_dir):
    found = serializers.as_dict(nation_quads(spark, sf_dir).filtered("p.lex like '%name'").all_quads())
    return spark.createDataFrame([(s, o["value"], o["type"]) for s, said in found.items() for o in said[f"{BASE}step#name"]], "s string, o string, type string")


@_made("patch_roundtrip", f"SELECT 'D' AS op, {_iri('n_nationkey')} AS s, n_name AS o FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'A', {_iri('n_nationkey')}, lower(n_name) FROM nation WHERE n_regionkey = 1")
def patch_roundtrip(spark, sf_dir):
    """The changes of an update, written as patch lines and read again."""
    before = nation_quads(spark, sf_dir)
    after = update("DELETE { ?s e:name ?n } INSERT { ?s e:name ?m } WHERE { GRAPH g:1 { ?s e:in ?r } ?s e:name ?n BIND(LCASE(?n) AS ?m) }", before, prefixes=PREFIXES)
    path = _written(spark, patch.lines(patch.difference(before.all_quads(), after.all_quads())), "patch")
    read = patch.parse_lines(spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()))
    return read.select("op", F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


@_made("patch_query", f"SELECT 1::BIGINT AS seq, {_iri('n_nationkey')} AS s, n_name AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 2, {_iri('a')}, {_iri('b')} FROM {NEXT} UNION ALL SELECT 3, {_iri('n_nationkey')}, '{BASE}region/2' FROM nation WHERE n_regionkey = 2")
def patch_query(spark, sf_dir):
    """Queries of a patch: a statement, all of a predicate, and all with an object in any graph."""
    text = f"@prefix n: <{BASE}nation/> . @prefix e: <{BASE}step#> . Q n:3 e:name U . Q U e:next U . Q U U <{BASE}region/2> U ."
    return patch.answers(nation_quads(spark, sf_dir).all_quads(), patch.parse_text(spark, text)).select("seq", F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


@_made("canonical_blank", "SELECT count(*) * 2 AS n, true AS same, true AS apart FROM nation")
def canonical_blank(spark, sf_dir):
    """Blank nodes with other labels give the same lines; one statement less gives others."""
    text = "SELECT ?s ?n WHERE { ?s e:name ?n }"
    rows = query(text, nation_quads(spark, sf_dir), terms=True, prefixes=PREFIXES)

    def graph(label):
        mid = T.boxed(T.BLANK, label).cast(T.TERM)
        p = lambda x: T.boxed(T.IRI, F.lit(f"{BASE}step#{x}")).cast(T.TERM)
        return rows.select(F.col("s"), p("about").alias("p"), mid.alias("o")).union(rows.select(mid, p("called"), F.col("n")))

    a, b = (ntriples.canonical(graph(x), onfail="die") for x in (F.md5("s.lex"), F.concat(F.lit("b"), F.sha1("s.lex"))))
    less = ntriples.canonical(graph(F.md5("s.lex")).where("o.lex <> 'NATION_3'"), onfail="die")
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("x")).crossJoin(a.exceptAll(less).agg(F.count(F.lit(1)).alias("y")))
    return a.agg(F.count(F.lit(1)).alias("n")).crossJoin(left).select("n", (F.col("x") == 0).alias("same"), (F.col("y") > 0).alias("apart"))


@_made("canonical_onfail", "SELECT * FROM (VALUES ('truncate', 1::BIGINT), ('keep', 3), ('append', 3), ('space', 4), ('die', -1)) t(mode, n)")
def canonical_onfail(spark, sf_dir):
    """Two blank nodes that nothing tells apart."""
    quads = update("INSERT DATA { e:a e:p _:x , _:y , 1 }", Dataset(spark), prefixes=PREFIXES).all_quads()

    def count(mode: str) -> int:
        try:
            return ntriples.canonical(quads, mode).count()
        except ValueError:
            return -1

    return spark.createDataFrame([(m, count(m)) for m in ("truncate", "keep", "append", "space", "die")], "mode string, n long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    run = lambda text, data: lambda spark, sf_dir: query(text, data(spark, sf_dir), prefixes=PREFIXES)
    return {k: run(v, mapped) for k, v in SPARQL.items()} | {k: run(v, nation_quads) for k, v in QUADS.items()} | MADE


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
