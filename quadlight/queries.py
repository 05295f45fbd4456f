"""The query catalogue: for each operator a query over the sample tables, with its equivalent for DuckDB.

Each entry is SPARQL text over the mapped tables (or a function of the session and the folder) and, where SQL can
express it, the SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlight import terms as T
from quadlight.engine import query, update
from quadlight.functions.expressions import OPERATORS
from quadlight.operators import rules
from quadlight.sources import ntriples
from quadlight.sources.dataset import Dataset
from quadlight.sources.mapping import BASE, NS, sample_tables
from quadlight.streaming import patch

PREFIXES = {"": NS, "xsd": T.XSD, "fn": T.FN, "rdf": T.RDF, "rdfs": T.RDFS, "e": BASE + "step#", "g": BASE + "graph/", "src": BASE + "source/", "nation": BASE + "nation/"}
SPARQL: dict[str, str] = {}
GRAPHS: dict[str, str] = {}  # over documents in named graphs
QUADS: dict[str, str] = {}  # over nation_quads
MADE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def mapped(spark: SparkSession, sf_dir: str, document_graphs: bool = False) -> Dataset:
    return Dataset(spark, tables=tuple(sample_tables(spark, sf_dir, document_graphs)))


def nation_quads(spark: SparkSession, sf_dir: str) -> Dataset:
    """Nations as quads: a cyclic ``e:next`` edge from each to (7 k + 3) mod 25, its name, and in a named graph for each
    region ``e:in``."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    node = lambda c: T.boxed(T.IRI, F.concat(F.lit(BASE + "nation/"), c.cast("string")))
    s, none = node(F.col("n_nationkey")), F.lit(None).cast("string")
    p = lambda name: T.boxed(T.IRI, F.lit(f"{BASE}step#{name}"))
    nxt = n.select(s.alias("s"), p("next").alias("p"), node(F.pmod(F.col("n_nationkey") * 7 + 3, F.lit(25))).alias("o"), none.alias("g"))
    name = n.select(s.alias("s"), p("name").alias("p"), T.boxed(T.LITERAL, F.col("n_name")).alias("o"), none.alias("g"))
    region = T.boxed(T.IRI, F.concat(F.lit(BASE + "region/"), F.col("n_regionkey").cast("string")))
    inside = n.select(s.alias("s"), p("in").alias("p"), region.alias("o"), F.concat(F.lit(BASE + "graph/"), F.col("n_regionkey").cast("string")).alias("g"))
    return Dataset(spark, nxt.union(name).union(inside))


# Scans, projection, filters

SPARQL["scan_bgp"] = "SELECT ?name ?bal WHERE { ?c :name ?name ; :acctbal ?bal ; :mktsegment ?s }"
SQL["scan_bgp"] = "SELECT c_name AS name, c_acctbal AS bal FROM customer"
SPARQL["scan_subject_iri"] = "SELECT ?c ?n WHERE { ?c :nation ?n ; :mktsegment 'BUILDING' }"
SQL["scan_subject_iri"] = f"SELECT '{BASE}customer/' || c_custkey AS c, '{BASE}nation/' || c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING'"
SPARQL["constant_subject"] = "SELECT ?n ?b WHERE { <http://example.org/customer/7> :name ?n ; :acctbal ?b }"
SQL["constant_subject"] = "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 7"
SPARQL["repeated_var"] = "SELECT ?d ?y WHERE { ?d :quality ?y ; :toxic ?y }"
SQL["repeated_var"] = f"SELECT '{BASE}doc/' || doc_id AS d, quality AS y FROM labels WHERE quality = toxic"
SPARQL["project_expr"] = "SELECT ?name (?p * 2 AS ?double) (?p + ?s AS ?sum) WHERE { ?x a :Part ; :name ?name ; :retailprice ?p ; :size ?s }"
SQL["project_expr"] = 'SELECT p_name AS name, p_retailprice * 2 AS "double", p_retailprice + p_size AS sum FROM part'
SPARQL["filter_range"] = "SELECT ?o ?p WHERE { ?o :totalprice ?p FILTER(?p > 1000 && ?p <= 20000.5) }"
SQL["filter_range"] = f"SELECT '{BASE}order/' || o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 20000.5"
SPARQL["filter_regex"] = "SELECT ?n WHERE { ?p a :Part ; :name ?n FILTER REGEX(?n, '^[a-m].*[0-4]$', 'i') }"
SQL["filter_regex"] = "SELECT p_name AS n FROM part WHERE regexp_matches(p_name, '^[a-m].*[0-4]$', 'i')"
SPARQL["filter_in"] = "SELECT ?o WHERE { ?o :orderpriority ?p ; :orderstatus ?s FILTER(?s IN ('F', 'O')) }"
SQL["filter_in"] = f"SELECT '{BASE}order/' || o_orderkey AS o FROM orders WHERE o_orderstatus IN ('F', 'O')"
SPARQL["filter_not_in"] = "SELECT ?p ?z WHERE { ?p :size ?z FILTER(?z NOT IN (1, 2, 3.0, 4e0)) }"
SQL["filter_not_in"] = f"SELECT '{BASE}part/' || p_partkey AS p, p_size AS z FROM part WHERE p_size NOT IN (1, 2, 3, 4)"
SPARQL["ebv_filter"] = "SELECT ?d WHERE { ?d :toxic ?t FILTER(?t) }"
SQL["ebv_filter"] = f"SELECT '{BASE}doc/' || doc_id AS d FROM labels WHERE toxic <> 0"
SPARQL["bind"] = "SELECT ?name ?cents WHERE { ?s a :Supplier ; :name ?name ; :acctbal ?b BIND(ROUND(?b * 100) AS ?cents) FILTER(?cents > 0) }"
SQL["bind"] = "SELECT s_name AS name, round(s_acctbal * 100) AS cents FROM supplier WHERE round(s_acctbal * 100) > 0"
SPARQL["values_table"] = "SELECT ?x ?y WHERE { VALUES (?x ?y) { ('a' 1) ('b' 2) ('c' UNDEF) } }"
SQL["values_table"] = "SELECT * FROM (VALUES ('a', 1::BIGINT), ('b', 2), ('c', NULL)) t(x, y)"
SPARQL["class_scan"] = "SELECT ?x ?n WHERE { ?x a :Region ; :name ?n }"
SQL["class_scan"] = f"SELECT '{BASE}region/' || r_regionkey AS x, r_name AS n FROM region"
SPARQL["union_of_tables"] = "SELECT ?x ?n WHERE { ?x :name ?n . ?x :acctbal ?b FILTER(?b < 0) }"
SQL["union_of_tables"] = f"SELECT '{BASE}customer/' || c_custkey AS x, c_name AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT '{BASE}supplier/' || s_suppkey, s_name FROM supplier WHERE s_acctbal < 0"

# Joins

SPARQL["star_join"] = "SELECT ?d ?lang ?q WHERE { ?d :lang ?lang ; :source ?s ; :quality ?q ; :toxic 0 }"
SQL["star_join"] = f"SELECT '{BASE}doc/' || d.doc_id AS d, lang, quality AS q FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 0"
SPARQL["revenue_by_region"] = "SELECT ?region (ROUND(SUM(?price)) AS ?revenue) WHERE { ?li :order/:customer/:nation/:region ?r ; :extendedprice ?price ; :shipdate ?d . ?r :name ?region . FILTER(YEAR(?d) = 2000) } GROUP BY ?region ORDER BY DESC(?revenue)"
SQL["revenue_by_region"] = "SELECT r_name AS region, round(sum(l_extendedprice)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE year(l_shipdate) = 2000 GROUP BY r_name"
SPARQL["fk_path_join"] = "SELECT ?c ?r WHERE { ?o :customer ?x . ?x :name ?c ; :nation/:region/:name ?r . ?o :orderpriority '1-URGENT' }"
SQL["fk_path_join"] = "SELECT c_name AS c, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderpriority = '1-URGENT'"
SPARQL["cross_join"] = "SELECT ?a ?b WHERE { ?x a :Region ; :name ?a . ?y a :Nation ; :name ?b }"
SQL["cross_join"] = "SELECT r_name AS a, n_name AS b FROM region, nation"
SPARQL["optional"] = "SELECT ?d ?q WHERE { ?d a :Document OPTIONAL { ?d :quality ?q } }"
SQL["optional"] = f"SELECT '{BASE}doc/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
SPARQL["optional_filter"] = "SELECT ?d ?q WHERE { ?d a :Document ; :chars ?c OPTIONAL { ?d :quality ?q ; :toxic ?t FILTER(?c > 1500 && ?t = 0) } }"
SQL["optional_filter"] = f"SELECT '{BASE}doc/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND n_chars > 1500 AND toxic = 0"
SPARQL["optional_chain"] = "SELECT ?n ?c ?o WHERE { ?x a :Nation ; :name ?n OPTIONAL { ?y :nation ?x ; :name ?c ; :acctbal ?b FILTER(?b > 9000) OPTIONAL { ?o :customer ?y ; :totalprice ?p FILTER(?p > 200000) } } }"
SQL["optional_chain"] = f"WITH m AS (SELECT 'customer/' || c_custkey AS k, c_custkey, c_name AS nm, c_nationkey AS nk, c_acctbal AS b FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, NULL, s_name, s_nationkey, s_acctbal FROM supplier) SELECT n_name AS n, nm AS c, CASE WHEN o_orderkey IS NOT NULL THEN '{BASE}order/' || o_orderkey END AS o FROM nation LEFT JOIN (SELECT * FROM m LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE b > 9000) t ON nk = n_nationkey"
SPARQL["minus"] = "SELECT ?d WHERE { ?d a :Document MINUS { ?d :toxic ?t } }"
SQL["minus"] = f"SELECT '{BASE}doc/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
SPARQL["minus_disjoint"] = "SELECT ?n WHERE { ?x a :Region ; :name ?n MINUS { ?y :toxic ?t } }"
SQL["minus_disjoint"] = "SELECT r_name AS n FROM region"
SPARQL["not_exists"] = "SELECT ?c WHERE { ?c a :Customer FILTER NOT EXISTS { ?o :customer ?c ; :orderstatus 'F' } }"
SQL["not_exists"] = f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"
SPARQL["exists"] = "SELECT ?c WHERE { ?c a :Customer ; :acctbal ?b FILTER EXISTS { ?o :customer ?c ; :totalprice ?p FILTER(?p > ?b * 40) } }"
SQL["exists"] = f"SELECT '{BASE}customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)"
SPARQL["exists_in_disjunction"] = "SELECT ?d WHERE { ?d a :Document ; :chars ?c FILTER(?c > 4000 || EXISTS { ?d :toxic 1 }) }"
SQL["exists_in_disjunction"] = f"SELECT '{BASE}doc/' || doc_id AS d FROM documents WHERE n_chars > 4000 OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
SPARQL["values_join"] = "SELECT ?n ?x WHERE { ?r a :Region ; :name ?n } VALUES (?n ?x) { ('ASIA' 1) ('EUROPE' 2) ('NOWHERE' 3) }"
SQL["values_join"] = "SELECT r_name AS n, x FROM region JOIN (VALUES ('ASIA', 1::BIGINT), ('EUROPE', 2), ('NOWHERE', 3)) t(n, x) ON r_name = n"
SPARQL["values_undef"] = "SELECT ?n ?x WHERE { ?r a :Region ; :name ?n } VALUES (?n ?x) { ('ASIA' 1) (UNDEF 2) }"
SQL["values_undef"] = "SELECT r_name AS n, 1::BIGINT AS x FROM region WHERE r_name = 'ASIA' UNION ALL SELECT r_name, 2 FROM region"
SPARQL["subselect_join"] = "SELECT ?name ?n WHERE { ?c :name ?name ; :mktsegment 'MACHINERY' { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :customer ?c } GROUP BY ?c } }"
SQL["subselect_join"] = "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'"
SPARQL["interval_overlap"] = "SELECT ?a ?b WHERE { ?a a :Event ; :eventType 'purchase' ; :ts ?t ; :user ?u . ?b a :Event ; :eventType 'signup' ; :ts ?s ; :user ?u FILTER(?s < ?t) }"
SQL["interval_overlap"] = f"SELECT '{BASE}event/' || a.event_id AS a, '{BASE}event/' || b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'signup' AND b.ts < a.ts"
SPARQL["join_maybe_unbound"] = "SELECT ?d ?q ?w WHERE { ?d a :Document ; :lang 'es' OPTIONAL { ?d :quality ?q } { SELECT ?q ?w WHERE { VALUES (?q ?w) { (0 'bad') (1 'good') } } } }"
SQL["join_maybe_unbound"] = f"SELECT '{BASE}doc/' || d.doc_id AS d, v.q, w FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id JOIN (VALUES (0::BIGINT, 'bad'), (1, 'good')) v(q, w) ON quality IS NULL OR quality = v.q WHERE lang = 'es'"

# Aggregates

SPARQL["count_star"] = "SELECT (COUNT(*) AS ?n) WHERE { ?l a :LineItem }"
SQL["count_star"] = "SELECT count(*) AS n FROM lineitem"
SPARQL["count_distinct"] = "SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(?c) AS ?m) WHERE { ?o :customer ?c }"
SQL["count_distinct"] = "SELECT count(DISTINCT o_custkey) AS n, count(o_custkey) AS m FROM orders"
SPARQL["sum_avg"] = "SELECT ?f (SUM(?q) AS ?total) (ROUND(AVG(?q) * 1000) AS ?mean) WHERE { ?l :returnflag ?f ; :quantity ?q } GROUP BY ?f"
SQL["sum_avg"] = "SELECT l_returnflag AS f, sum(l_quantity) AS total, round(avg(l_quantity) * 1000) AS mean FROM lineitem GROUP BY 1"
SPARQL["min_max"] = "SELECT ?s (MIN(?b) AS ?low) (MAX(?b) AS ?high) (MIN(?n) AS ?first) WHERE { ?c a :Customer ; :mktsegment ?s ; :acctbal ?b ; :name ?n } GROUP BY ?s"
SQL["min_max"] = "SELECT c_mktsegment AS s, min(c_acctbal) AS low, max(c_acctbal) AS high, min(c_name) AS first FROM customer GROUP BY 1"
SPARQL["group_by_expr"] = "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :orderdate ?d } GROUP BY (YEAR(?d) AS ?y)"
SQL["group_by_expr"] = "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"
SPARQL["having"] = "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :customer ?c } GROUP BY ?c HAVING(COUNT(?o) > 15)"
SQL["having"] = f"SELECT '{BASE}customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"
SPARQL["group_concat"] = "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=', ') AS ?names) WHERE { ?x :region/:name ?r ; :name ?n } GROUP BY ?r"
SQL["group_concat"] = "SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"
SPARQL["sample_min"] = "SELECT ?r (SAMPLE(?n) AS ?one) WHERE { ?x :region/:name ?r ; :name ?n } GROUP BY ?r"
SQL["sample_min"] = "SELECT r_name AS r, min(n_name) AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"
SPARQL["count_empty"] = "SELECT (COUNT(*) AS ?n) (SUM(?p) AS ?s) WHERE { ?o :totalprice ?p FILTER(?p < 0) }"
SQL["count_empty"] = "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS s FROM orders WHERE o_totalprice < 0"
SPARQL["implicit_group"] = "SELECT (MAX(?p) - MIN(?p) AS ?spread) WHERE { ?o :totalprice ?p }"
SQL["implicit_group"] = "SELECT max(o_totalprice) - min(o_totalprice) AS spread FROM orders"
SPARQL["distinct_aggregates"] = "SELECT (SUM(DISTINCT ?z) AS ?s) (GROUP_CONCAT(DISTINCT ?b; SEPARATOR='|') AS ?brands) WHERE { ?p :size ?z ; :brand ?b }"
SQL["distinct_aggregates"] = "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s, (SELECT string_agg(b, '|' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM part)) AS brands FROM part"
SPARQL["group_without_aggregate"] = "SELECT ?s WHERE { ?o :orderstatus ?s } GROUP BY ?s"
SQL["group_without_aggregate"] = "SELECT DISTINCT o_orderstatus AS s FROM orders"
SPARQL["group_unbound_key"] = "SELECT ?q (COUNT(*) AS ?n) WHERE { ?d a :Document OPTIONAL { ?d :quality ?q } } GROUP BY ?q"
SQL["group_unbound_key"] = "SELECT quality AS q, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"
SPARQL["sum_with_error"] = "SELECT ?s (SUM(?q) AS ?t) WHERE { ?d a :Document ; :lang ?s OPTIONAL { ?d :quality ?q } } GROUP BY ?s"
SQL["sum_with_error"] = "SELECT lang AS s, CAST(CASE WHEN count(*) = count(quality) THEN sum(quality) END AS BIGINT) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"

# Modifiers

SPARQL["order_multi"] = "SELECT ?s ?b ?n WHERE { ?c a :Customer ; :mktsegment ?s ; :acctbal ?b ; :name ?n } ORDER BY ?s DESC(?b) ?n"
SQL["order_multi"] = "SELECT c_mktsegment AS s, c_acctbal AS b, c_name AS n FROM customer ORDER BY 1, 2 DESC, 3"
SPARQL["order_unbound_first"] = "SELECT ?k ?q WHERE { ?d a :Document ; :chars ?k OPTIONAL { ?d :quality ?q } } ORDER BY ?q ?k"
SQL["order_unbound_first"] = "SELECT n_chars AS k, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality NULLS FIRST, n_chars"
SPARQL["topk"] = "SELECT ?n ?p WHERE { ?x a :Part ; :name ?n ; :retailprice ?p } ORDER BY DESC(?p) ?n LIMIT 10"
SQL["topk"] = "SELECT p_name AS n, p_retailprice AS p FROM part ORDER BY 2 DESC, 1 LIMIT 10"
SPARQL["offset_limit"] = "SELECT ?n WHERE { ?c a :Customer ; :name ?n } ORDER BY ?n OFFSET 20 LIMIT 15"
SQL["offset_limit"] = "SELECT c_name AS n FROM customer ORDER BY 1 LIMIT 15 OFFSET 20"
SPARQL["distinct"] = "SELECT DISTINCT ?b ?z WHERE { ?p :brand ?b ; :size ?z }"
SQL["distinct"] = "SELECT DISTINCT p_brand AS b, p_size AS z FROM part"
SPARQL["reduced"] = "SELECT REDUCED ?t WHERE { ?e a :Event ; :eventType ?t }"
SQL["reduced"] = "SELECT event_type AS t FROM events"

# Unions and graphs

SPARQL["union2"] = "SELECT ?n WHERE { { ?x a :Region ; :name ?n } UNION { ?x a :Nation ; :name ?n } }"
SQL["union2"] = "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation"
SPARQL["union3"] = "SELECT ?n WHERE { { ?x a :Region ; :name ?n } UNION { ?x a :Nation ; :name ?n } UNION { ?x a :Supplier ; :name ?n } }"
SQL["union3"] = "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier"
SPARQL["union_mixed_schema"] = "SELECT ?n ?b WHERE { { ?x a :Region ; :name ?n } UNION { ?x a :Supplier ; :acctbal ?b } }"
SQL["union_mixed_schema"] = "SELECT r_name AS n, CAST(NULL AS DOUBLE) AS b FROM region UNION ALL SELECT NULL, s_acctbal FROM supplier"
SPARQL["union_mixed_types"] = "SELECT ?v WHERE { { ?x a :Part ; :size ?v } UNION { ?x a :Part ; :brand ?v } }"
SQL["union_mixed_types"] = "SELECT CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT p_brand FROM part"
GRAPHS["graph_named"] = "SELECT ?d ?c WHERE { GRAPH src:src3 { ?d :chars ?c } }"
SQL["graph_named"] = f"SELECT '{BASE}doc/' || doc_id AS d, n_chars AS c FROM documents WHERE source = 'src3'"
GRAPHS["graph_var"] = "SELECT ?g (COUNT(?d) AS ?n) WHERE { GRAPH ?g { ?d :lang 'fr' } } GROUP BY ?g"
SQL["graph_var"] = f"SELECT '{BASE}source/' || source AS g, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY 1"
GRAPHS["from_dataset"] = "SELECT ?d ?c FROM src:src1 FROM src:src2 WHERE { ?d :chars ?c }"
SQL["from_dataset"] = f"SELECT '{BASE}doc/' || doc_id AS d, n_chars AS c FROM documents WHERE source IN ('src1', 'src2')"
GRAPHS["from_named"] = "SELECT ?g ?d FROM NAMED src:src1 FROM NAMED src:src4 WHERE { GRAPH ?g { ?d :lang 'de' } }"
SQL["from_named"] = f"SELECT '{BASE}source/' || source AS g, '{BASE}doc/' || doc_id AS d FROM documents WHERE source IN ('src1', 'src4') AND lang = 'de'"
GRAPHS["graph_and_default"] = "SELECT ?g ?d ?t WHERE { GRAPH ?g { ?d :chars ?c } ?d :toxic ?t FILTER(?c < 600) }"
SQL["graph_and_default"] = f"SELECT '{BASE}source/' || source AS g, '{BASE}doc/' || d.doc_id AS d, toxic AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars < 600"
QUADS["quads_graph_var"] = "SELECT ?g ?s ?o WHERE { GRAPH ?g { ?s e:in ?o } }"
SQL["quads_graph_var"] = f"SELECT '{BASE}graph/' || n_regionkey AS g, '{BASE}nation/' || n_nationkey AS s, '{BASE}region/' || n_regionkey AS o FROM nation"
QUADS["quads_any_predicate"] = "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p"
SQL["quads_any_predicate"] = f"SELECT '{BASE}step#' || p AS p, count(*) AS n FROM nation, (VALUES ('next'), ('name')) t(p) GROUP BY 1"

# Paths

NEXT = "(SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation)"
_iri = lambda c: f"'{BASE}nation/' || {c}"
SPARQL["path_seq"] = "SELECT ?c ?n WHERE { ?c a :Customer ; :nation/:region/:name ?n }"
SQL["path_seq"] = f"SELECT '{BASE}customer/' || c_custkey AS c, r_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
SPARQL["path_inv"] = "SELECT ?n ?c WHERE { ?n a :Nation ; ^:nation ?c }"
SQL["path_inv"] = f"SELECT '{BASE}nation/' || k AS n, c FROM (SELECT c_nationkey AS k, '{BASE}customer/' || c_custkey AS c FROM customer UNION ALL SELECT s_nationkey, '{BASE}supplier/' || s_suppkey FROM supplier)"
SPARQL["path_alt"] = "SELECT ?x WHERE { ?o a :Nation ; (:name|(:region/:name)) ?x }"
SQL["path_alt"] = "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
QUADS["path_opt"] = "SELECT ?a ?b WHERE { ?a e:next? ?b . ?a e:name ?n }"
SQL["path_opt"] = f"SELECT DISTINCT {_iri('a')} AS a, {_iri('b')} AS b FROM (SELECT a, b FROM {NEXT} UNION ALL SELECT a, a FROM {NEXT})"
CLOSURE = f"WITH RECURSIVE t(a, b) AS (SELECT a, b FROM {NEXT} UNION SELECT t.a, e.b FROM t JOIN {NEXT} e ON t.b = e.a)"
QUADS["path_plus"] = "SELECT ?a ?b WHERE { ?a e:next+ ?b }"
SQL["path_plus"] = f"{CLOSURE} SELECT {_iri('a')} AS a, {_iri('b')} AS b FROM t"
QUADS["path_star"] = "SELECT ?a ?b WHERE { ?a e:name ?n . ?a e:next* ?b }"
SQL["path_star"] = f"{CLOSURE} SELECT DISTINCT {_iri('a')} AS a, {_iri('b')} AS b FROM (SELECT * FROM t UNION ALL SELECT n_nationkey, n_nationkey FROM nation)"
QUADS["path_from_constant"] = "SELECT ?b WHERE { nation:0 e:next+ ?b }"
SQL["path_from_constant"] = f"{CLOSURE} SELECT {_iri('b')} AS b FROM t WHERE a = 0"
QUADS["path_to_constant"] = "SELECT ?a WHERE { ?a e:next* nation:3 }"
SQL["path_to_constant"] = f"{CLOSURE} SELECT DISTINCT {_iri('a')} AS a FROM (SELECT a FROM t WHERE b = 3 UNION ALL SELECT 3)"
QUADS["path_cycle"] = "SELECT ?a WHERE { ?a e:next+ ?a }"
SQL["path_cycle"] = f"{CLOSURE} SELECT {_iri('a')} AS a FROM t WHERE a = b"
QUADS["path_neg"] = "SELECT ?a ?b WHERE { ?a !(e:next|e:other) ?b }"
SQL["path_neg"] = f"SELECT {_iri('n_nationkey')} AS a, n_name AS b FROM nation"
QUADS["path_neg_inverse"] = "SELECT ?a ?b WHERE { ?a !(^e:name) ?b . ?b e:name ?n }"
SQL["path_neg_inverse"] = f"SELECT {_iri('b')} AS a, {_iri('a')} AS b FROM {NEXT}"
SPARQL["path_mapped_plus"] = "SELECT ?c ?x WHERE { ?c (:nation|:region)+ ?x . ?c a :Supplier }"
SQL["path_mapped_plus"] = f"SELECT '{BASE}supplier/' || s_suppkey AS c, '{BASE}nation/' || s_nationkey AS x FROM supplier UNION ALL SELECT '{BASE}supplier/' || s_suppkey, '{BASE}region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"
QUADS["path_in_graph"] = "SELECT ?g ?s WHERE { GRAPH ?g { ?s e:in+ ?o } }"
SQL["path_in_graph"] = f"SELECT '{BASE}graph/' || n_regionkey AS g, {_iri('n_nationkey')} AS s FROM nation"

# Strings

SPARQL["strlen"] = "SELECT ?d (STRLEN(?t) AS ?n) WHERE { ?d :text ?t }"
SQL["strlen"] = f"SELECT '{BASE}doc/' || doc_id AS d, length(text) AS n FROM documents"
SPARQL["substr"] = "SELECT ?d (SUBSTR(?t, 3, 7) AS ?a) (SUBSTR(?t, 0, 4) AS ?b) (SUBSTR(?l, 2) AS ?c) WHERE { ?d :text ?t ; :lang ?l }"
SQL["substr"] = f"SELECT '{BASE}doc/' || doc_id AS d, substring(text, 3, 7) AS a, substring(text, 1, 3) AS b, substring(lang, 2) AS c FROM documents"
SPARQL["ucase_lcase"] = "SELECT (UCASE(?l) AS ?u) (LCASE(?n) AS ?w) WHERE { ?c a :Customer ; :mktsegment ?l ; :name ?n }"
SQL["ucase_lcase"] = "SELECT upper(c_mktsegment) AS u, lower(c_name) AS w FROM customer"
SPARQL["strstarts_ends"] = "SELECT ?u WHERE { ?p :url ?u FILTER(STRSTARTS(?u, 'https://') && STRENDS(?u, '#top')) }"
SQL["strstarts_ends"] = "SELECT url AS u FROM pages WHERE starts_with(url, 'https://') AND ends_with(url, '#top')"
SPARQL["contains"] = "SELECT ?d WHERE { ?d :text ?t FILTER CONTAINS(?t, 'License') }"
SQL["contains"] = f"SELECT '{BASE}doc/' || doc_id AS d FROM documents WHERE contains(text, 'License')"
SPARQL["strbefore_after"] = "SELECT (STRBEFORE(?u, '://') AS ?scheme) (STRAFTER(?u, '://') AS ?rest) (STRAFTER(?u, 'nope') AS ?none) WHERE { ?p :url ?u }"
SQL["strbefore_after"] = "SELECT split_part(url, '://', 1) AS scheme, substring(url, position('://' IN url) + 3) AS rest, '' AS none FROM pages"
SPARQL["concat"] = "SELECT (CONCAT(?b, '-', STR(?z)) AS ?x) WHERE { ?p :brand ?b ; :size ?z }"
SQL["concat"] = "SELECT p_brand || '-' || p_size AS x FROM part"
SPARQL["replace"] = "SELECT (REPLACE(?u, '[0-9]+', '<$0>') AS ?x) (REPLACE(?u, 'HTTPS?', 'p', 'i') AS ?y) WHERE { ?p :url ?u }"
SQL["replace"] = "SELECT regexp_replace(url, '[0-9]+', '<\\0>', 'g') AS x, regexp_replace(url, 'HTTPS?', 'p', 'gi') AS y FROM pages"
SPARQL["encode_uri"] = "SELECT (ENCODE_FOR_URI(?t) AS ?x) WHERE { ?d :text ?t }"
SQL["encode_uri"] = "SELECT url_encode(text) AS x FROM documents"
SPARQL["md5_sha1_sha256"] = "SELECT (MD5(?t) AS ?a) (SHA1(?t) AS ?b) (SHA256(?t) AS ?c) WHERE { ?d :text ?t }"
SQL["md5_sha1_sha256"] = "SELECT md5(text) AS a, sha1(text) AS b, sha256(text) AS c FROM documents"
SPARQL["sha224_384_512"] = "SELECT ?n (SHA224(?n) AS ?a) (SHA384(?n) AS ?b) (SHA512(?n) AS ?c) WHERE { ?r a :Region ; :name ?n }"
SPARQL["lang_matches"] = "SELECT ?d (LANG(?t) AS ?l) WHERE { ?d :textLang ?t FILTER(LANGMATCHES(LANG(?t), 'FR') || LANGMATCHES(LANG(?t), 'es')) }"
SQL["lang_matches"] = f"SELECT '{BASE}doc/' || doc_id AS d, lang AS l FROM documents WHERE lang IN ('fr', 'es')"
SPARQL["strlang_strdt"] = "SELECT (LANG(STRLANG(?n, 'en')) AS ?l) (STR(DATATYPE(STRDT(?n, xsd:token))) AS ?t) WHERE { ?r a :Region ; :name ?n }"
SQL["strlang_strdt"] = f"SELECT 'en' AS l, '{T.XSD}token' AS t FROM region"
SPARQL["xpath_strings"] = "SELECT (fn:upper-case(?n) AS ?u) (fn:string-length(?n) AS ?k) (fn:compare(?n, 'B') AS ?c) (fn:contains(?n, 'A') AS ?h) (fn:substring(?n, 2, 3) AS ?s) WHERE { ?r a :Nation ; :name ?n FILTER fn:matches(?n, 'A') }"
SQL["xpath_strings"] = "SELECT upper(n_name) AS u, length(n_name) AS k, CAST(CASE WHEN n_name < 'B' THEN -1 WHEN n_name = 'B' THEN 0 ELSE 1 END AS BIGINT) AS c, contains(n_name, 'A') AS h, substring(n_name, 2, 3) AS s FROM nation WHERE contains(n_name, 'A')"

# Numbers and dates

SPARQL["abs_ceil_floor_round"] = "SELECT ?b (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?s a :Supplier ; :acctbal ?b }"
SQL["abs_ceil_floor_round"] = "SELECT s_acctbal AS b, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(s_acctbal) AS r FROM supplier"
SPARQL["round_half_even"] = "SELECT ?z (xsd:double(fn:round-half-to-even(?z / 2)) AS ?r) WHERE { ?p :size ?z }"
SQL["round_half_even"] = "SELECT p_size AS z, round_even(p_size / 2, 0) AS r FROM part"
SPARQL["arithmetic_promote"] = "SELECT (?z + 1 AS ?a) (xsd:double(?z * 1.5) AS ?b) (?z - 2e0 AS ?c) (-?z AS ?d) (STR(DATATYPE(?z * 1.5)) AS ?t) WHERE { ?p :size ?z }"
SQL["arithmetic_promote"] = f"SELECT CAST(p_size + 1 AS BIGINT) AS a, CAST(p_size * 1.5 AS DOUBLE) AS b, CAST(p_size - 2 AS DOUBLE) AS c, CAST(-p_size AS BIGINT) AS d, '{T.XSD}decimal' AS t FROM part"
SPARQL["divide_by_zero_unbound"] = "SELECT ?z (xsd:double(10 / (?z - 5)) AS ?x) WHERE { ?p :size ?z }"
SQL["divide_by_zero_unbound"] = "SELECT p_size AS z, CASE WHEN p_size <> 5 THEN 10 / (p_size - 5) END AS x FROM part"
SPARQL["year_month_day"] = "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) WHERE { ?o :orderdate ?d }"
SQL["year_month_day"] = f"SELECT '{BASE}order/' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS k FROM orders"
SPARQL["hours_minutes_seconds"] = "SELECT ?e (HOURS(?t) AS ?h) (MINUTES(?t) AS ?m) (xsd:double(FLOOR(SECONDS(?t))) AS ?s) (TZ(?t) AS ?z) WHERE { ?e :ts ?t }"
SQL["hours_minutes_seconds"] = f"SELECT '{BASE}event/' || event_id AS e, hour(ts) AS h, minute(ts) AS m, CAST(floor(second(ts)) AS DOUBLE) AS s, '' AS z FROM events"
SPARQL["datetime_compare"] = "SELECT ?o WHERE { ?o :orderdate ?d FILTER(?d >= '1996-03-01T00:00:00'^^xsd:dateTime && ?d < '1999-01-01T00:00:00Z'^^xsd:dateTime) }"
SQL["datetime_compare"] = f"SELECT '{BASE}order/' || o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1999-01-01'"
SPARQL["zoned_datetimes"] = "SELECT (HOURS(?d) AS ?h) (TZ(?d) AS ?z) (STR(TIMEZONE(?d)) AS ?o) WHERE { VALUES ?d { '2011-01-10T14:45:13.815-05:00'^^xsd:dateTime '2011-01-10T14:45:13Z'^^xsd:dateTime '2011-01-10T14:45:13'^^xsd:dateTime } }"
SQL["zoned_datetimes"] = "SELECT 14::BIGINT AS h, z, o FROM (VALUES ('-05:00', '-PT5H'), ('Z', 'PT0S'), ('', NULL)) t(z, o)"
SPARQL["now_rand_uuid"] = "SELECT ?n (RAND() < 1 AS ?a) (YEAR(NOW()) > 2000 AS ?b) (STRLEN(STRUUID()) AS ?c) (STRSTARTS(STR(UUID()), 'urn:uuid:') AS ?d) WHERE { ?r a :Region ; :name ?n }"
SQL["now_rand_uuid"] = "SELECT r_name AS n, true AS a, true AS b, 36::BIGINT AS c, true AS d FROM region"

# Terms

SPARQL["casts_integer_double_boolean"] = "SELECT ?b (xsd:integer(?b) AS ?i) (xsd:string(?z) AS ?s) (xsd:boolean(?z - 1) AS ?t) (xsd:integer('x') AS ?n) (xsd:double('1.5') AS ?d) WHERE { ?p :retailprice ?b ; :size ?z }"
SQL["casts_integer_double_boolean"] = "SELECT p_retailprice AS b, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS s, p_size <> 1 AS t, CAST(NULL AS BIGINT) AS n, CAST(1.5 AS DOUBLE) AS d FROM part"
SPARQL["datatype_fn"] = "SELECT DISTINCT (STR(DATATYPE(?v)) AS ?t) WHERE { { ?x a :Part ; :size ?v } UNION { ?x a :Part ; :brand ?v } UNION { ?x a :Part ; :retailprice ?v } UNION { ?d :textLang ?v } }"
SQL["datatype_fn"] = f"SELECT * FROM (VALUES ('{T.XSD}integer'), ('{T.XSD}string'), ('{T.XSD}double'), ('{T.RDF}langString')) t(t)"
SPARQL["is_iri_literal"] = "SELECT ?n (isIRI(?r) AS ?a) (isLiteral(?n) AS ?b) (isBlank(?r) AS ?c) (isNumeric(?n) AS ?d) WHERE { ?x :region ?r ; :name ?n }"
SQL["is_iri_literal"] = "SELECT n_name AS n, true AS a, true AS b, false AS c, false AS d FROM nation"
SPARQL["coalesce_if"] = "SELECT ?d (COALESCE(?q, -1) AS ?a) (IF(?c > 2000, 'long', 'short') AS ?b) (BOUND(?q) AS ?e) WHERE { ?d a :Document ; :chars ?c OPTIONAL { ?d :quality ?q } }"
SQL["coalesce_if"] = f"SELECT '{BASE}doc/' || d.doc_id AS d, CAST(coalesce(quality, -1) AS BIGINT) AS a, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS b, quality IS NOT NULL AS e FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
SPARQL["sameterm_vs_equal"] = "SELECT ?z (?z = 7.0 AS ?a) (sameTerm(?z, 7.0) AS ?b) (sameTerm(?z, 7) AS ?c) WHERE { ?p :size ?z }"
SQL["sameterm_vs_equal"] = "SELECT p_size AS z, p_size = 7 AS a, false AS b, p_size = 7 AS c FROM part"
SPARQL["three_valued_logic"] = "SELECT ?d (?q > 0 || true AS ?a) (?q > 0 && false AS ?b) (!(?q > 0) AS ?c) WHERE { ?d a :Document OPTIONAL { ?d :quality ?q } }"
SQL["three_valued_logic"] = f"SELECT '{BASE}doc/' || d.doc_id AS d, true AS a, false AS b, NOT (quality > 0) AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
SPARQL["iri_function"] = "SELECT ?n WHERE { ?r :name ?n FILTER(?r = IRI(CONCAT('http://example.org/region/', '2'))) }"
SQL["iri_function"] = "SELECT r_name AS n FROM region WHERE r_regionkey = 2"

# Query forms

SPARQL["ask_true"] = "ASK { ?r a :Region ; :name 'ASIA' }"
SQL["ask_true"] = "SELECT count(*) > 0 AS result FROM region WHERE r_name = 'ASIA'"
SPARQL["ask_false"] = "ASK { ?r a :Region ; :name 'ATLANTIS' }"
SQL["ask_false"] = "SELECT count(*) > 0 AS result FROM region WHERE r_name = 'ATLANTIS'"


def _text(df: DataFrame) -> DataFrame:
    """Triples as three texts, blank labels left out."""
    return df.select(*[F.when(F.col(f"{c}.kind") == T.BLANK, "_").otherwise(F.col(f"{c}.lex")).alias(c) for c in ("s", "p", "o")])


def _made(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        MADE[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


@_made("construct", f"SELECT '{BASE}nation/' || n_nationkey AS s, '{NS}partOf' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def construct(spark, sf_dir):
    return _text(query("CONSTRUCT { ?n :partOf ?r } WHERE { ?n :region/:name ?r }", mapped(spark, sf_dir), prefixes=PREFIXES))


@_made("construct_blank", f"SELECT '{BASE}nation/' || n_nationkey AS s, '{NS}has' AS p, '_' AS o FROM nation UNION ALL SELECT '_', '{NS}label', n_name FROM nation")
def construct_blank(spark, sf_dir):
    return _text(query("CONSTRUCT { ?n :has [ :label ?x ] } WHERE { ?n a :Nation ; :name ?x }", mapped(spark, sf_dir), prefixes=PREFIXES))


@_made("describe", f"SELECT '{BASE}nation/' || a AS s, '{BASE}step#next' AS p, '{BASE}nation/' || b AS o FROM {NEXT} WHERE a = 4 OR b = 4 UNION ALL SELECT '{BASE}nation/4', '{BASE}step#name', n_name FROM nation WHERE n_nationkey = 4")
def describe(spark, sf_dir):
    return _text(query("DESCRIBE nation:4", nation_quads(spark, sf_dir), prefixes=PREFIXES))


@_made("custom_function", "SELECT n_name AS n, upper(n_name) || '!' AS x FROM nation")
def custom_function(spark, sf_dir):
    shout = lambda v: T.Value(F.concat(OPERATORS["ucase"](v).col, F.lit("!")), "string")
    return query("SELECT ?n (<urn:shout>(?n) AS ?x) WHERE { ?r a :Nation ; :name ?n }", replace(mapped(spark, sf_dir), functions={"urn:shout": shout}), prefixes=PREFIXES)


@_made("computed_predicate", f"SELECT '{BASE}nation/' || n_nationkey AS n, length(n_name) AS k FROM nation")
def computed_predicate(spark, sf_dir):
    """Statements made by a function of the dataset, for a predicate that no graph holds."""

    def lengths(dataset):
        rows = query("SELECT ?s (STRLEN(?n) AS ?o) WHERE { ?s e:name ?n }", dataset, terms=True, prefixes=PREFIXES)
        return rows.select("s", "o")

    dataset = replace(nation_quads(spark, sf_dir), computed={"urn:length": lengths})
    return query("SELECT ?n (xsd:integer(?l) AS ?k) WHERE { ?n <urn:length> ?l }", dataset, prefixes=PREFIXES)


@_made("service", "SELECT c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900")
def service(spark, sf_dir):
    dataset = mapped(spark, sf_dir)
    return query("SELECT ?c ?n WHERE { ?x a :Customer ; :name ?c ; :acctbal ?b ; :nation ?y FILTER(?b > 9900) SERVICE <urn:names> { ?y e:name ?n } }", replace(dataset, services={"urn:names": nation_quads(spark, sf_dir)}), prefixes=PREFIXES)


@_made("geo_distance", "SELECT n_name AS n, CAST(round(6372.795 * radians(n_nationkey)) AS DOUBLE) AS km FROM nation")
def geo_distance(spark, sf_dir):
    return query("SELECT ?n (ROUND(<java:com.ldodds.sparql.Distance>(0, 0, ?k, 0)) AS ?km) WHERE { ?x a :Nation ; :name ?n BIND(xsd:integer(STRAFTER(STR(?x), 'nation/')) AS ?k) }", mapped(spark, sf_dir), prefixes=PREFIXES)


@_made("lang_preference", f"SELECT '{BASE}nation/' || n_nationkey AS s, n_name AS o FROM nation")
def lang_preference(spark, sf_dir):
    """Each nation has its name in English and, backwards, in German; English is preferred."""
    text = "INSERT { ?s e:label ?a ; e:label ?b } WHERE { ?s e:name ?n BIND(STRLANG(?n, 'en') AS ?a) BIND(STRLANG(CONCAT(?n, '*'), 'de') AS ?b) }"
    dataset = update(text, nation_quads(spark, sf_dir), prefixes=PREFIXES).preferring({"en": 1.0, "de": 0.5})
    return query("SELECT ?s (STR(?l) AS ?o) WHERE { ?s e:label ?l }", dataset, prefixes=PREFIXES)


def _updated(name: str, text: str, ask: str, sql: str) -> None:
    MADE[name] = lambda spark, sf_dir: query(ask, update(text, nation_quads(spark, sf_dir), prefixes=PREFIXES), prefixes=PREFIXES)
    SQL[name] = sql


ALL_NAMES = "SELECT ?s ?n WHERE { ?s e:name ?n }"
_updated("insert_data", "INSERT DATA { nation:99 e:name 'NOWHERE' . nation:0 e:name 'ALGERIA' }", ALL_NAMES, f"SELECT DISTINCT * FROM (SELECT {_iri('n_nationkey')} AS s, n_name AS n FROM nation UNION ALL SELECT '{BASE}nation/99', 'NOWHERE' UNION ALL SELECT '{BASE}nation/0', 'ALGERIA')")
_updated("delete_data", "DELETE DATA { nation:3 e:next nation:24 . nation:1 e:next nation:1 }", "SELECT ?a ?b WHERE { ?a e:next ?b }", f"SELECT {_iri('a')} AS a, {_iri('b')} AS b FROM {NEXT} WHERE NOT (a = 3 AND b = 24) AND NOT (a = 1 AND b = 1)")
_updated("insert_where", "INSERT { ?b e:previous ?a } WHERE { ?a e:next ?b }", "SELECT ?b ?a WHERE { ?b e:previous ?a }", f"SELECT {_iri('b')} AS b, {_iri('a')} AS a FROM {NEXT}")
_updated("delete_where", "DELETE WHERE { ?a e:next ?b . ?a e:name ?n }", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", "SELECT 0::BIGINT AS n")
_updated("modify", "DELETE { ?s e:name ?n } INSERT { ?s e:name ?m } WHERE { ?s e:name ?n FILTER(STRLEN(?n) > 6) BIND(SUBSTR(?n, 1, 6) AS ?m) }", ALL_NAMES, f"SELECT {_iri('n_nationkey')} AS s, substring(n_name, 1, 6) AS n FROM nation")
_updated("modify_with_graph", "WITH g:1 DELETE { ?s e:in ?r } INSERT { ?s e:was ?r } WHERE { ?s e:in ?r }", "SELECT ?g ?p (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g ?p", f"SELECT '{BASE}graph/' || n_regionkey AS g, '{BASE}step#' || CASE WHEN n_regionkey = 1 THEN 'was' ELSE 'in' END AS p, count(*) AS n FROM nation GROUP BY 1, 2")
GRAPH_COUNTS = "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g"
_updated("copy_graph", "COPY g:0 TO g:4", GRAPH_COUNTS, f"SELECT '{BASE}graph/' || n_regionkey AS g, CASE WHEN n_regionkey = 4 THEN (SELECT count(*) FROM nation WHERE n_regionkey = 0) ELSE count(*) END AS n FROM nation GROUP BY n_regionkey")
_updated("move_graph", "MOVE g:0 TO g:9", GRAPH_COUNTS, f"SELECT '{BASE}graph/' || CASE WHEN n_regionkey = 0 THEN 9 ELSE n_regionkey END AS g, count(*) AS n FROM nation GROUP BY 1")
_updated("add_graph", "ADD g:0 TO g:1", GRAPH_COUNTS, f"SELECT '{BASE}graph/' || g AS g, count(*) AS n FROM (SELECT n_regionkey AS g FROM nation UNION ALL SELECT 1 FROM nation WHERE n_regionkey = 0) GROUP BY 1")
_updated("clear_graph", "CLEAR GRAPH g:2 ; CLEAR DEFAULT", "SELECT ?g ?s WHERE { { GRAPH ?g { ?s ?p ?o } } UNION { ?s ?p ?o } }", f"SELECT '{BASE}graph/' || n_regionkey AS g, {_iri('n_nationkey')} AS s FROM nation WHERE n_regionkey <> 2")


# Formats, rules, lists

TEXT_QUADS = f"SELECT {_iri('n_nationkey')} AS s, '{BASE}step#name' AS p, n_name AS o, NULL AS g FROM nation UNION ALL SELECT {_iri('a')}, '{BASE}step#next', {_iri('b')}, NULL FROM {NEXT} UNION ALL SELECT {_iri('n_nationkey')}, '{BASE}step#in', '{BASE}region/' || n_regionkey, '{BASE}graph/' || n_regionkey FROM nation"


def _quads_as_text(df: DataFrame) -> DataFrame:
    return df.select("s.lex", "p.lex", "o.lex", "g").toDF("s", "p", "o", "g")


@_made("nquads_roundtrip", TEXT_QUADS)
def nquads_roundtrip(spark, sf_dir):
    return _quads_as_text(ntriples.parse_lines(ntriples.lines(nation_quads(spark, sf_dir).all_quads())))


@_made("ntriples_roundtrip", f"SELECT '{BASE}doc/' || doc_id AS d, text AS t, lang AS l FROM documents")
def ntriples_roundtrip(spark, sf_dir):
    """Every document's text as a literal with its language, written as N-Triples lines and read again."""
    rows = query("SELECT ?s ?o WHERE { ?s :textLang ?o }", mapped(spark, sf_dir), terms=True, prefixes=PREFIXES)
    quads = rows.select("s", T.boxed(T.IRI, F.lit(NS + "text")).alias("p"), "o")
    read = ntriples.parse_lines(ntriples.lines(quads, graphs=False))
    return read.select(F.col("s.lex").alias("d"), F.col("o.lex").alias("t"), F.col("o.lang").alias("l"))


@_made("canonical_ntriples", f"SELECT '<{BASE}nation/' || n_nationkey || '> <{BASE}step#name> \"' || n_name || '\" .' AS line FROM nation")
def canonical_ntriples(spark, sf_dir):
    quads = nation_quads(spark, sf_dir).filtered("p.lex like '%name'").all_quads()
    return ntriples.canonical(quads.select("s", "p", "o")).withColumnRenamed("value", "line")


@_made("rdf_patch_apply", f"SELECT s, n FROM (SELECT {_iri('n_nationkey')} AS s, n_name AS n FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT '{BASE}nation/50', 'NEW')")
def rdf_patch_apply(spark, sf_dir):
    dataset = nation_quads(spark, sf_dir)
    text = f"@prefix n: <{BASE}nation/> . @prefix e: <{BASE}step#> . A n:50 e:name 'NEW' . A n:2 e:name 'X' . D n:2 e:name 'X' ."
    gone = dataset.all_quads().where(f"s.lex = '{BASE}nation/2' and p.lex like '%name'").select(F.lit(9).cast("long").alias("seq"), F.lit("D").alias("op"), "*")
    changed = patch.apply(dataset.all_quads(), patch.parse_text(spark, text).union(gone))
    return query(ALL_NAMES, dataset.with_quads(changed), prefixes=PREFIXES)


@_made("rdfs_fixpoint", f"SELECT {_iri('n_nationkey')} AS s, c FROM nation, (VALUES ('{NS}Place'), ('{NS}Region'), ('{NS}Thing')) t(c) WHERE c <> '{NS}Region' UNION ALL SELECT '{BASE}region/' || r_regionkey, c FROM region, (VALUES ('{NS}Region'), ('{NS}Place'), ('{NS}Thing')) t(c)")
def rdfs_fixpoint(spark, sf_dir):
    """What is in something is a place, what it is in a region; regions are places, and places are things."""
    schema = "PREFIX : <http://example.org/ns#> INSERT DATA { e:inside rdfs:domain :Place ; rdfs:range :Region . :Region rdfs:subClassOf :Place . :Place rdfs:subClassOf :Thing } ; INSERT { ?n e:inside ?r } WHERE { GRAPH ?g { ?n e:in ?r } }"
    done = rules.rdfs(update(schema, nation_quads(spark, sf_dir), prefixes=PREFIXES), graph="urn:inferred")
    return query("SELECT ?s ?c WHERE { GRAPH <urn:inferred> { ?s rdf:type ?c } FILTER(STRSTARTS(STR(?c), STR(:)) && STRSTARTS(STR(?s), 'http://example.org/')) FILTER(!STRSTARTS(STR(?s), STR(:))) }".replace("STR(:)", f"'{NS}'"), done, prefixes=PREFIXES)


@_made("list_member", "SELECT * FROM (VALUES (0::BIGINT, 'a'), (1, 'b'), (2, 'c')) t(pos, member)")
def list_member(spark, sf_dir):
    dataset = update("INSERT DATA { e:l e:items ('a' 'b' 'c') }", Dataset(spark), prefixes=PREFIXES)
    return rules.list_members(dataset).select("pos", F.col("member.lex").alias("member"))


@_made("list_path", "SELECT * FROM (VALUES ('a'), ('b'), ('c')) t(m)")
def list_path(spark, sf_dir):
    dataset = update("INSERT DATA { e:l e:items ('a' 'b' 'c') }", Dataset(spark), prefixes=PREFIXES)
    return query("SELECT ?m WHERE { e:l e:items/rdf:rest*/rdf:first ?m }", dataset, prefixes=PREFIXES)


@_made("load_document", f"SELECT '{BASE}graph/loaded' AS g, count(*) AS n FROM nation")
def load_document(spark, sf_dir):
    dataset = replace(Dataset(spark), documents={"urn:doc": nation_quads(spark, sf_dir).filtered("p.lex like '%name'")})
    return query(GRAPH_COUNTS, update("LOAD <urn:doc> INTO GRAPH g:loaded", dataset, prefixes=PREFIXES), prefixes=PREFIXES)


@_made("from_document", "SELECT n_name AS n FROM nation")
def from_document(spark, sf_dir):
    dataset = replace(Dataset(spark), documents={"urn:doc": nation_quads(spark, sf_dir)})
    return query("SELECT ?n FROM <urn:doc> WHERE { ?s e:name ?n }", dataset, prefixes=PREFIXES)


@_made("service_var", "SELECT 'urn:names' AS e, n_name AS n FROM nation")
def service_var(spark, sf_dir):
    dataset = replace(Dataset(spark), services={"urn:names": nation_quads(spark, sf_dir)})
    return query("SELECT ?e ?n WHERE { SERVICE ?e { ?s e:name ?n } }", dataset, prefixes=PREFIXES)


@_made("union_model", "SELECT count(*) AS n FROM nation")
def union_model(spark, sf_dir):
    one = nation_quads(spark, sf_dir)
    return query("SELECT (COUNT(*) AS ?n) WHERE { ?s e:name ?o }", one.union(nation_quads(spark, sf_dir)), prefixes=PREFIXES)


@_made("path_repeat", f"SELECT {_iri('e.a')} AS a, {_iri('f.b')} AS b FROM {NEXT} e JOIN {NEXT} f ON e.b = f.a")
def path_repeat(spark, sf_dir):
    """{2}, which only programs can write."""
    from quadlight.engine import native
    from quadlight.plans import algebra as A
    from quadlight.plans import compiler as C

    step = ("repeat", ("iri", f"{BASE}step#next"), 2, 2)
    return native(C.pattern(A.PathPattern(T.Var("a"), step, T.Var("b")), C.Context(nation_quads(spark, sf_dir))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    run = lambda text, data: lambda spark, sf_dir: query(text, data(spark, sf_dir), prefixes=PREFIXES)
    out = {k: run(v, mapped) for k, v in SPARQL.items()}
    out |= {k: run(v, lambda spark, sf_dir: mapped(spark, sf_dir, True)) for k, v in GRAPHS.items()}
    out |= {k: run(v, nation_quads) for k, v in QUADS.items()}
    from quadlight import more_queries as more

    return out | MADE | more.queries()


def oracle_sql() -> dict[str, str]:
    from quadlight import more_queries as more

    return SQL | more.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(SPARQL["revenue_by_region"], mapped(spark, sf_dir), prefixes=PREFIXES)
