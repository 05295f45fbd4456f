"""The programming interface: explain, shorthand, plug-ins, the command line, and errors that users meet."""

import io
import types

import pytest

from quadlight import __main__ as cli
from quadlight import engine
from quadlight.engine import query, update
from quadlight.functions import plugins
from quadlight.functions.expressions import REGISTRY
from quadlight.operators import rules
from quadlight.plans import shorthand as S
from quadlight.plans import sse
from quadlight.plans.parser import parse_query
from quadlight.sources import stores
from quadlight.sources.dataset import Dataset
from quadlight.streaming import patch
from quadlight.terms import Iri, Literal, Var

P = {"": "urn:", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}


@pytest.fixture(scope="module")
def data(spark):
    text = "INSERT DATA { :a :v 1 . :a :w 1 . :b :v 2 . :b :w 5 . :c :v 3 . :d :v 4 . :d :u 4 . :a :k :b . :b :k :c }"
    return update(text, Dataset(spark), prefixes=P)


def rows(df):
    return sorted(tuple(None if v is None else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize(
    ("inner", "expected"),
    [
        ("{ ?t :w ?y FILTER(?y = ?x) } UNION { ?t :u ?y FILTER(?y = ?x) }", "ad"),
        ("?s :v ?z OPTIONAL { ?t :w ?y FILTER(?y = ?x) } FILTER(BOUND(?y))", "a"),
        ("?s :v ?z OPTIONAL { ?t :w ?y FILTER(?y = ?x) } FILTER(!BOUND(?y))", "bcd"),
        ("?s :k ?t FILTER EXISTS { ?t :v ?y FILTER(?y = ?x + 1) }", "ab"),
        ("?s :k ?t FILTER NOT EXISTS { ?t :w ?y FILTER(?y > ?x) }", "b"),
        ("?t :v ?z MINUS { ?t :w ?y FILTER(?y = ?x) } FILTER(?z = 1)", "bcd"),
        ("?t :w ?y { BIND(?x AS ?q) FILTER(?q > 3) }", "d"),
        ("{ SELECT ?s WHERE { ?s :w ?y } }", "ab"),
    ],
)
def test_exists_sees_the_row_at_any_depth(data, inner, expected):
    for text, want in ((f"FILTER EXISTS {{ {inner} }}", expected), (f"FILTER NOT EXISTS {{ {inner} }}", "".join(x for x in "abcd" if x not in expected)), (f"FILTER(?x > 9 || EXISTS {{ {inner} }})", expected)):
        assert rows(query(f"SELECT ?s WHERE {{ ?s :v ?x {text} }}", data, prefixes=P)) == [(f"urn:{x}",) for x in want]


def test_exists_with_an_unbound_variable_of_the_row(data):
    text = "SELECT ?s WHERE { ?s :v ?x OPTIONAL { ?s :w ?w } FILTER EXISTS { ?t :v 1 { ?t :v ?z FILTER(%s) } } }"
    assert rows(query(text % "!BOUND(?w)", data, prefixes=P)) == [("urn:c",), ("urn:d",)]
    assert rows(query(text % "?w > 1", data, prefixes=P)) == [("urn:b",)]


def test_exact_numbers(spark):
    text = "SELECT (STR(?x + ?y) AS ?a) (STR(?x * ?y) AS ?b) (STR(?x / ?y) AS ?c) (STR(-?x) AS ?d) (STR(ROUND(?x)) AS ?e) WHERE { VALUES (?x ?y) { (0.1 0.2) (0.0001 0.0001) (2 4) ('1.10'^^xsd:decimal 1) (1e0 0.5) } }"
    found = rows(query(text, Dataset(spark), prefixes={"xsd": "http://www.w3.org/2001/XMLSchema#"}))
    assert ("0.3", "0.02", "0.5", "-0.1", "0") in found and ("0.0002", "0.00000001", "1", "-0.0001", "0") in found
    assert ("6", "8", "0.5", "-2", "2") in found and ("2.1", "1.1", "1.1", "-1.1", "1") in found and ("1.5", "0.5", "2.0", "-1.0", "1.0") in found
    empty = query("SELECT (STR(AVG(?x)) AS ?a) (STR(SUM(?x)) AS ?s) WHERE { VALUES ?x { 1 2.5 } FILTER(false) }", Dataset(spark))
    assert rows(empty) == [("0", "0")]
    mixed = query("SELECT (STR(SUM(?x)) AS ?s) WHERE { VALUES ?x { 1 2.5 'x' } }", Dataset(spark))
    assert rows(mixed) == [(None,)]


def test_explain_and_shorthand(data):
    text = "SELECT ?s (COUNT(?y) AS ?n) WHERE { ?s :v ?x OPTIONAL { ?s :w ?y FILTER(?y > ?x) } MINUS { ?s :u ?z } } GROUP BY ?s HAVING(COUNT(?y) > 0) LIMIT 3"
    algebra = sse.text(parse_query(text, prefixes=P))
    assert algebra.count("(") == algebra.count(")") and all(x in algebra for x in ("(slice 0 3", "(group (?s)", "(minus", "(leftjoin", "(bgp (triple ?s <urn:v> ?x))"))
    assert "Physical Plan" in engine.explain(text, data, prefixes=P)
    q = S.project("s", ("n", S.aggregate("count", "?x")), group=[(Var("s"), None)])(S.where(S.triple("?s", "urn:v", "?x"), S.ge("?x", 2)))
    assert rows(engine.native(engine.solve(q, data))) == [("urn:b", "1"), ("urn:c", "1"), ("urn:d", "1")]
    both = S.union(S.triple("?s", "urn:u", "?x"), S.where(S.table(["s"], [["urn:z"]])))
    assert rows(engine.native(engine.solve(S.project("s")(both), data))) == [("urn:d",), ("urn:z",)]


def test_function_sets(tmp_path, monkeypatch):
    package = tmp_path / "own_functions"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "plain.py").write_text("x = 1")
    (package / "shout.py").write_text("def install(register):\n    register('urn:shout2', lambda v: v)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert plugins.discover("own_functions") == ["own_functions.shout"]
    assert "urn:shout2" in REGISTRY
    with pytest.raises(TypeError):
        plugins.install(types.ModuleType("empty"))
    assert plugins.discover("quadlight.functions") == []
    assert isinstance(plugins.announced(), list)


def test_unknown_join(data):
    with pytest.raises(ValueError, match="no join strategy"):
        query("ASK { ?s ?p ?o }", data, join="magic")


def test_lists(spark):
    dataset = update("INSERT DATA { :l :items (1 2 3) . :c rdf:rest :d . :d rdf:rest :c }", Dataset(spark), prefixes=P)
    with pytest.raises(ValueError, match="circle"):
        rules.list_members(dataset)
    items = " ".join(f"'{i}'" for i in range(70))
    long = update(f"INSERT DATA {{ :l :items ({items}) }}", Dataset(spark), prefixes=P)
    assert [r["member"]["lex"] for r in rules.list_members(long).orderBy("pos").collect()] == [str(i) for i in range(70)]


def test_closures_are_seeded_by_what_is_beside_them(data, monkeypatch):
    from quadlight.operators import paths

    seeds = []
    monkeypatch.setattr(paths, "staged", lambda df, name, real=paths.staged: seeds.append(name) or real(df, name))
    assert rows(query("SELECT ?s ?t WHERE { ?s :w 1 . ?s :k+ ?t }", data, prefixes=P)) == [("urn:a", "urn:b"), ("urn:a", "urn:c")]
    assert "seeds" in seeds
    assert rows(query("SELECT ?s ?t WHERE { ?s :k* ?t . ?t :v 3 }", data, prefixes=P)) == [("urn:a", "urn:c"), ("urn:b", "urn:c"), ("urn:c", "urn:c")]


def test_snapshots_read_one_bucket(spark, data, tmp_path):
    path = str(tmp_path / "snapshot")
    stores.save(data.all_quads(), path, buckets=8)
    dataset = stores.open_dataset(spark, {"snapshot": path})
    assert rows(query("SELECT ?s ?x WHERE { ?s :w ?x }", dataset, prefixes=P)) == [("urn:a", "1"), ("urn:b", "5")]
    plan = stores.load(spark, path, "urn:w")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert query("SELECT ?p WHERE { ?s ?p ?o }", dataset).count() == 9


def test_pattern_as_sql():
    sql = stores.bgp_sql([(Var("x"), Iri("urn:o'p"), Literal("a", "EN")), (Var("x"), Iri("urn:q"), Var("_:b"))], "1")
    assert "'urn:o''p'" in sql and "'en'" in sql and '"Statements1" t1' in sql and " AS \"x\"" in sql and "_:b" not in sql
    import duckdb

    c = duckdb.connect()
    for t, columns in (("Statements1", "Subject INT, Predicate INT, Object INT, Context INT"), ("Resources", "ID INT, URI TEXT"), ("Literals", "ID INT, Value TEXT, Language TEXT, Datatype TEXT"), ("Bnodes", "ID INT, Name TEXT")):
        c.execute(f"create table {t}({columns})")
    c.execute("insert into Resources values (1, 'urn:s'), (2, 'urn:o''p'), (3, 'urn:q')")
    c.execute("insert into Literals values (4, 'a', 'en', ''), (5, 'a', '', '')")
    c.execute("insert into Statements1 values (1, 2, 4, 0), (1, 3, 9, 0), (9, 2, 5, 0)")
    assert c.execute(sql).fetchall() == [("urn:s",)]


def test_patch_queries_need_their_place(spark):
    with pytest.raises(ValueError, match="U may only"):
        patch.parse_text(spark, "A <urn:a> <urn:b> U .")


def test_command_line(spark, tmp_path):
    file = tmp_path / "x.ttl"
    file.write_text('<urn:a> <urn:p> "x", 2 .')

    def run(*argv):
        out = io.StringIO()
        cli.main([*argv, str(file)], spark, out)
        return out.getvalue()

    assert "| 2 " in run("-p", "u=urn:", "-e", "SELECT ?o WHERE { ?s u:p ?o }")
    assert run("-o", "tsv", "-e", "SELECT ?s WHERE { ?s <urn:p> 2 }") == "?s\n<urn:a>\n"
    assert '"boolean": true' in run("-e", "ASK { ?s ?p 2 }")
    assert run("-e", "CONSTRUCT { ?s <urn:q> 1 } WHERE { ?s ?p 2 }").startswith("<urn:a> <urn:q> ")
    assert "Physical Plan" in run("-x", "-e", "ASK { ?s ?p 2 }")
    assert len(run("-u", "INSERT DATA { <urn:b> <urn:p> 3 }").splitlines()) == 3
