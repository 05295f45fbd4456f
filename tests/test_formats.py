import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadlight import terms as T
from quadlight.engine import query
from quadlight.sources import documents, ntriples, serializers
from quadlight.sources.dataset import QUAD, Dataset
from quadlight.streaming import patch

TTL = '@prefix : <http://x/> . :a :b 1 , "x"@en , "q\\"\\n\\\\" , 2.5 , true ; a :C . :a :c [ :d :e ] . :f :g "t"^^:ty .'


@pytest.fixture(scope="module")
def quads(spark):
    return documents.frame(spark, documents.turtle(TTL))


def same(a, b):
    key = lambda df: sorted(r[0] for r in ntriples.canonical(df).collect())
    return key(a) == key(b)


def test_round_trips(spark, quads, tmp_path):
    ntriples.write(quads, str(tmp_path / "nt"))
    assert same(quads, ntriples.read(spark, str(tmp_path / "nt")))
    text = "\n".join(r[0] for r in serializers.turtle_lines(quads, {"": "http://x/"}).collect())
    assert "\ta :C ." in text
    assert same(quads, documents.frame(spark, documents.turtle(text)))
    merged: dict = {}
    for r in serializers.rdf_json_lines(quads).collect():
        merged |= json.loads(r[0])
    assert same(quads, documents.frame(spark, documents.rdf_json(json.dumps(merged))))
    assert same(quads, documents.frame(spark, documents.rdf_xml(serializers.rdf_xml(quads))))
    named = quads.union(documents.frame(spark, documents.turtle("<http://g/1> { <http://s> <http://p> <http://o> }")))
    trig = "\n".join(r[0] for r in serializers.turtle_lines(named, {}, graphs=True).collect())
    assert same(named, documents.frame(spark, documents.turtle(trig)))


NESTED = """@prefix : <http://x/> .
:a :list (1 "two" :three (4 5) [ :in :list ]) ; :none () ; :deep [ :b [ :c [ :d 1 , 2 ] ; :e "x" ] ] .
:b :twice _:t . :c :twice _:t . _:t :v 1 .
_:x :next _:y . _:y :next _:x . _:alone :v 3 .
:d :open _:o . _:o <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> 1 ; <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> :elsewhere .
:e :shared _:l . :f :shared _:l . _:l <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> 1 ; <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> () .
"""


@pytest.mark.parametrize("graphs", [False, True])
def test_nested_turtle(spark, graphs):
    body = NESTED if not graphs else NESTED.replace(":b :twice", ":g1 { :a :list (7 [ :in :g1 ]) . :q :deep [ :z 1 ] } :b :twice", 1)
    quads = documents.frame(spark, documents.turtle(body))
    lines = [r[0] for r in serializers.turtle_lines(quads, {"": "http://x/"}, graphs=graphs).collect()]
    text = "\n".join(lines)
    assert same(quads, documents.frame(spark, documents.turtle(text)))
    assert '( 1 "two" :three ( 4 5 ) ' in text and '[ :b [ :c [ :d 1 ; :d 2 ] ; :e "x" ] ]' in text
    labelled = "\n".join(r[0] for r in serializers.turtle_lines(quads, {}, graphs=graphs, nested=False).collect())
    assert "[" not in labelled and same(quads, documents.frame(spark, documents.turtle(labelled)))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_turtle_strings(value):
    escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    assert documents.turtle(f'<a:s> <a:p> "{escaped}" .')[0][2] == (3, value, None, None)


def test_unescape_in_columns(spark):
    lines = [r'<a:s> <a:p> "\u00e9\U0001F600\t\\u0041\"" .', '<a:s> <a:p> "plain"@EN-gb .', "# note", ""]
    found = ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["o"]["lex"] for r in found] == ['é😀\t\\u0041"', "plain"]
    with pytest.raises(Exception, match="not a statement"):
        ntriples.parse_lines(spark.createDataFrame([("nonsense",)], "value string")).collect()
    assert ntriples.parse_lines(spark.createDataFrame([("nonsense",)], "value string"), strict=False).count() == 0


def test_files_by_extension(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<http://x/s> <p> _:b .")
    (tmp_path / "b.ttl").write_text("<http://x/s> <http://x/p> _:b .")
    found = documents.read(spark, str(tmp_path / "*.ttl"), format="turtle", base="http://x/")
    assert found.count() == 2  # each file has a blank node of its own
    assert documents.guess("x.trig.gz") == "trig" and documents.guess("x", "text/turtle; charset=utf-8") == "turtle"


def test_rdf_xml_and_rdfa():
    xml = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://f/" xml:base="http://b/"><P r:about="a"><n xml:lang="en">B</n><l r:parseType="Collection"><r:Description r:about="q"/></l><r:li>1</r:li></P></r:RDF>'
    found = {(s[1], p[1].rpartition("#")[2], o[1]) for s, p, o, _ in documents.rdf_xml(xml) if s[0] == T.IRI}
    assert {("http://b/a", "type", "http://f/P"), ("http://b/a", "http://f/n", "B"), ("http://b/a", "_1", "1")} <= found
    html = '<body vocab="http://f/"><div resource="/me" typeof="Person"><b property="name">Bob <i>X</i></b><a property="page" href="/p">p</a></div></body>'
    assert {(s[1], p[1], o[1]) for s, p, o, _ in documents.rdfa(html, "http://x/")} >= {("http://x/me", "http://f/name", "Bob X"), ("http://x/me", "http://f/page", "http://x/p")}


def test_results(spark, quads):
    rows = query("SELECT ?s ?o WHERE { ?s <http://x/b> ?o }", Dataset(spark, quads), terms=True)
    for text in (serializers.results_json(rows), serializers.results_xml(rows)):
        assert sorted(map(str, serializers.read_results(spark, text).collect())) == sorted(map(str, rows.collect()))
    assert serializers.read_results(spark, serializers.boolean_json(True)) is True
    assert serializers.read_results(spark, serializers.boolean_xml(False)) is False
    assert serializers.tsv_lines(rows).first()[0] == "?s\t?o"
    assert "| http://x/a |" in serializers.text_table(rows)
    assert serializers.graphviz(quads).startswith("digraph")
    assert serializers.as_dict(quads)["http://x/f"] == {"http://x/g": [{"type": "literal", "value": "t", "datatype": "http://x/ty"}]}
    assert "| http://x/f " in serializers.as_text(quads)
    with pytest.raises(ValueError, match="more than 2"):
        serializers.as_dict(quads, most=2)


def test_patch_and_feed(spark, quads, tmp_path):
    changes = patch.parse_text(spark, '@prefix : <http://x/> . A :n :p 1 . A R R 2 . D :a :b 1 . A :n :p 3 . D :n :p 3 .')
    after = patch.apply(quads, changes)
    assert after.count() == quads.count() + 1
    assert same(patch.apply(quads, patch.difference(quads, after)), after)
    folder = tmp_path / "log"
    patch.lines(changes).coalesce(1).write.text(str(folder))
    numbered = spark.read.text(str(folder)).selectExpr("value", "monotonically_increasing_id() as seq")
    assert same(patch.apply(quads, patch.parse_lines(numbered)), after)
    changes.write.parquet(str(tmp_path / "changes"))
    feed = patch.PatchFeed(quads)
    stream = spark.readStream.schema(patch.CHANGE).parquet(str(tmp_path / "changes"))
    feed.start(stream, str(tmp_path / "ckpt")).awaitTermination()
    assert same(feed.quads, after)


def test_empty_quads(spark):
    assert ntriples.canonical(spark.createDataFrame([], QUAD)).count() == 0
