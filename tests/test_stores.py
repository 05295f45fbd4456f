import pytest

from quadlight.sources import documents, ntriples, stores
from quadlight.sources.dataset import Dataset


def test_snapshot_and_config(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<http://x/s> <http://x/p> 1 , 'a'@en .")
    data = stores.open_dataset(spark, str(tmp_path / "a.ttl"))
    stores.save(data.all_quads(), str(tmp_path / "snap"), buckets=4)
    again = stores.open_dataset(spark, {"snapshot": str(tmp_path / "snap"), "files": {"http://g": str(tmp_path / "a.ttl")}})
    assert again.count_statements() == 2 and again.count_statements(quads=True) == 4
    assert [r["g"] for r in again.graphs().collect()] == ["http://g"]
    with pytest.raises(ValueError, match="unknown settings"):
        stores.open_dataset(spark, {"nope": 1})


def test_dictionary(spark):
    resources = spark.createDataFrame([(1, "http://s"), (2, "http://p"), (9, "http://g")], "ID long, URI string")
    literals = spark.createDataFrame([(3, "v", "en", ""), (4, "5", None, "http://www.w3.org/2001/XMLSchema#integer")], "ID long, Value string, Language string, Datatype string")
    blanks = spark.createDataFrame([(5, "b")], "ID long, Name string")
    statements = spark.createDataFrame([(1, 2, 3, 0), (5, 2, 4, 9)], "Subject long, Predicate long, Object long, Context long")
    quads = stores.decode(statements, resources, literals, blanks)
    lines = sorted(r[0] for r in ntriples.lines(quads).collect())
    assert lines == ['<http://s> <http://p> "v"@en .', '_:b <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <http://g> .']


def test_language_preference(spark):
    text = "<http://s> <http://p> 'a'@en , 'b'@de , 'c'@en , 'plain' . <http://t> <http://p> 'd'@fr ."
    best = Dataset(spark, documents.frame(spark, documents.turtle(text))).preferring({"en": 1.0, "de": 0.5})
    assert sorted(r["o"]["lex"] for r in best.all_quads().collect()) == ["a", "c", "d", "plain"]
