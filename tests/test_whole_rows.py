"""Queries of the catalogue that keep every row and every character."""

import duckdb

from quadlight import queries

SF = "/root/testdata/sf0.001"


def test_order_of_all_rows(spark):
    for name, table in (("order_multi", "customer"), ("order_unbound_first", "documents")):
        got = [tuple(r) for r in queries.queries()[name](spark, SF).collect()]
        assert len(got) == duckdb.sql(f"select count(*) from '{SF}/{table}.parquet'").fetchall()[0][0]
        key = (lambda r: (r[0], -r[1], r[2])) if table == "customer" else (lambda r: (-1 if r[1] is None else r[1], r[0]))
        assert [key(r) for r in got] == sorted(map(key, got))
    assert {r[1] for r in got} == {None, 0, 1}


def test_encode_uri_of_whole_texts(spark):
    from urllib.parse import quote

    texts = duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").fetchall()
    got = [r[0] for r in queries.queries()["encode_uri"](spark, SF).collect() if r[0] is not None]
    assert sorted(got) == sorted(quote(t, safe="-_.~") for (t,) in texts)
