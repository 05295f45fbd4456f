"""Runs a query or an update over RDF files: python -m quadlight [options] FILE..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quadlight import engine
from quadlight.sources import documents, ntriples, serializers
from quadlight.sources.dataset import Dataset


def options(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quadlight", description=__doc__)
    p.add_argument("files", nargs="*", help="RDF files; IRI=FILE reads a file into a named graph")
    asked = p.add_mutually_exclusive_group(required=True)
    asked.add_argument("-e", "--query", help="the text of a query")
    asked.add_argument("-q", "--query-file", help="a file with a query")
    asked.add_argument("-u", "--update", help="the text of an update; prints the statements after it as N-Quads")
    p.add_argument("-o", "--output", choices=("table", "json", "tsv"), default="table", help="how solutions are written")
    p.add_argument("-x", "--explain", action="store_true", help="print the plan instead of running it")
    p.add_argument("-p", "--prefix", action="append", default=[], metavar="NAME=IRI")
    return p.parse_args(argv)


def dataset(spark: SparkSession, files: list[str]) -> Dataset:
    from pyspark.sql import functions as F

    quads = None
    for f in files:
        graph, named, path = f.rpartition("=")
        found = documents.read(spark, path)
        found = found.withColumn("g", F.lit(graph)) if named else found
        quads = found if quads is None else quads.union(found)
    return Dataset(spark, quads)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> None:
    asked, out = options(sys.argv[1:] if argv is None else argv), out or sys.stdout
    spark = spark or SparkSession.builder.appName("quadlight").getOrCreate()
    data, prefixes = dataset(spark, asked.files), dict(x.split("=", 1) for x in asked.prefix)
    if asked.update:
        lines = ntriples.lines(engine.update(asked.update, data, prefixes=prefixes).all_quads()).orderBy("value")
        out.writelines(f"{r[0]}\n" for r in lines.toLocalIterator())
        return
    if asked.query_file:
        with open(asked.query_file, encoding="utf-8") as f:
            asked.query = f.read()
    if asked.explain:
        out.write(engine.explain(asked.query, data, prefixes=prefixes) + "\n")
        return
    found = engine.query(asked.query, data, terms=True, prefixes=prefixes)
    if found.columns == ["result"] and found.schema["result"].dataType.simpleString() == "boolean":
        out.write(serializers.boolean_json(found.first()[0]) + "\n")
    elif found.columns in (["s", "p", "o"], ["s", "p", "o", "g"]) and not asked.query.lstrip().lower().startswith("select"):
        out.writelines(f"{r[0]}\n" for r in ntriples.lines(found).toLocalIterator())
    elif asked.output == "table":
        out.write(serializers.text_table(found) + "\n")
    else:
        rows = serializers.tsv_lines(found) if asked.output == "tsv" else serializers.result_lines(found)
        out.writelines(f"{r[0]}\n" for r in rows.toLocalIterator())


if __name__ == "__main__":
    main()
