"""Writers of graphs and of query results, and readers of results.

Line formats are DataFrame functions and scale with the data. Turtle, TriG and RDF/JSON group a subject's statements
into one row and stay distributed; RDF/XML documents and result documents are for what fits one document.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlight import terms as T
from quadlight.sources.ntriples import escape, term_text
from quadlight.storage import staged

RESULTS = "http://www.w3.org/2005/sparql-results#"


def _short(c: Column, prefixes: dict[str, str]) -> Column:
    """An IRI with a prefix where what is left is a plain local name."""
    out = F.concat(F.lit("<"), c, F.lit(">"))
    for name, uri in sorted(prefixes.items(), key=lambda x: len(x[1])):
        local = F.substring(c, F.lit(len(uri) + 1), F.length(c))
        out = F.when(c.startswith(uri) & local.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(f"{name}:"), local)).otherwise(out)
    return out


def _turtle_term(c: Column, prefixes: dict[str, str]) -> Column:
    number = (c["dt"] == T.XSD + "integer") & c["lex"].rlike("^[+-]?[0-9]+$") | (c["dt"] == T.XSD + "decimal") & c["lex"].rlike(r"^[+-]?[0-9]*\.[0-9]+$") | (c["dt"] == T.XSD + "boolean") & c["lex"].isin("true", "false")
    typed = F.concat(F.lit('"'), escape(c["lex"]), F.lit('"^^'), _short(c["dt"], prefixes))
    return F.when(c["kind"] == T.IRI, _short(c["lex"], prefixes)).when((c["kind"] == T.LITERAL) & number, c["lex"]).when((c["kind"] == T.LITERAL) & c["dt"].isNotNull(), typed).otherwise(term_text(c))


def _lists(quads: DataFrame) -> DataFrame:
    """(g, head, cell, pos, member): the collections that Turtle can write as lists: blank cells with one first, one rest and
    nothing else, each but the head the rest of one cell and mentioned nowhere else, the head mentioned at most once, down to
    nil. Rest links are doubled, not walked."""
    blank = quads.where(F.col("s.kind") == T.BLANK)
    is_first, is_rest = (F.col("p.lex") == T.RDF + x for x in ("first", "rest"))
    cells = blank.groupBy("g", F.col("s.lex").alias("cell")).agg(F.count_if(is_first).alias("f"), F.count_if(is_rest).alias("r"), F.count(F.lit(1)).alias("n"), F.max(F.when(is_first, F.col("o"))).alias("member"), F.max(F.when(is_rest, F.col("o"))).alias("next")).where("f = 1 and r = 1 and n = 2")
    uses = quads.where(F.col("o.kind") == T.BLANK).groupBy("g", F.col("o.lex").alias("cell")).agg(F.count(F.lit(1)).alias("uses"), F.count_if(is_rest).alias("rests"))
    cells = cells.join(uses, _same_graph(cells, uses) & (cells["cell"] == uses["cell"]), "left").select(cells["g"], cells["cell"], "member", "next", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("rests", F.lit(0)).alias("rests")).where("uses <= 1")
    cells = staged(cells, "cells")
    ends = F.when((F.col("next.kind") == T.IRI) & (F.col("next.lex") == T.RDF + "nil"), "").otherwise(F.when(F.col("next.kind") == T.BLANK, F.col("next.lex")))
    hops = staged(cells.select("g", "cell", ends.alias("to"), F.lit(1).cast("long").alias("n")).where("to is not null"), "hops")
    for _ in range(64):  # lists of 2^64 cells
        ahead = hops.select(F.col("g").alias("h"), F.col("cell").alias("at"), F.col("to").alias("then"), F.col("n").alias("m"))
        joined = hops.join(ahead, hops["g"].eqNullSafe(ahead["h"]) & (hops["to"] == ahead["at"]) & (hops["to"] != ""), "left")
        # A hop into a cell that is no part of a list ends nowhere; a circle never comes to nil.
        doubled = joined.where((F.col("to") == "") | F.col("at").isNotNull()).select("g", "cell", F.when(F.col("to") == "", "").otherwise(F.col("then")).alias("to"), F.when(F.col("to") == "", F.col("n")).otherwise(F.col("n") + F.col("m")).alias("n"))
        hops = staged(doubled, "hops")
        open_ends = hops.where("to <> ''")
        if open_ends.isEmpty() or open_ends.where(F.col("n") <= cells.count()).isEmpty():
            break
    whole = hops.where("to = ''").select(F.col("g").alias("h"), F.col("cell").alias("c"), F.col("n").alias("left"))
    whole = cells.join(whole, cells["g"].eqNullSafe(F.col("h")) & (cells["cell"] == F.col("c"))).select("g", "cell", "member", "next", "left", "rests")
    whole = staged(whole, "list-cells")
    # The head of a cell: the cell that no rest points at, found by doubling back over the same links.
    up = whole.where(F.col("next.kind") == T.BLANK).select(F.col("g").alias("h"), F.col("cell").alias("above"), F.col("next.lex").alias("below"))
    state = whole.join(up, whole["g"].eqNullSafe(F.col("h")) & (F.col("cell") == F.col("below")), "left").select("g", "cell", F.coalesce("above", "cell").alias("head"), F.col("above").isNull().alias("done"))
    state = staged(state, "heads")
    while not state.where("not done").isEmpty():
        over = state.select(F.col("g").alias("h"), F.col("cell").alias("c"), F.col("head").alias("top"), F.col("done").alias("d"))
        state = staged(state.join(over, state["g"].eqNullSafe(F.col("h")) & (F.col("head") == F.col("c"))).select("g", "cell", F.col("top").alias("head"), F.col("d").alias("done")), "heads")
    named = state.select(F.col("g").alias("h"), F.col("cell").alias("c"), "head")
    return whole.join(named, whole["g"].eqNullSafe(F.col("h")) & (F.col("cell") == F.col("c"))).select("g", "head", "cell", (-F.col("left")).alias("pos"), "member")


def _list_texts(cells: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(h: graph, c: head, list: text) of the lists whose cells are given, lists inside lists first."""
    known, waiting = cells.select(F.col("g").alias("h"), F.col("head").alias("c"), F.lit("").alias("list")).limit(0), cells
    while not waiting.isEmpty():
        inner = waiting.select(F.col("g").alias("h"), F.col("head").alias("c")).distinct()
        holds = F.col("g").eqNullSafe(F.col("h")) & (F.col("member.kind") == T.BLANK) & (F.col("member.lex") == F.col("c"))
        later = staged(waiting.join(inner, holds, "left_semi").select(F.col("g").alias("h"), F.col("head").alias("c")).distinct(), "outer-lists")
        outer = F.col("g").eqNullSafe(F.col("h")) & (F.col("head") == F.col("c"))
        now = waiting.join(later, outer, "left_anti").join(known, holds, "left")
        items = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("list", _turtle_term(F.col("member"), prefixes)).alias("t"))))
        made = now.groupBy(F.col("g").alias("h"), F.col("head").alias("c")).agg(F.concat(F.lit("( "), F.array_join(F.transform(items, lambda x: x["t"]), " "), F.lit(" )")).alias("list"))
        known, waiting = staged(known.union(made), "list-texts"), staged(waiting.join(later, outer, "left_semi"), "lists-left")
    return known


def _same_graph(a: DataFrame, b: DataFrame) -> Column:
    return a["g"].eqNullSafe(b["g"])


def _folded(pairs: DataFrame, most_depth: int = 32) -> DataFrame:
    """Statements (g, s, sb, p, o, ob: texts, and the labels of blank nodes) with blank nodes that are mentioned once, as an
    object, written inside the statement that mentions them. Rounds go from the innermost out; what is still nested after
    ``most_depth`` of them, and circles, keep their labels."""
    for _ in range(most_depth):
        subjects = pairs.where("sb is not null").groupBy("g", "sb").agg(F.count_if(F.col("ob").isNotNull()).alias("open"), F.collect_list(F.struct("p", "o")).alias("said"))
        uses = pairs.where("ob is not null").groupBy(F.col("g").alias("h"), F.col("ob").alias("c")).agg(F.count(F.lit(1)).alias("uses"))
        ready = subjects.where("open = 0").join(uses, F.col("g").eqNullSafe(F.col("h")) & (F.col("sb") == F.col("c"))).where("uses = 1")
        body = F.concat(F.lit("[ "), F.array_join(F.transform(F.array_sort("said"), lambda x: F.concat_ws(" ", x["p"], x["o"])), " ; "), F.lit(" ]"))
        ready = staged(ready.select(F.col("g").alias("rg"), F.col("sb").alias("label"), body.alias("body")), "nested")
        if ready.isEmpty():
            break
        left = pairs.join(ready, pairs["g"].eqNullSafe(F.col("rg")) & (F.col("sb") == F.col("label")), "left_anti")
        put = left.join(ready, left["g"].eqNullSafe(F.col("rg")) & (F.col("ob") == F.col("label")), "left")
        pairs = staged(put.select("g", "s", "sb", "p", F.coalesce("body", "o").alias("o"), F.when(F.col("body").isNull(), F.col("ob")).alias("ob")), "folded")
    return pairs


def turtle_lines(quads: DataFrame, prefixes: dict[str, str] | None = None, graphs: bool = False, nested: bool = True) -> DataFrame:
    """One column ``value``: the prefixes, then a row for each subject (and with ``graphs`` its graph block, as TriG).

    ``nested``: collections are written as lists, and blank nodes that are mentioned once inside the statement that
    mentions them; else every blank node has its label."""
    prefixes = prefixes or {}
    graph = F.col("g") if graphs and "g" in quads.columns else F.lit(None).cast("string")
    quads = quads.select("s", "p", "o", graph.alias("g"))
    verb = F.when(F.col("p.lex") == T.RDF + "type", "a").otherwise(_short(F.col("p.lex"), prefixes))
    label = lambda c: F.when(F.col(f"{c}.kind") == T.BLANK, F.col(f"{c}.lex"))
    if nested and not quads.where(F.col("s.kind") == T.BLANK).isEmpty():
        quads = staged(quads.distinct(), "turtle")
        cells = staged(_lists(quads).join(quads.where(F.col("o.kind") == T.BLANK).select(F.col("g").alias("h"), F.col("o.lex").alias("c")).distinct(), F.col("g").eqNullSafe(F.col("h")) & (F.col("head") == F.col("c")), "left_semi"), "lists")
        gone = cells.select(F.col("g").alias("h"), F.col("cell").alias("c"))
        said = quads.join(gone, F.col("g").eqNullSafe(F.col("h")) & (F.col("s.kind") == T.BLANK) & (F.col("s.lex") == F.col("c")), "left_anti")
        texts = _list_texts(cells, prefixes)
        said = said.join(texts, F.col("g").eqNullSafe(F.col("h")) & (F.col("o.kind") == T.BLANK) & (F.col("o.lex") == F.col("c")), "left")
        # A blank node that is a member of a list is mentioned there, so it keeps its label.
        listed = cells.where(F.col("member.kind") == T.BLANK).select(F.col("g").alias("mg"), F.col("member.lex").alias("m")).distinct().withColumn("member_too", F.lit(True))
        rows = said.select("g", _turtle_term(F.col("s"), prefixes).alias("s"), label("s").alias("sb"), verb.alias("p"), F.coalesce("list", _turtle_term(F.col("o"), prefixes)).alias("o"), F.when(F.col("list").isNull(), label("o")).alias("ob"))
        held = rows.join(listed, F.col("g").eqNullSafe(F.col("mg")) & (F.col("sb") == F.col("m")), "left")
        pairs = _folded(held.select("g", "s", F.when(F.col("member_too").isNull(), F.col("sb")).alias("sb"), "p", "o", "ob")).select("g", "s", "p", "o")
    else:
        pairs = quads.select("g", _turtle_term(F.col("s"), prefixes).alias("s"), verb.alias("p"), _turtle_term(F.col("o"), prefixes).alias("o")).distinct()
    objects = pairs.groupBy("s", "p", "g").agg(F.array_join(F.array_sort(F.collect_list("o")), " , ").alias("o"))
    said = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n\t")
    rows = objects.groupBy("s", "g").agg(F.concat(F.col("s"), F.lit(" "), said, F.lit(" .")).alias("value"))
    name = F.when(F.col("g").startswith("_:"), F.col("g")).otherwise(_short(F.col("g"), prefixes))
    rows = rows.select("s", F.when(F.col("g").isNull(), F.col("value")).otherwise(F.concat(name, F.lit(" {\n"), F.col("value"), F.lit("\n}"))).alias("value"))
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in sorted(prefixes.items()))
    first = quads.sparkSession.range(1).select(F.lit(0).alias("_o"), F.lit(head).alias("value"), F.lit("").alias("s"))
    return first.where(F.lit(bool(head))).union(rows.select(F.lit(1), "value", "s")).orderBy("_o", "s", "value").select("value")


def rdf_json_lines(quads: DataFrame) -> DataFrame:
    """One column ``value``: an RDF/JSON object for each subject; together they make the whole when merged."""
    name = lambda c: F.when(F.col(f"{c}.kind") == T.BLANK, F.concat(F.lit("_:"), F.col(f"{c}.lex"))).otherwise(F.col(f"{c}.lex"))
    kind = F.when(F.col("o.kind") == T.IRI, "uri").when(F.col("o.kind") == T.BLANK, "bnode").otherwise("literal")
    o = F.struct(kind.alias("type"), name("o").alias("value"), F.col("o.lang").alias("lang"), F.col("o.dt").alias("datatype"))
    by = quads.select(name("s").alias("s"), F.col("p.lex").alias("p"), o.alias("o")).groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("o"))
    pairs = by.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("m"))
    return pairs.orderBy("s").select(F.to_json(F.create_map("s", "m")).alias("value"))


def tsv_lines(bindings: DataFrame) -> DataFrame:
    """Rows of boxed terms as N-Triples cells with a tab between, under a header of variables."""
    cells = [F.coalesce(term_text(F.col(f"`{c}`")), F.lit("")) for c in bindings.columns]
    head = bindings.sparkSession.range(1).select(F.lit("\t".join(f"?{c}" for c in bindings.columns)).alias("value"))
    return head.union(bindings.select(F.concat_ws("\t", *cells)))


def csv_values(bindings: DataFrame) -> DataFrame:
    """Rows of boxed terms as plain values; ``.write.csv`` does the rest."""
    cell = lambda c: F.when(c["kind"] == T.BLANK, F.concat(F.lit("_:"), c["lex"])).otherwise(c["lex"])
    return bindings.select(*[cell(F.col(f"`{c}`")).alias(c) for c in bindings.columns])


def result_lines(bindings: DataFrame) -> DataFrame:
    """One column ``value``: each row as a binding object of the SPARQL JSON results format."""
    cells = []
    for c in bindings.columns:
        t = F.col(f"`{c}`")
        kind = F.when(t["kind"] == T.IRI, "uri").when(t["kind"] == T.BLANK, "bnode").otherwise("literal")
        cells.append(F.when(t.isNotNull(), F.struct(kind.alias("type"), t["lex"].alias("value"), t["lang"].alias("xml:lang"), t["dt"].alias("datatype"))).alias(c))
    return bindings.select(F.to_json(F.struct(*cells)).alias("value"))


def results_json(bindings: DataFrame) -> str:
    """A whole result document, streamed from the executors partition by partition."""
    rows = ",\n".join(r[0] for r in result_lines(bindings).toLocalIterator())
    return f'{{"head":{json.dumps({"vars": bindings.columns})},"results":{{"bindings":[{rows}]}}}}'


def boolean_json(value: bool) -> str:
    return json.dumps({"head": {}, "boolean": value})


def _terms(row, columns: Iterable[str]) -> list:
    return [(c, row[c]) for c in columns if row[c] is not None]


def results_xml(bindings: DataFrame) -> str:
    root = ET.Element("sparql", xmlns=RESULTS)
    head = ET.SubElement(root, "head")
    for c in bindings.columns:
        ET.SubElement(head, "variable", name=c)
    results = ET.SubElement(root, "results")
    for row in bindings.toLocalIterator():
        result = ET.SubElement(results, "result")
        for c, t in _terms(row, bindings.columns):
            binding = ET.SubElement(result, "binding", name=c)
            a = {"xml:lang": t["lang"]} if t["lang"] else {"datatype": t["dt"]} if t["dt"] else {}
            ET.SubElement(binding, {T.IRI: "uri", T.BLANK: "bnode"}.get(t["kind"], "literal"), a).text = t["lex"]
    return '<?xml version="1.0"?>\n' + ET.tostring(root, encoding="unicode")


def boolean_xml(value: bool) -> str:
    return f'<?xml version="1.0"?>\n<sparql xmlns="{RESULTS}"><head/><boolean>{str(value).lower()}</boolean></sparql>'


def text_table(bindings: DataFrame, n: int = 100) -> str:
    rows = [[(t[1]["lex"] if (t := (c, r[c]))[1] else "") for c in bindings.columns] for r in bindings.take(n)]
    widths = [max(map(len, column)) for column in zip(bindings.columns, *rows, strict=True)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    return "\n".join([rule, line(bindings.columns), rule, *map(line, rows), rule])


def read_results(spark: SparkSession, text: str) -> DataFrame | bool:
    """Bindings (boxed terms) or the boolean of a JSON or XML result document."""
    rows: list[dict] = []
    if text.lstrip().startswith("{"):
        doc = json.loads(text)
        if "boolean" in doc:
            return bool(doc["boolean"])
        names = doc["head"]["vars"]
        kinds = {"uri": T.IRI, "bnode": T.BLANK}
        for b in doc["results"]["bindings"]:
            rows.append({k: (kinds.get(v["type"], T.LITERAL), v["value"], v.get("xml:lang"), v.get("datatype")) for k, v in b.items()})
    else:
        q = lambda x: f"{{{RESULTS}}}{x}"
        root = ET.fromstring(text)
        if (flag := root.find(q("boolean"))) is not None:
            return flag.text.strip() == "true"
        names = [v.get("name") for v in root.find(q("head")).findall(q("variable"))]
        for result in root.find(q("results")):
            row = {}
            for b in result:
                t = b[0]
                kind = {"uri": T.IRI, "bnode": T.BLANK}.get(t.tag.rpartition("}")[2], T.LITERAL)
                row[b.get("name")] = (kind, t.text or "", t.get("{http://www.w3.org/XML/1998/namespace}lang"), t.get("datatype"))
            rows.append(row)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` {T.TERM}" for n in names) or "_unit int")


def rdf_xml(quads: DataFrame) -> str:
    """One RDF/XML document of the triples, by subject. Predicates must end in an XML name."""
    root = ET.Element(f"{{{T.RDF}}}RDF")
    ET.register_namespace("rdf", T.RDF)
    last, node = None, None
    for r in quads.select("s", "p", "o").distinct().orderBy("s", "p", "o").toLocalIterator():
        if r["s"] != last:
            key = "about" if r["s"]["kind"] == T.IRI else "nodeID"
            node, last = ET.SubElement(root, f"{{{T.RDF}}}Description", {f"{{{T.RDF}}}{key}": r["s"]["lex"]}), r["s"]
        m = re.match(r"^(.*?)([A-Za-z_][\w.\-]*)$", r["p"]["lex"])
        if not m:
            raise ValueError(f"no XML name in {r['p']['lex']}")
        e, o = ET.SubElement(node, f"{{{m[1]}}}{m[2]}"), r["o"]
        if o["kind"] == T.LITERAL:
            e.text = o["lex"]
            if o["lang"]:
                e.set("{http://www.w3.org/XML/1998/namespace}lang", o["lang"])
            elif o["dt"]:
                e.set(f"{{{T.RDF}}}datatype", o["dt"])
        else:
            e.set(f"{{{T.RDF}}}{'resource' if o['kind'] == T.IRI else 'nodeID'}", o["lex"])
    return ET.tostring(root, encoding="unicode")


def as_dict(quads: DataFrame, most: int = 100_000) -> dict[str, dict[str, list[dict[str, str]]]]:
    """Subjects to predicates to lists of objects ({type, value, lang, datatype}), as RDF/JSON has them: for graphs that fit
    one program. More than ``most`` statements are an error, found before anything is collected."""
    rows = quads.select("s", "p", "o").distinct()
    if (n := rows.limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} statements ({n} or more); write them as lines instead")
    out: dict[str, dict[str, list[dict[str, str]]]] = {}
    for (line,) in rdf_json_lines(rows).collect():
        out |= json.loads(line)
    return out


def as_text(quads: DataFrame, n: int = 100) -> str:
    """A table of the first statements, for people to look at."""
    return text_table(quads.select("s", "p", "o").distinct().orderBy("s", "p", "o"), n)


def graphviz(quads: DataFrame) -> str:
    quote = lambda t: json.dumps(t["lex"], ensure_ascii=False)
    rows = "\n".join(f"  {quote(r['s'])} -> {quote(r['o'])} [label={quote(r['p'])}];" for r in quads.select("s", "p", "o").distinct().orderBy("s", "p", "o").toLocalIterator())
    return f"digraph {{\n{rows}\n}}"
