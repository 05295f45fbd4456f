"""RDF documents that are parsed whole: Turtle, TriG, RDF/XML, RDF/JSON and RDFa.

Each file is one task's work (``mapInPandas`` over binary files), so a set of files is read in parallel. Blank nodes
are scoped to their document by a hash of its path.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.sax
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

from quadlight import terms as T
from quadlight.plans.algebra import PathPattern
from quadlight.plans.parser import Parser, SparqlError
from quadlight.sources import ntriples
from quadlight.terms import RDF, XSD, Iri, Literal, Var

Quad = tuple  # (s, p, o, g): (kind, lex, lang, dt) each, and a graph IRI or None


def iri(x: str) -> tuple:
    return (T.IRI, x, None, None)


def literal(x: str, lang: str | None = None, dt: str | None = None) -> tuple:
    return (T.LITERAL, x, lang.lower() if lang else None, None if lang or dt == XSD + "string" else dt)


class TurtleParser(Parser):
    """Turtle and TriG: the triples grammar of the query language, with directives and graph blocks."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        super().__init__(text, base)
        self.scope = scope

    def box(self, n) -> tuple:
        if isinstance(n, Iri):
            return iri(n.value)
        if isinstance(n, Literal):
            return literal(n.value, n.lang, n.dt)
        if isinstance(n, Var) and n.name.startswith("_:"):
            return (T.BLANK, f"{self.scope}{n.name[2:]}", None, None)
        raise SparqlError("no variable may stand here")

    def literal(self):
        if self.peek()[0] == "op" and self.peek()[1] in "+-" and self.peek(1)[0] == "number":
            sign = self.next()[1]
            found = super().literal()
            return Literal(sign + found.value, None, found.dt)
        return super().literal()

    def directive(self) -> bool:
        kind, s = self.peek()
        at = kind == "lang" and s in ("@prefix", "@base")
        if not at and not self.is_word("prefix", "base"):
            return False
        self.at += 1
        if s.lower().lstrip("@") == "base":
            self.base = self.resolve(self.iri_text())
        else:
            name = self.next()[1]
            if not name.endswith(":"):
                raise SparqlError(f"bad prefix {name!r}")
            self.prefixes[name[:-1]] = self.resolve(self.iri_text())
        if at:
            self.need(".")
        return True

    def iri_text(self) -> str:
        return self.iri().value

    def read(self) -> list[Quad]:
        out: list[Quad] = []
        while self.peek()[0] != "end":
            if self.directive():
                continue
            graph = None
            if self.word("graph"):
                graph = self.box(self.term())[1]
                self.block(out, graph)
            elif self.is_op("{"):
                self.block(out, None)
            elif (self.is_iri() or self.peek()[0] == "blank") and self.peek(1) == ("op", "{"):
                node = self.box(self.term())
                self.block(out, node[1] if node[0] == T.IRI else f"_:{node[1]}")
            else:
                self.statement(out, None)
                self.need(".")
        return out

    def block(self, out: list[Quad], graph: str | None) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement(out, graph)
            if not self.op("."):
                self.need("}")
                break

    def statement(self, out: list[Quad], graph: str | None) -> None:
        triples: list = []
        self.triples(triples, paths=False)
        for t in triples:
            if isinstance(t, PathPattern) or isinstance(t[0], Literal) or not isinstance(t[1], Iri):
                raise SparqlError("not a triple")
            out.append((*map(self.box, t), graph))


def turtle(text: str, base: str = "", scope: str = "") -> list[Quad]:
    return TurtleParser(text, base, scope).read()


def rdf_json(text: str, base: str = "", scope: str = "") -> list[Quad]:
    def node(x: str) -> tuple:
        return (T.BLANK, scope + x[2:], None, None) if x.startswith("_:") else iri(x)

    out = []
    for s, ps in json.loads(text).items():
        for p, os in ps.items():
            for o in os:
                value = literal(o["value"], o.get("lang"), o.get("datatype")) if o["type"] == "literal" else node(o["value"])
                out.append((node(s), iri(p), value, None))
    return out


class RdfXml(xml.sax.ContentHandler):
    """RDF/XML, by a stack of node and property elements."""

    def __init__(self, base: str, scope: str):
        super().__init__()
        self.out: list[Quad] = []
        self.scope, self.count = scope, 0
        self.stack: list[dict] = [{"kind": "root", "base": base, "lang": None}]
        self.names: dict[str | None, list[str]] = {}
        self.raw: list[str] = []
        self.depth = 0

    def blank(self, name: str | None = None) -> tuple:
        self.count += 1
        return (T.BLANK, f"{self.scope}n{name}" if name else f"{self.scope}x{self.count}", None, None)

    def add(self, s: tuple, p: str, o: tuple, about: str | None = None) -> None:
        self.out.append((s, iri(p), o, None))
        if about:
            for q, v in (("subject", s), ("predicate", iri(p)), ("object", o), ("type", iri(RDF + "Statement"))):
                self.out.append((iri(about), iri(RDF + q), v, None))

    def startElementNS(self, name, qname, attrs):
        if self.depth:
            self.depth += 1
            inner = "".join(f' {k[1]}="{_xml(v)}"' for k, v in sorted(attrs.items()))
            self.raw.append(f"<{name[1]}{self.namespace(name[0]) if self.depth == 2 else ''}{inner}>")
            return
        a = {(k[0] or "") + k[1]: v for k, v in attrs.items()}
        top = self.stack[-1]
        xml_ns = "http://www.w3.org/XML/1998/namespace"
        base = urljoin(top["base"], a.pop(xml_ns + "base")) if xml_ns + "base" in a else top["base"]
        lang = a.pop(xml_ns + "lang", top["lang"]) or None
        a = {k: v for k, v in a.items() if not k.startswith(xml_ns)}
        tag = (name[0] or "") + name[1]
        state = {"base": base, "lang": lang, "text": [], "items": []}
        if top["kind"] == "root" and tag == RDF + "RDF":
            state["kind"] = "root"
        elif top["kind"] in ("root", "property", "collection"):
            self.node(tag, a, state, top)
        else:
            self.property(tag, a, state, top)
        self.stack.append(state)

    def namespace(self, uri: str | None) -> str:
        return f' xmlns="{_xml(uri)}"' if uri else ""

    def node(self, tag: str, a: dict, state: dict, top: dict) -> None:
        full = lambda x: urljoin(state["base"], x)
        if RDF + "about" in a:
            s = iri(full(a.pop(RDF + "about")))
        elif RDF + "ID" in a:
            s = iri(urljoin(state["base"], "#" + a.pop(RDF + "ID")))
        else:
            s = self.blank(a.pop(RDF + "nodeID", None))
        state |= {"kind": "node", "subject": s, "li": 0}
        if tag != RDF + "Description":
            self.add(s, RDF + "type", iri(tag))
        for k, v in a.items():
            self.add(s, k, iri(full(v)) if k == RDF + "type" else literal(v, state["lang"]))
        if top["kind"] == "property":
            self.add(top["subject"], top["predicate"], s, top["about"])
            top["done"] = True
        elif top["kind"] == "collection":
            top["items"].append(s)

    def property(self, tag: str, a: dict, state: dict, top: dict) -> None:
        full = lambda x: urljoin(state["base"], x)
        if tag == RDF + "li":
            top["li"] += 1
            tag = f"{RDF}_{top['li']}"
        about = urljoin(state["base"], "#" + a.pop(RDF + "ID")) if RDF + "ID" in a else None
        kind, dt = a.pop(RDF + "parseType", None), a.pop(RDF + "datatype", None)
        state |= {"kind": "property", "subject": top["subject"], "predicate": tag, "about": about, "dt": full(dt) if dt else None, "done": False}
        if kind == "Resource":
            o = self.blank()
            self.add(top["subject"], tag, o, about)
            state |= {"kind": "node", "subject": o, "li": 0}
        elif kind == "Collection":
            state["kind"] = "collection"
        elif kind is not None:
            state["kind"], self.depth, self.raw = "xml", 1, []
        elif RDF + "resource" in a or RDF + "nodeID" in a or a:
            o = iri(full(a.pop(RDF + "resource"))) if RDF + "resource" in a else self.blank(a.pop(RDF + "nodeID", None))
            self.add(top["subject"], tag, o, about)
            for k, v in a.items():
                self.add(o, k, iri(full(v)) if k == RDF + "type" else literal(v, state["lang"]))
            state["done"] = True

    def endElementNS(self, name, qname):
        if self.depth > 1:
            self.depth -= 1
            self.raw.append(f"</{name[1]}>")
            return
        state = self.stack.pop()
        if state["kind"] == "xml":
            self.depth = 0
            self.add(state["subject"], state["predicate"], literal("".join(self.raw), None, RDF + "XMLLiteral"), state["about"])
        elif state["kind"] == "property" and not state["done"]:
            self.add(state["subject"], state["predicate"], literal("".join(state["text"]), state["lang"] if not state["dt"] else None, state["dt"]), state["about"])
        elif state["kind"] == "collection":
            head = iri(RDF + "nil")
            for item in reversed(state["items"]):
                cell = self.blank()
                self.add(cell, RDF + "first", item)
                self.add(cell, RDF + "rest", head)
                head = cell
            self.add(state["subject"], state["predicate"], head, state["about"])

    def characters(self, content):
        if self.depth:
            self.raw.append(_xml(content))
        else:
            self.stack[-1].get("text", []).append(content)


def _xml(text: str | None) -> str:
    return (text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def rdf_xml(text: str | bytes, base: str = "", scope: str = "") -> list[Quad]:
    import io

    handler = RdfXml(base, scope)
    reader = xml.sax.make_parser()
    reader.setFeature(xml.sax.handler.feature_namespaces, True)
    reader.setFeature(xml.sax.handler.feature_external_ges, False)
    reader.setContentHandler(handler)
    reader.parse(io.BytesIO(text.encode() if isinstance(text, str) else text))
    return handler.out


class Rdfa(HTMLParser):
    """The attributes about, src, href, resource, typeof, property, rel, rev, content, datatype, lang, prefix, vocab."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, base: str, scope: str):
        super().__init__(convert_charrefs=True)
        self.out: list[Quad] = []
        self.scope, self.count = scope, 0
        self.stack = [{"tag": "", "subject": iri(base), "lang": None, "vocab": "", "prefix": {"rdf": RDF, "xsd": XSD, "rdfs": T.RDFS}, "properties": [], "text": [], "base": base, "rel": []}]

    def name(self, x: str, env: dict) -> str | None:
        if x.startswith("[") and x.endswith("]"):
            x = x[1:-1]
        prefix, colon, local = x.partition(":")
        if colon and prefix in env["prefix"]:
            return env["prefix"][prefix] + local
        if colon:
            return x
        return env["vocab"] + x if env["vocab"] else None

    def resource(self, x: str, env: dict) -> tuple:
        x = x[1:-1] if x.startswith("[") and x.endswith("]") else x
        if x.startswith("_:"):
            return (T.BLANK, self.scope + x[2:], None, None)
        prefix, colon, local = x.partition(":")
        return iri(env["prefix"][prefix] + local) if colon and prefix in env["prefix"] else iri(urljoin(env["base"], x))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        up = self.stack[-1]
        env = {**up, "tag": tag, "properties": [], "text": [], "rel": []}
        if "prefix" in a:
            words = a["prefix"].split()
            env["prefix"] = {**up["prefix"], **{p.rstrip(":"): u for p, u in zip(words[::2], words[1::2], strict=False)}}
        if tag == "base" and "href" in a:
            for e in self.stack:
                e["base"] = a["href"]
            self.stack[0]["subject"] = iri(a["href"])
        env["vocab"] = a.get("vocab", up["vocab"])
        env["lang"] = a.get("lang", a.get("xml:lang", up["lang"])) or None
        names = lambda k: [n for x in a.get(k, "").split() if (n := self.name(x, env))]
        target = next((self.resource(a[k], env) for k in ("resource", "href", "src") if k in a), None)
        subject = self.resource(a["about"], env) if "about" in a else None
        rel, rev, properties, types = names("rel"), names("rev"), names("property"), names("typeof")
        if subject is None and target and not (rel or rev) and (not properties or "content" in a or "datatype" in a):
            subject = target  # what is not said of the resource around it is said of the one that is named here
        if subject is None and types and not (rel or rev):
            self.count += 1
            subject = target if target and not properties else (T.BLANK, f"{self.scope}r{self.count}", None, None)
        here = subject or up["subject"]
        for p, s, o in [(p, s, here) for p, s in up["rel"]] if subject else []:
            self.out.append((s, iri(p), o, None))
        for t in types:
            self.out.append((here, iri(RDF + "type"), iri(t), None))
        if target and (rel or rev):
            self.out += [(here, iri(p), target, None) for p in rel] + [(target, iri(p), here, None) for p in rev]
        elif rel:
            env["rel"] = [(p, here) for p in rel]
        for p in properties:
            if "content" in a:
                self.out.append((here, iri(p), literal(a["content"], env["lang"], self.name(a["datatype"], env) if a.get("datatype") else None), None))
            elif target and not rel and "datatype" not in a:
                self.out.append((here, iri(p), target, None))
            else:
                env["properties"].append((here, p, self.name(a["datatype"], env) if a.get("datatype") else None))
        env["subject"] = target if target and rel else here
        if tag not in self.VOID:
            self.stack.append(env)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.stack[1:]):
            while len(self.stack) > 1:
                e = self.stack.pop()
                text = "".join(e["text"])
                for s, p, dt in e["properties"]:
                    self.out.append((s, iri(p), literal(text, None if dt else e["lang"], dt), None))
                self.stack[-1]["text"].append(text)
                if e["tag"] == tag:
                    break

    def handle_data(self, data):
        self.stack[-1]["text"].append(data)


def rdfa(text: str, base: str = "", scope: str = "") -> list[Quad]:
    parser = Rdfa(base, scope)
    parser.feed(text)
    parser.close()
    for e in reversed(parser.stack[1:]):
        parser.handle_endtag(e["tag"])
    return parser.out


PARSERS = {"turtle": turtle, "trig": turtle, "rdfxml": rdf_xml, "rdfjson": rdf_json, "rdfa": rdfa}
#: Formats by file extension and by media type.
EXTENSIONS = {"nt": "ntriples", "nq": "nquads", "ttl": "turtle", "n3": "turtle", "trig": "trig", "rdf": "rdfxml", "xrdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "json": "rdfjson", "js": "rdfjson", "html": "rdfa", "xhtml": "rdfa", "htm": "rdfa"}
MEDIA_TYPES = {"application/n-triples": "ntriples", "text/plain": "ntriples", "application/n-quads": "nquads", "text/x-nquads": "nquads", "text/turtle": "turtle", "application/x-turtle": "turtle", "application/turtle": "turtle", "application/trig": "trig", "application/rdf+xml": "rdfxml", "application/json": "rdfjson", "application/x-rdf+json": "rdfjson", "text/html": "rdfa", "application/xhtml+xml": "rdfa"}


def guess(path: str, media_type: str | None = None) -> str:
    if media_type and media_type.split(";")[0].strip() in MEDIA_TYPES:
        return MEDIA_TYPES[media_type.split(";")[0].strip()]
    found = EXTENSIONS.get(re.sub(r"\.(gz|bz2|zst)$", "", path).rpartition(".")[2].lower())
    if found is None:
        raise ValueError(f"the format of {path} is not known")
    return found


def frame(spark: SparkSession, quads: list[Quad]) -> DataFrame:
    return spark.createDataFrame(quads, f"s {T.TERM}, p {T.TERM}, o {T.TERM}, g string")


def read(spark: SparkSession, path: str, format: str | None = None, base: str | None = None) -> DataFrame:
    """Quads of a file, or of every file of a folder or pattern. ``base``: by default each file's own path."""
    format = format or guess(path)
    if format in ("ntriples", "nquads"):
        return ntriples.read(spark, path)
    parse = PARSERS[format]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            for place, content in zip(pdf.path, pdf.content, strict=True):
                scope = hashlib.md5(place.encode()).hexdigest()[:8]
                data = bytes(content) if format == "rdfxml" else bytes(content).decode("utf-8")
                quads = parse(data, place if base is None else base, scope)
                term = lambda t: dict(zip(("kind", "lex", "lang", "dt"), t, strict=True))
                yield pd.DataFrame([(*map(term, q[:3]), q[3]) for q in quads], columns=["s", "p", "o", "g"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"s {T.TERM}, p {T.TERM}, o {T.TERM}, g string").distinct()
