"""RDF terms, and typed values: Spark columns whose RDF type is known when a query is compiled.

A value stays unboxed (a native column and a static type) wherever its type is known, so comparisons and joins run on
native columns and reach the scan. Otherwise it is a boxed term, ``struct<kind, lex, lang, dt>``. Unbound variables and
expression errors are both NULL. A plain literal and an xsd:string are one term (``dt`` NULL).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
FN = "http://www.w3.org/2005/xpath-functions#"
BLANK, IRI, LITERAL = 1, 2, 3
TERM = "struct<kind:tinyint,lex:string,lang:string,dt:string>"
#: The types derived from xsd:integer.
DERIVED = ("nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger")
INTEGERS = [XSD + x for x in ("integer", *DERIVED)]
NUMERIC = [*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double"]
RANK = {"integer": 0, "decimal": 1, "float": 2, "double": 3}
#: What an xsd:decimal of unknown size is read as. Columns of static decimals have the size that Spark gives them.
DECIMAL = "decimal(38,18)"
WHOLE = "decimal(38,0)"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    label: str


@dataclass(frozen=True)
class Literal:
    value: str
    lang: str | None = None
    dt: str | None = None


Node = Var | Iri | Blank | Literal


def normal_lang(tag: str) -> str:
    """Language lower case, region upper case, script title case."""
    parts = tag.split("-")
    return "-".join([parts[0].lower(), *(p.upper() if len(p) == 2 else p.title() if len(p) == 4 else p.lower() for p in parts[1:])])


@dataclass
class Value:
    """A column with its static RDF type.

    ``type``: string, lang, integer, decimal, float, double, boolean, dateTime, iri, blank or term (boxed). An iri
    with a ``template`` holds a key only: the IRI is the template and the key's text. A lang value has its tag in
    ``lang``.
    """

    col: Column
    type: str
    template: str | None = None
    lang: Column | None = None
    literal: Literal | None = None  # of a constant dateTime

    @property
    def numeric(self) -> bool:
        return self.type in RANK

    def lex(self) -> Column:
        """The lexical form: of a literal its value, of an IRI itself, of a blank node its label."""
        if self.type == "term":
            return self.col["lex"]
        if self.type == "iri" and self.template is not None:
            return F.concat(F.lit(self.template), self.col.cast("string"))
        if self.type == "dateTime":
            fine = F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            return F.when(F.date_format(self.col, "SSSSSS") == "000000", F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.regexp_replace(fine, "0+$", ""))
        if self.type == "decimal":
            return decimal_text(self.col)
        return self.col if self.type in ("string", "lang", "iri", "blank") else self.col.cast("string")

    def box(self) -> Column:
        if self.type == "term":
            return self.col
        kind = IRI if self.type == "iri" else BLANK if self.type == "blank" else LITERAL
        dt = XSD + self.type if self.type in (*RANK, "boolean", "dateTime") else None
        return F.when(self.col.isNotNull(), boxed(kind, self.lex(), self.lang, F.lit(dt)))


def boxed(kind: int | Column, lex: Column, lang: Column | None = None, dt: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(kind.cast("tinyint").alias("kind"), lex.cast("string").alias("lex"), (none if lang is None else lang.cast("string")).alias("lang"), (none if dt is None else dt.cast("string")).alias("dt"))


def decimal_text(c: Column) -> Column:
    """The canonical text of a decimal: no zeros behind the last digit, and no point without digits behind it."""
    return F.regexp_replace(c.cast("string"), r"\.0*$|(?<=\.[0-9]{0,18}[1-9])0+$", "")


def constant(node: Node) -> Value:
    if isinstance(node, Iri):
        return Value(F.lit(node.value), "iri")
    if isinstance(node, Blank):
        return Value(F.lit(node.label), "blank")
    v, dt = node.value, node.dt
    if node.lang:
        return Value(F.lit(v), "lang", lang=F.lit(normal_lang(node.lang)))
    if dt in (None, XSD + "string"):
        return Value(F.lit(v), "string")
    try:
        if dt == XSD + "integer":
            if str(int(v)) == v and abs(int(v)) < 1 << 63:
                return Value(F.lit(int(v)).cast("bigint"), "integer")
        elif dt == XSD + "decimal":
            d = Decimal(v)
            if d.is_finite() and len(d.as_tuple().digits) <= 38 and -18 <= d.as_tuple().exponent <= 0:
                return Value(F.lit(d), "decimal")
        elif dt in (XSD + "double", XSD + "float"):
            return Value(F.lit(float(v)), dt.removeprefix(XSD))
        elif dt == XSD + "boolean" and v in ("true", "false"):
            return Value(F.lit(v == "true"), "boolean")
    except (ValueError, InvalidOperation):
        pass
    return Value(boxed(LITERAL, F.lit(v), None, F.lit(dt)), "term", literal=node if dt == XSD + "dateTime" else None)


def moment(node: Literal | None) -> Column | None:
    """A constant dateTime as a native local time in UTC; None for anything else."""
    try:
        t = datetime.fromisoformat(node.value) if node is not None else None
    except ValueError:
        return None
    if t is None or "T" not in node.value:
        return None
    t = t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def null(type: str = "term") -> Value:
    kinds = {"term": TERM, "integer": "bigint", "decimal": DECIMAL, "float": "double", "double": "double", "boolean": "boolean", "dateTime": "timestamp_ntz"}
    return Value(F.lit(None).cast(kinds.get(type, "string")), type, lang=F.lit(None).cast("string") if type == "lang" else None)


def number(v: Value) -> Column:
    """The numeric value as a double; NULL for anything else."""
    if v.numeric:
        return v.col.cast("double")
    if v.type == "term":
        return F.when(v.col["dt"].isin(NUMERIC), v.col["lex"].try_cast("double"))
    return F.lit(None).cast("double")


def whole(v: Value) -> Column:
    """The value of an integer as a decimal without places; NULL for anything else."""
    if v.type == "integer":
        return v.col.cast(WHOLE)
    if v.type == "term":
        return F.when(v.col["dt"].isin(INTEGERS), v.col["lex"].try_cast(WHOLE))
    return F.lit(None).cast(WHOLE)


def exact(v: Value) -> Column:
    """The value of an integer or decimal as a decimal; NULL for anything else, and where 18 places leave no room."""
    if v.type in ("integer", "decimal"):
        return v.col.try_cast(DECIMAL)
    if v.type == "term":
        return F.when(v.col["dt"].isin([*INTEGERS, XSD + "decimal"]), v.col["lex"].try_cast(DECIMAL))
    return F.lit(None).cast(DECIMAL)


def instant(v: Value) -> Column:
    """A dateTime as a point in time; one without a zone counts as UTC. NULL for anything else."""
    if v.type == "dateTime":
        return v.col.cast("timestamp")
    if v.type == "term":
        return F.when(v.col["dt"] == XSD + "dateTime", F.try_to_timestamp(v.col["lex"]))
    return F.lit(None).cast("timestamp")


def text(v: Value) -> Column:
    """The value of a plain, string or language literal; NULL for anything else."""
    if v.type in ("string", "lang"):
        return v.col
    if v.type == "term":
        return F.when((v.col["kind"] == LITERAL) & v.col["dt"].isNull(), v.col["lex"])
    return F.lit(None).cast("string")


def language(v: Value) -> Column:
    if v.type == "lang":
        return v.lang
    return v.col["lang"] if v.type == "term" else F.lit(None).cast("string")


def ebv(v: Value) -> Column:
    """Effective boolean value; NULL is an error."""
    if v.type == "boolean":
        return v.col
    if v.numeric:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.type in ("string", "lang"):
        return v.col != ""
    if v.type == "term":
        n, c = number(v), v.col
        number_true = F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))
        return F.when(c["kind"] != LITERAL, F.lit(None)).when(c["dt"].isNull(), c["lex"] != "").when(c["dt"] == XSD + "boolean", c["lex"].isin("true", "1")).when(c["dt"].isin(NUMERIC), number_true)
    return F.lit(None).cast("boolean")


def as_boolean(v: Value) -> Column:
    if v.type == "boolean":
        return v.col
    if v.type == "term":
        return F.when(v.col["dt"] == XSD + "boolean", v.col["lex"].isin("true", "1"))
    return F.lit(None).cast("boolean")


def same_term(a: Value, b: Value) -> Column:
    if a.type == b.type and a.type != "lang" and (a.type != "iri" or a.template == b.template):
        return a.col == b.col
    if {a.type, b.type} == {"iri"}:
        a, b = (b, a) if a.template is None else (a, b)
        if a.template is not None and b.template is None:  # compare keys where the text allows it
            return a.lex() == b.lex()
        return F.lit(False) if not (a.template.startswith(b.template) or b.template.startswith(a.template)) else a.lex() == b.lex()
    if "term" not in (a.type, b.type) and a.type != b.type:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    return a.box() == b.box()  # a plain equality, so that joins can hash it; NULL fields inside a term are equal


def compare(a: Value, b: Value, op: str) -> Column:
    """= != < <= > >= by value; NULL is a type error."""
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    do = ops[op]
    if a.numeric and b.numeric:
        return do(a.col, b.col)
    if a.type == b.type and a.type in ("string", "boolean", "dateTime"):
        return do(a.col, b.col)
    for x, y, left in ((a, b, True), (b, a, False)):
        if x.type == "dateTime" and (t := moment(y.literal)) is not None:
            return do(x.col, t) if left else do(t, x.col)
    if op in ("=", "!=") and a.type != "term" and b.type != "term":
        if a.type == b.type == "lang":
            equal = (a.col == b.col) & (F.lower(a.lang) == F.lower(b.lang))
        else:
            equal = same_term(a, b)
        return equal if op == "=" else ~equal
    if a.type != "term" and b.type != "term":
        return F.lit(None).cast("boolean")
    na, nb, ta, tb, ba, bb = number(a), number(b), instant(a), instant(b), as_boolean(a), as_boolean(b)
    sa = F.when(language(a).isNull(), text(a))
    sb = F.when(language(b).isNull(), text(b))
    wa, wb, ea, eb = whole(a), whole(b), exact(a), exact(b)
    out = F.when(wa.isNotNull() & wb.isNotNull(), do(wa, wb)).when(ea.isNotNull() & eb.isNotNull(), do(ea, eb))
    out = out.when(na.isNotNull() & nb.isNotNull(), do(na, nb)).when(sa.isNotNull() & sb.isNotNull(), do(sa, sb))
    out = out.when(ta.isNotNull() & tb.isNotNull(), do(ta, tb)).when(ba.isNotNull() & bb.isNotNull(), do(ba, bb))
    if op in ("=", "!="):
        x, y = a.box(), b.box()
        alike = x["kind"].eqNullSafe(y["kind"]) & x["lex"].eqNullSafe(y["lex"]) & F.lower(x["lang"]).eqNullSafe(F.lower(y["lang"])) & x["dt"].eqNullSafe(y["dt"])
        # Literals of unknown types are only known to be equal if they are the same term.
        known = (x["kind"] != LITERAL) | (y["kind"] != LITERAL) | x["dt"].isNull() & y["dt"].isNull()
        out = out.when(x.isNull() | y.isNull(), F.lit(None)).when(alike, F.lit(op == "=")).when(known, F.lit(op == "!="))
    return out


def sort_key(v: Value) -> list[Column]:
    """Columns that sort unbound < blank < IRI < literal; numbers and dateTimes by value, then text."""
    if v.type == "iri" and v.template is not None:
        return [v.lex()]
    if v.type == "lang":
        return [v.col, v.lang]
    if v.type != "term":
        return [v.col]
    c = v.col
    return [c["kind"], number(v), instant(v), c["lex"], c["lang"], c["dt"]]
