"""N-Triples and N-Quads, distributed: text lines in and out, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlight import terms as T
from quadlight.storage import staged

_IRI = r"<([^<>\x22{}|^`\x00-\x20]*)>"
_BLANK = r"_:([A-Za-z0-9_·-�][\w.\-·-�]*)"
#: The closing quote is the first that no odd run of backslashes stands before. Without a repeated group: Java's regular
#: expressions recurse for each turn of one, and long literals would exhaust the stack.
_CLOSE = r"\x22(?<!(?<!\\)(?:\\\\){0,64}\\\x22)"
_LITERAL = rf"\x22([^\n\r]*?){_CLOSE}(?:\^\^<([^<>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
#: Groups: 1 subject IRI, 2 blank; 3 predicate; 4 object IRI, 5 blank, 6 literal, 7 type, 8 language; 9 graph IRI, 10 blank.
LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*(?:(?:{_IRI}|{_BLANK})\s*)?\.\s*(?:#.*)?$"


def _characters(code: Column) -> Column:
    """The character of a hexadecimal code point, from its UTF-8 bytes."""
    n = F.conv(code, 16, 10).cast("int")
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    tail = lambda shift: F.lit(0x80).bitwiseOR(F.shiftright(n, shift).bitwiseAND(0x3F))
    two = F.concat(byte(F.lit(0xC0).bitwiseOR(F.shiftright(n, 6))), byte(tail(0)))
    three = F.concat(byte(F.lit(0xE0).bitwiseOR(F.shiftright(n, 12))), byte(tail(6)), byte(tail(0)))
    four = F.concat(byte(F.lit(0xF0).bitwiseOR(F.shiftright(n, 18))), byte(tail(12)), byte(tail(6)), byte(tail(0)))
    coded = F.when(n < 0x80, byte(n)).when(n < 0x800, two).when(n < 0x10000, three).otherwise(four)
    return F.decode(F.unhex(coded), "UTF-8")


def unescape(c: Column) -> Column:
    r"""Undoes \t \n \r \b \f \" \' \\ \uXXXX and \UXXXXXXXX."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))

    def one(x: Column) -> Column:
        plain = F.translate(F.substring(x, 2, 1), "tnrbf", "\t\n\r\b\f")
        return F.when(~x.startswith("\\"), x).when(x.rlike("^\\\\[uU]."), _characters(F.substring(x, F.lit(3), F.length(x)))).otherwise(plain)

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def escape(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def parse_lines(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Quads (s, p, o, g) of N-Triples or N-Quads lines. Empty lines and comments are skipped; a line that does not
    parse fails the job, or with ``strict`` off is skipped too. Labels of blank nodes are kept."""
    line = F.col(column)
    found = lines.where(line.isNotNull() & ~line.rlike(r"^\s*(#.*)?$"))
    g = lambda i: F.regexp_extract(line, LINE, i)
    fits = line.rlike(LINE)
    found = found.where(fits) if not strict else found.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), line)).cast("boolean")))
    groups = F.array(*[g(i) for i in range(1, 11)])
    found = found.select(groups.alias("m"), line.rlike(r"^\s*_:").alias("sb"), line.rlike(r"\s_:[^\s]+\s*(<[^>]*>\s*|_:[^\s]+\s*)?\.\s*(#.*)?$").alias("ob"), F.col(column).rlike(rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*\x22").alias("ol"))
    m = lambda i: F.col("m")[i - 1]
    iri = lambda c: T.boxed(T.IRI, unescape(c))
    s = F.when(F.col("sb"), T.boxed(T.BLANK, m(2))).otherwise(iri(m(1)))
    lang = F.when(m(8) != "", F.lower(m(8)))
    dt = F.when((m(7) != "") & (m(7) != T.XSD + "string"), unescape(m(7)))
    o = F.when(F.col("ol"), T.boxed(T.LITERAL, unescape(m(6)), lang, dt)).when(m(5) != "", T.boxed(T.BLANK, m(5))).otherwise(iri(m(4)))
    graph = F.when(m(9) != "", unescape(m(9))).when(m(10) != "", F.concat(F.lit("_:"), m(10)))
    return found.select(s.cast(T.TERM).alias("s"), iri(m(3)).cast(T.TERM).alias("p"), o.cast(T.TERM).alias("o"), graph.alias("g"))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_lines(spark.read.text(path), "value", strict)


def term_text(c: Column) -> Column:
    """A boxed term as it stands in N-Triples."""
    literal = F.concat(F.lit('"'), escape(c["lex"]), F.lit('"'), F.coalesce(F.concat(F.lit("@"), c["lang"]), F.concat(F.lit("^^<"), c["dt"], F.lit(">")), F.lit("")))
    return F.when(c["kind"] == T.IRI, F.concat(F.lit("<"), c["lex"], F.lit(">"))).when(c["kind"] == T.BLANK, F.concat(F.lit("_:"), c["lex"])).otherwise(literal)


def lines(quads: DataFrame, graphs: bool = True) -> DataFrame:
    """One column ``value``: a statement a row."""
    parts = [term_text(F.col(c)) for c in ("s", "p", "o")]
    if graphs and "g" in quads.columns:
        named = F.when(F.col("g").startswith("_:"), F.col("g")).otherwise(F.concat(F.lit("<"), F.col("g"), F.lit(">")))
        parts.append(named)
    return quads.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str, graphs: bool = True, mode: str = "errorifexists") -> None:
    lines(quads, graphs).write.mode(mode).text(path)


#: What ``canonical`` does with blank nodes that it cannot tell apart.
ON_FAIL = ("keep", "truncate", "append", "space", "die")


def canonical(quads: DataFrame, onfail: str = "keep", most_rounds: int = 50) -> DataFrame:
    """Statements with blank nodes renamed by what is said about them, sorted: equal graphs give equal lines.

    A blank node's name is a hash of the statements around it, in which other blank nodes stand under their own names of
    the round before; rounds follow until no more names come apart. Nodes that still share a name are told apart by
    nothing but their labels. ``onfail``: keep numbers these by their labels, append puts their statements behind all
    others, space does so behind an empty line, truncate leaves them out, die raises.
    """
    if onfail not in ON_FAIL:
        raise ValueError(f"onfail is one of {', '.join(ON_FAIL)}")
    df = quads.select("s", "p", "o", *(["g"] if "g" in quads.columns else [])).distinct()
    label = lambda c: F.when(F.col(f"{c}.kind") == T.BLANK, F.col(f"{c}.lex"))
    both = F.explode(F.array(F.struct(label("s").alias("label")), F.struct(label("o").alias("label"))))
    names = staged(df.select(both.alias("x")).select("x.label").where("label is not null").distinct().withColumn("name", F.lit("")), "blank-names")
    count = 1
    for _ in range(most_rounds):
        told = _named(df, names)
        text = lambda c, me: F.when(F.lit(c == me), "~").when(F.col(f"{c}.kind") == T.BLANK, F.concat(F.lit("_:"), f"{c}_name")).otherwise(term_text(F.col(c)))
        graph = [F.coalesce(F.col("g"), F.lit(""))] if "g" in df.columns else []
        around = [told.where(F.col(f"{me}.kind") == T.BLANK).select(F.col(f"{me}.lex").alias("label"), F.concat_ws(" ", F.lit(me), text("s", me), term_text(F.col("p")), text("o", me), F.when(label("s") == label("o"), "=").otherwise(""), *graph).alias("said")) for me in ("s", "o")]
        hashes = F.transform(F.array_sort(F.collect_list(F.md5("said"))), lambda x: x)
        own = around[0].union(around[1]).groupBy("label").agg(F.concat(F.lit("c14n"), F.substring(F.md5(F.array_join(hashes, "")), 1, 16)).alias("now"))
        renamed = own.join(names, "label").select("label", F.concat(F.lit("c14n"), F.substring(F.md5(F.concat("name", "now")), 1, 16)).alias("name"))
        names = staged(renamed, "blank-names")
        before, count = count, names.select("name").distinct().count()
        if count == before:
            break
    alike = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("label")).alias("labels")).where("n > 1")
    if onfail == "die" and not alike.isEmpty():
        raise ValueError("the graph has blank nodes that nothing tells apart")
    numbered = alike.select(F.posexplode("labels").alias("k", "label"), F.lit(True).alias("doubtful"))
    names = names.join(numbered, "label", "left").select("label", F.when(F.col("k") > 0, F.concat("name", F.lit("x"), "k")).otherwise(F.col("name")).alias("name"), F.coalesce("doubtful", F.lit(False)).alias("doubtful"))
    told = _named(df, names, ["doubtful"])
    for c in ("s", "o"):
        told = told.withColumn(c, F.when(F.col(f"{c}.kind") == T.BLANK, T.boxed(T.BLANK, F.col(f"{c}_name"))).otherwise(F.col(c)).cast(T.TERM))
    late = F.coalesce("s_doubtful", F.lit(False)) | F.coalesce("o_doubtful", F.lit(False))
    if onfail == "truncate":
        return lines(told.where(~late).select(*df.columns)).orderBy("value")
    if onfail == "keep":
        return lines(told.select(*df.columns)).orderBy("value")
    parts = [lines(told.where(test).select(*df.columns)).withColumn("_k", F.lit(k)) for k, test in ((0, ~late), (2, late))]
    out = parts[0].union(parts[1])
    if onfail == "space":
        out = out.union(numbered.limit(1).select(F.lit("").alias("value"), F.lit(1).alias("_k")))
    return out.orderBy("_k", "value").select("value")


def _named(df: DataFrame, names: DataFrame, more: list[str] | None = None) -> DataFrame:
    """``df`` with the names of blank subjects and objects (s_name, o_name) beside them."""
    for c in ("s", "o"):
        own = names.select(F.col("label").alias("_l"), F.col("name").alias(f"{c}_name"), *[F.col(m).alias(f"{c}_{m}") for m in more or []])
        df = df.join(own, (F.col(f"{c}.kind") == T.BLANK) & (F.col(f"{c}.lex") == F.col("_l")), "left").drop("_l")
    return df
