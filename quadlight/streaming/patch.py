"""RDF Patch: change rows, their text, and a change feed merged into quads by Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadlight import terms as T
from quadlight.sources import ntriples
from quadlight.sources.dataset import QUAD
from quadlight.storage import staged

CHANGE = f"seq long, op string, {QUAD}"


def parse_text(spark: SparkSession, text: str) -> DataFrame:
    """Change rows (seq, op, s, p, o, g) of a patch document. Lines are A or D and a statement, or Q and a pattern, in
    which U is any term; @prefix lines declare prefixes; R stands for the same term as on the line before."""
    from quadlight.plans.parser import Parser

    rows, last = [], [None, None, None, None]
    p = Parser(text)
    n = 0
    while p.peek()[0] != "end":
        if p.peek() == ("lang", "@prefix"):
            p.next()
            name = p.next()[1]
            p.prefixes[name[:-1]] = p.iri().value
            p.need(".")
            continue
        op = p.next()[1].upper()
        if op not in ("A", "ADD", "D", "DELETE", "Q", "QUERY"):
            raise ValueError(f"unknown patch operation {op}")
        parts = []
        while not p.op("."):
            if p.word("r"):
                parts.append(last[len(parts)])
            elif p.word("u"):
                parts.append(None)
            else:
                parts.append(p.term())
        last = parts + [None] * (4 - len(parts))
        if None in parts and op[0] != "Q":
            raise ValueError("U may only stand in a query")
        n += 1
        rows.append((n, op[0], *map(_box, parts[:3]), parts[3].value if len(parts) > 3 and parts[3] is not None else None))
    return spark.createDataFrame(rows, CHANGE)


def _box(n) -> tuple | None:
    if n is None:
        return None
    if isinstance(n, T.Iri):
        return (T.IRI, n.value, None, None)
    if isinstance(n, T.Literal):
        return (T.LITERAL, n.value, n.lang.lower() if n.lang else None, None if n.dt == T.XSD + "string" else n.dt)
    return (T.BLANK, n.name.removeprefix("_:b_"), None, None)


def parse_lines(lines: DataFrame, column: str = "value", seq: str = "seq") -> DataFrame:
    """Change rows of lines ``A`` or ``D`` and an N-Quads statement; works on streams too."""
    op = F.upper(F.substring(F.trim(F.col(column)), 1, 1))
    rest = F.regexp_replace(F.col(column), r"^\s*(?i:add|delete|a|d)\s+", "")
    kept = lines.where(F.col(column).rlike(r"^\s*(?i:a|d|add|delete)\s")).withColumns({"_op": op, "_line": rest})
    return _with_statement(kept.select(F.col(seq).cast("long").alias("seq"), "_op", "_line"))


def _with_statement(df: DataFrame) -> DataFrame:
    m = lambda i: F.regexp_extract("_line", ntriples.LINE, i)
    iri = lambda c: T.boxed(T.IRI, ntriples.unescape(c))
    s = F.when(m(2) != "", T.boxed(T.BLANK, m(2))).otherwise(iri(m(1)))
    is_text = F.col("_line").rlike(rf"^\s*(?:{ntriples._IRI}|{ntriples._BLANK})\s*{ntriples._IRI}\s*\x22")
    text = T.boxed(T.LITERAL, ntriples.unescape(m(6)), F.when(m(8) != "", F.lower(m(8))), F.when((m(7) != "") & (m(7) != T.XSD + "string"), m(7)))
    o = F.when(is_text, text).when(m(5) != "", T.boxed(T.BLANK, m(5))).otherwise(iri(m(4)))
    g = F.when(m(9) != "", ntriples.unescape(m(9)))
    return df.where(F.col("_line").rlike(ntriples.LINE)).select("seq", F.col("_op").alias("op"), s.cast(T.TERM).alias("s"), iri(m(3)).cast(T.TERM).alias("p"), o.cast(T.TERM).alias("o"), g.alias("g"))


def lines(changes: DataFrame) -> DataFrame:
    parts = [ntriples.term_text(F.col(c)) for c in ("s", "p", "o")]
    return changes.orderBy("seq").select(F.concat(F.concat_ws(" ", F.col("op"), *parts, F.concat(F.lit("<"), F.col("g"), F.lit(">"))), F.lit(" .")).alias("value"))


def last_change(changes: DataFrame) -> DataFrame:
    """The change of each quad that decides: the last by ``seq``. Queries change nothing."""
    changes = changes.where("op <> 'Q'")
    w = Window.partitionBy("s", "p", "o", "g").orderBy(F.col("seq").desc(), F.col("op"))
    return changes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def apply(quads: DataFrame, changes: DataFrame) -> DataFrame:
    """The quads after the changes, each quad as its last change says."""
    last = last_change(changes)
    same = [quads[c].eqNullSafe(last[c]) if c == "g" else quads[c] == last[c] for c in ("s", "p", "o", "g")]
    kept = quads.join(last, reduce(lambda a, b: a & b, same), "left_anti")
    return kept.union(last.where("op = 'A'").select("s", "p", "o", "g")).distinct()


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that turn one set of quads into another."""
    gone = before.distinct().exceptAll(after.distinct()).select(F.lit("D").alias("op"), "s", "p", "o", "g")
    new = after.distinct().exceptAll(before.distinct()).select(F.lit("A").alias("op"), "s", "p", "o", "g")
    return gone.union(new).select(F.lit(0).cast("long").alias("seq"), "*")


def answers(quads: DataFrame, changes: DataFrame) -> DataFrame:
    """(seq, s, p, o, g): the quads that match each query of a patch; a part without a term, the graph included, matches
    any. Queries with the same parts given are one join on these parts."""
    asked = changes.where("op = 'Q'")
    given = F.concat(*[F.when(F.col(c).isNotNull(), c).otherwise("") for c in ("s", "p", "o", "g")])
    found = quads.select(F.lit(None).cast("long").alias("seq"), "s", "p", "o", "g").where(F.lit(False))
    for (parts,) in asked.select(given).distinct().collect():  # 16 at most
        like = asked.where(given == parts).select("seq", *[F.col(c).alias(f"_{c}") for c in parts])
        same = [F.col(c) == F.col(f"_{c}") for c in parts]
        hit = quads.join(like, reduce(lambda a, b: a & b, same)) if same else quads.crossJoin(like)
        found = found.union(hit.select("seq", "s", "p", "o", "g"))
    return found


class PatchFeed:
    """Merges a stream of change rows into a quads snapshot, one micro-batch after another."""

    def __init__(self, quads: DataFrame):
        self.quads = staged(quads, "feed")
        self.done = -1

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done:  # a batch that is run again
            return
        self.quads = staged(apply(self.quads, batch), "feed")
        self.done = batch_id

    def start(self, changes: DataFrame, checkpoint: str):
        """Starts the stream; ``changes`` is a streaming frame of change rows."""
        return changes.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
