"""SPARQL 1.1 Query and Update: text to algebra."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from quadlight.plans import algebra as A
from quadlight.terms import RDF, XSD, Iri, Literal, Node, Var

TOKEN = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n]*)+)
  |(?P<iri><[^<>"{}|^`\\\s]*>)
  |(?P<string>\"{3}(?:(?:"|"")?(?:[^"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<number>(?:[0-9]+\.[0-9]*|\.?[0-9]+)[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+)
  |(?P<blank>_:[\w][\w.\-]*(?<!\.))
  |(?P<var>[?$]\w+)
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<pname>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:%]|\\[-_~.!$&'()*+,;=/?\#@%])(?:(?:[\w:.%\-]|\\[-_~.!$&'()*+,;=/?\#@%])*(?:[\w:%\-]|\\[-_~.!$&'()*+,;=/?\#@%]))?)?)
  |(?P<word>[A-Za-z_]\w*)
  |(?P<op>\^\^|&&|\|\||!=|<=|>=|=~|!~|[{}()\[\].,;/|^*+?!=<>\-~])""",
    re.X | re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = {"count", "sum", "min", "max", "avg", "sample", "group_concat"}
#: Built-in functions with the numbers of arguments they take.
BUILT_IN = {
    **dict.fromkeys("str lang datatype iri uri abs ceil floor round strlen ucase lcase encode_for_uri year month day hours minutes seconds timezone tz md5 sha1 sha224 sha256 sha384 sha512 isiri isuri isblank isliteral isnumeric".split(), (1, 1)),
    **dict.fromkeys("langmatches contains strstarts strends strbefore strafter strlang strdt sameterm".split(), (2, 2)),
    **dict.fromkeys("rand now uuid struuid".split(), (0, 0)),
    "bnode": (0, 1),
    "bound": (1, 1),
    "if": (3, 3),
    "regex": (2, 3),
    "substr": (2, 3),
    "replace": (3, 4),
    "concat": (0, None),
    "coalesce": (0, None),
}


class SparqlError(ValueError):
    """A query that is malformed or breaks a rule of the language."""


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        s = m[0]
        if s[1] in "uU":
            return chr(int(s[2:], 16))
        if s[1] not in ESCAPES:
            raise SparqlError(f"unknown escape {s}")
        return ESCAPES[s[1]]

    return re.sub(r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


class Parser:
    def __init__(self, text: str, base: str = "", update: bool = False, prefixes: dict[str, str] | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected text at {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.allowed = 0, base, update
        self.prefixes = dict(prefixes or {})
        self.fresh = 0
        self.labels: dict[str, Var] = {}

    # Tokens

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def is_op(self, *ops: str) -> bool:
        kind, s = self.peek()
        return kind == "op" and s in ops

    def op(self, *ops: str) -> bool:
        if self.is_op(*ops):
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.op(op):
            raise SparqlError(f"expected {op!r}, found {self.peek()[1]!r}")

    def is_word(self, *words: str) -> bool:
        kind, s = self.peek()
        return kind == "word" and s.lower() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise SparqlError(f"expected {words[0].upper()}, found {self.peek()[1]!r}")

    def new_var(self, hint: str = "p") -> Var:
        self.fresh += 1
        return Var(f"_:{hint}{self.fresh}")

    # Terms

    def resolve(self, iri: str) -> str:
        return urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) else iri

    def iri(self) -> Iri:
        kind, s = self.next()
        if kind == "iri":
            return Iri(self.resolve(unescape(s[1:-1])))
        if kind == "pname":
            prefix, _, local = s.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix}:")
            return Iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise SparqlError(f"expected an IRI, found {s!r}")

    def is_iri(self) -> bool:
        return self.peek()[0] in ("iri", "pname")

    def var(self) -> Var:
        kind, s = self.next()
        if kind != "var":
            raise SparqlError(f"expected a variable, found {s!r}")
        return Var(s[1:])

    def literal(self) -> Literal:
        kind, s = self.next()
        if kind == "string":
            n = 3 if s[:3] in ('"""', "'''") and len(s) >= 6 else 1
            value = unescape(s[n:-n])
            if self.peek()[0] == "lang":
                return Literal(value, lang=self.next()[1][1:])
            if self.op("^^"):
                return Literal(value, dt=self.iri().value)
            return Literal(value)
        sign = ""
        if kind == "op" and s in "+-" and self.peek()[0] == "number":
            sign, (kind, s) = s, self.next()
        if kind == "number":
            dt = "double" if re.search("[eE]", s) else "decimal" if "." in s else "integer"
            return Literal(sign.replace("+", "") + s, dt=XSD + dt)
        if kind == "word" and s.lower() in ("true", "false"):
            return Literal(s.lower(), dt=XSD + "boolean")
        raise SparqlError(f"expected a term, found {s!r}")

    def term(self, variables: bool = True) -> Node:
        kind, s = self.peek()
        if kind == "var":
            if not variables:
                raise SparqlError("no variable may stand here")
            return self.var()
        if kind in ("iri", "pname"):
            return self.iri()
        if kind == "blank":
            self.at += 1
            return self.blank(s[2:])
        return self.literal()

    def blank(self, label: str) -> Node:
        return self.labels.setdefault(label, Var(f"_:b_{label}"))

    # Queries

    def prologue(self) -> None:
        while True:
            if self.word("base"):
                self.base = self.resolve(unescape(self.next()[1][1:-1]))
            elif self.word("prefix"):
                name = self.next()[1]
                if not name.endswith(":"):
                    raise SparqlError(f"bad prefix {name!r}")
                self.prefixes[name[:-1]] = self.iri().value
            else:
                return

    def query(self) -> A.Query:
        self.prologue()
        if self.is_word("select"):
            q = self.select()
        elif self.word("construct"):
            q = self.construct()
        elif self.word("ask"):
            q = A.Query("ask", None)
            self.dataset(q)
            self.word("where")
            q.where = self.group()
            self.modifiers(q)
        elif self.word("describe"):
            q = A.Query("describe", A.Bgp([]))
            while not self.op("*") and (self.peek()[0] == "var" or self.is_iri()):
                q.targets.append(self.term())
            self.dataset(q)
            if self.word("where") or self.is_op("{"):
                q.where = self.group()
            q.targets = q.targets or [Var(v) for v in sorted(A.variables(q.where)) if not v.startswith("_:")]
            self.modifiers(q)
        else:
            raise SparqlError(f"expected a query, found {self.peek()[1]!r}")
        self.values(q)
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r} after the query")
        q.base = self.base
        return q

    def dataset(self, q) -> None:
        while self.word("from"):
            (q.named_graphs if self.word("named") else q.default_graphs).append(self.iri().value)

    def values(self, q: A.Query) -> None:
        """Trailing VALUES join the rows of the pattern, or of the groups."""
        if self.word("values"):
            if q.group is not None or A.has_aggregate([e for _, e in q.items]):
                q.trailing = self.table()
            else:
                q.where = A.Join(q.where, self.table())

    def select(self) -> A.Query:
        self.need_word("select")
        q = A.Query("select", None)
        q.distinct = self.word("distinct")
        if not q.distinct:
            self.word("reduced")
        if not self.op("*"):
            while self.peek()[0] == "var" or self.is_op("("):
                if self.op("("):
                    e = self.expression()
                    self.need_word("as")
                    q.items.append((self.var().name, e))
                    self.need(")")
                else:
                    q.items.append((self.var().name, None))
            if not q.items:
                raise SparqlError("SELECT without variables")
        self.dataset(q)
        self.word("where")
        q.where = self.group()
        self.modifiers(q)
        self.check_projection(q)
        return q

    def check_projection(self, q: A.Query) -> None:
        names = [n for n, _ in q.items]
        if len(set(names)) < len(names):
            raise SparqlError("a variable is selected twice")
        bound = A.variables(q.where)
        if clash := [n for n, e in q.items if e is not None and n in bound]:
            raise SparqlError(f"?{clash[0]} is bound already")
        if q.group is None and not A.has_aggregate([[e for _, e in q.items], q.having, [e for _, e in q.order]]):
            return
        if not q.items:
            raise SparqlError("SELECT * with GROUP BY")
        known = {n for e, n in q.group or [] if n} | {e.name for e, n in q.group or [] if isinstance(e, Var)}
        for name, e in q.items:
            for v in self.loose(e if e is not None else Var(name)) - known:
                raise SparqlError(f"?{v} is neither grouped nor aggregated")
            known.add(name)

    def loose(self, e) -> set[str]:
        """Variables outside aggregates."""
        if isinstance(e, Var):
            return {e.name}
        if isinstance(e, tuple):
            return set() if e[0] in ("agg", "exists") else set().union(set(), *(self.loose(x) for x in e[1:]))
        return set().union(set(), *(self.loose(x) for x in e)) if isinstance(e, list) else set()

    def modifiers(self, q: A.Query) -> None:
        if self.word("group"):
            self.need_word("by")
            q.group = []
            while True:
                if self.op("("):
                    e = self.expression()
                    q.group.append((e, self.var().name if self.word("as") else None))
                    self.need(")")
                elif self.peek()[0] == "var":
                    q.group.append((self.var(), None))
                elif self.is_iri() or self.peek()[0] == "word" and self.peek()[1].lower() in BUILT_IN:
                    q.group.append((self.primary(), None))
                else:
                    break
            if not q.group:
                raise SparqlError("empty GROUP BY")
        if self.word("having"):
            while self.is_op("(") or self.is_iri() or self.peek()[0] == "word" and self.peek()[1].lower() in (*BUILT_IN, *AGGREGATES):
                q.having.append(self.primary())
        if self.word("order"):
            self.need_word("by")
            while True:
                if self.is_word("asc", "desc"):
                    up = self.next()[1].lower() == "asc"
                    q.order.append((up, self.primary()))
                elif self.peek()[0] == "var" or self.is_op("(") or self.is_iri() or self.peek()[0] == "word" and self.peek()[1].lower() in (*BUILT_IN, *AGGREGATES):
                    q.order.append((True, self.primary()))
                else:
                    break
            if not q.order:
                raise SparqlError("empty ORDER BY")
        while self.is_word("limit", "offset"):
            word, (kind, n) = self.next()[1].lower(), self.next()
            if kind != "number" or not n.isdigit():
                raise SparqlError(f"{word.upper()} needs a number")
            setattr(q, word, int(n))

    def construct(self) -> A.Query:
        q = A.Query("construct", None)
        if self.is_op("{"):
            q.template = self.template()
            self.dataset(q)
            self.word("where")
            q.where = self.group()
        else:
            self.dataset(q)
            self.need_word("where")
            q.template = self.template()
            q.where = A.Bgp(list(q.template))
        self.modifiers(q)
        return q

    def template(self) -> list:
        self.need("{")
        triples: list = []
        while not self.op("}"):
            self.triples(triples, paths=False)
            if not self.op("."):
                self.need("}")
                break
        return triples

    def table(self) -> A.Table:
        if self.peek()[0] == "var":
            names, single = [self.var().name], True
        else:
            self.need("(")
            names, single = [], False
            while not self.op(")"):
                names.append(self.var().name)
        self.need("{")
        rows = []
        while not self.op("}"):
            if single:
                rows.append([None if self.word("undef") else self.term(False)])
                continue
            self.need("(")
            row = []
            while not self.op(")"):
                row.append(None if self.word("undef") else self.term(False))
            if len(row) != len(names):
                raise SparqlError("a VALUES row of another length")
            rows.append(row)
        return A.Table(names, rows)

    # Patterns

    def group(self):
        self.need("{")
        if self.is_word("select"):
            q = self.select()
            self.values(q)
            self.need("}")
            return A.SubSelect(q)
        out, filters = A.Bgp([]), []
        join = lambda a, b: b if isinstance(a, A.Bgp) and not a.triples else A.Bgp(a.triples + b.triples) if isinstance(a, A.Bgp) and isinstance(b, A.Bgp) else A.Join(a, b)
        while not self.op("}"):
            if self.word("optional"):
                right = self.group()
                condition = None
                if isinstance(right, A.Filter):  # it may speak of the left side
                    condition, right = right.expr, right.pattern
                out = A.LeftJoin(out, right, condition)
            elif self.word("minus"):
                out = A.Minus(out, self.group())
            elif self.word("graph"):
                name = self.term()
                out = join(out, A.Graph(name, self.group()))
            elif self.word("service"):
                silent = self.word("silent")
                endpoint = self.term()
                out = join(out, A.Service(endpoint, self.group(), silent))
            elif self.word("filter"):
                filters.append(self.primary())
            elif self.word("bind"):
                self.need("(")
                e = self.expression()
                self.need_word("as")
                name = self.var().name
                self.need(")")
                if name in A.variables(out):
                    raise SparqlError(f"BIND to ?{name}, which is bound already")
                out = A.Extend(out, name, e)
            elif self.word("values"):
                out = join(out, self.table())
            elif self.is_op("{"):
                parts = [self.group()]
                while self.word("union"):
                    parts.append(self.group())
                out = join(out, parts[0] if len(parts) == 1 else A.Union(parts))
            else:
                triples: list = []
                self.triples(triples)
                plain = A.Bgp([t for t in triples if isinstance(t, tuple)])
                if plain.triples:
                    out = join(out, plain)
                for p in triples:
                    if isinstance(p, A.PathPattern):
                        out = join(out, p)
            self.op(".")
        for e in filters:
            out = A.Filter(out, e)
        if len(filters) > 1:  # one condition, so that OPTIONAL can take it as a whole
            pattern, every = out, []
            while isinstance(pattern, A.Filter) and len(every) < len(filters):
                every.append(pattern.expr)
                pattern = pattern.pattern
            out = A.Filter(pattern, ("and", *reversed(every)))
        return out

    def triples(self, out: list, paths: bool = True) -> None:
        if self.is_op("(") or self.is_op("["):
            bare = self.is_op("[")
            subject = self.node(out, paths)
            if bare and (self.is_op(".", "}") or self.peek()[0] == "end"):
                return
        else:
            subject = self.term()
        self.properties(subject, out, paths)

    def properties(self, subject: Node, out: list, paths: bool) -> None:
        while True:
            if self.peek()[0] == "var":
                verb = self.var()
            elif paths:
                verb = self.path()
            elif self.word("a"):
                verb = Iri(RDF + "type")
            else:
                verb = self.iri()
            while True:
                self.add(subject, verb, self.node(out, paths), out)
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.is_op(".", "}", "]"):
                return

    def add(self, s: Node, verb, o: Node, out: list) -> None:
        """Simple paths become triples."""
        if isinstance(verb, (Var, Iri)):
            out.append((s, verb, o))
        elif verb[0] == "iri":
            out.append((s, Iri(verb[1]), o))
        elif verb[0] == "inv":
            self.add(o, verb[1], s, out)
        elif verb[0] == "seq":
            middle = self.new_var()
            self.add(s, verb[1], middle, out)
            self.add(middle, verb[2], o, out)
        else:
            out.append(A.PathPattern(s, verb, o))

    def node(self, out: list, paths: bool) -> Node:
        if self.op("["):
            b = self.new_var("n")
            if not self.op("]"):
                self.properties(b, out, paths)
                self.need("]")
            return b
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node(out, paths))
            head: Node = Iri(RDF + "nil")
            for item in reversed(items):
                cell = self.new_var("l")
                out.append((cell, Iri(RDF + "first"), item))
                out.append((cell, Iri(RDF + "rest"), head))
                head = cell
            return head
        return self.term()

    # Paths

    def path(self):
        out = self.path_sequence()
        while self.op("|"):
            out = ("alt", out, self.path_sequence())
        return out

    def path_sequence(self):
        parts = [self.path_step()]
        while self.op("/"):
            parts.append(self.path_step())
        out = parts[-1]
        for p in reversed(parts[:-1]):
            out = ("seq", p, out)
        return out

    def path_step(self):
        if self.op("^"):
            return ("inv", self.path_step())
        if self.op("!"):
            return self.path_modifier(self.negated())
        if self.op("("):
            p = self.path()
            self.need(")")
        else:
            p = ("iri", RDF + "type") if self.word("a") else ("iri", self.iri().value)
        return self.path_modifier(p)

    def path_modifier(self, p):
        if self.op("*"):
            return ("star", p)
        if self.op("+"):
            return ("plus", p)
        if self.op("?"):
            return ("opt", p)
        return p

    def negated(self):
        forward, inverse = [], []

        def one() -> None:
            to = inverse if self.op("^") else forward
            to.append(RDF + "type" if self.word("a") else self.iri().value)

        if self.op("("):
            while not self.op(")"):
                one()
                self.op("|")
        else:
            one()
        return ("not", forward, inverse)

    # Expressions

    def expression(self):
        parts = [self.conjunction()]
        while self.op("||"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def conjunction(self):
        parts = [self.relation()]
        while self.op("&&"):
            parts.append(self.relation())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def relation(self):
        left = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.op(op):
                return (op, left, self.sum())
        negated = self.is_word("not") and self.peek(1)[1].lower() == "in"
        if negated or self.is_word("in"):
            self.at += 1 + negated
            return ("not_in" if negated else "in", left, self.arguments())
        return left

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expression())
            if not self.is_op(")"):
                self.need(",")
        return out

    def sum(self):
        left = self.product()
        while self.is_op("+", "-"):
            op = self.next()[1]
            left = (op, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.is_op("*", "/"):
            op = self.next()[1]
            left = (op, left, self.unary())
        return left

    def unary(self):
        if self.op("!"):
            return ("not", self.unary())
        if self.op("+"):
            return ("plus", self.unary())
        if self.op("-"):
            return ("minus", self.unary())
        return self.primary()

    def primary(self):
        kind, s = self.peek()
        if self.op("("):
            e = self.expression()
            self.need(")")
            return e
        if kind == "word":
            name = s.lower()
            if name in ("true", "false"):
                return self.literal()
            self.at += 1
            if name == "not":
                self.need_word("exists")
                return ("not", ("exists", self.group()))
            if name == "exists":
                return ("exists", self.group())
            if name in AGGREGATES:
                return self.aggregate(name)
            if name not in BUILT_IN:
                raise SparqlError(f"unknown function {s}")
            args = self.arguments()
            low, high = BUILT_IN[name]
            if len(args) < low or high is not None and len(args) > high:
                raise SparqlError(f"{s} does not take {len(args)} arguments")
            if name == "bound" and not isinstance(args[0], Var):
                raise SparqlError("BOUND takes a variable")
            return (name, *args)
        if kind in ("iri", "pname"):
            iri = self.iri()
            if self.is_op("("):
                distinct = self.peek(1)[1].lower() == "distinct"
                if distinct:
                    del self.tokens[self.at + 1]
                return ("call", iri.value, self.arguments(), distinct)
            return iri
        if kind == "blank":
            raise SparqlError("no blank node may stand here")
        return self.term()

    def aggregate(self, name: str):
        self.need("(")
        distinct = self.word("distinct")
        args, separator = [], " "
        if name == "count" and self.op("*"):
            args = []
        else:
            args.append(self.expression())
            while self.op(","):
                args.append(self.expression())
        if self.op(";"):
            self.need_word("separator")
            self.need("=")
            separator = self.literal().value
        self.need(")")
        return ("agg", name, args, distinct, separator)

    # Updates

    def update(self) -> list[A.Update]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                break
            self.labels = {}
            op = self.one_update()
            op.base = self.base
            out.append(op)
            if not self.op(";"):
                break
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r} after the update")
        if out and not self.allowed:
            raise SparqlError("updates are not allowed here")
        return out

    def one_update(self) -> A.Update:
        if self.word("load"):
            u = A.Update("load", silent=self.word("silent"))
            u.url = self.iri().value
            if self.word("into"):
                self.need_word("graph")
                u.graph = self.iri()
            return u
        if self.is_word("clear", "drop", "create"):
            kind = self.next()[1].lower()
            u = A.Update("create" if kind == "create" else "clear", silent=self.word("silent"))
            u.graph = self.graph_ref(everything=True)
            return u
        if self.is_word("copy", "move", "add"):
            u = A.Update(self.next()[1].lower(), silent=self.word("silent"))
            u.graph = self.graph_ref()
            self.need_word("to")
            u.target = self.graph_ref()
            return u
        u = A.Update("modify", where=A.Bgp([]))
        graph = self.iri() if self.word("with") else None
        if self.word("insert"):
            if self.word("data"):
                u.insert = self.quads(None, data=True)
                return u
            u.insert = self.quads(graph)
        elif self.word("delete"):
            if self.word("data"):
                u.delete = self.quads(None, data=True, blanks=False)
                return u
            if self.word("where"):
                u.delete = self.quads(graph, blanks=False)
                plain = [(s, p, o) for s, p, o, g in u.delete if g is None]
                u.where = A.Bgp(plain)
                for s, p, o, g in u.delete:
                    if g is not None:
                        u.where = A.Join(u.where, A.Graph(g, A.Bgp([(s, p, o)])))
                return u
            u.delete = self.quads(graph, blanks=False)
            if self.word("insert"):
                u.insert = self.quads(graph)
        else:
            raise SparqlError(f"expected an update, found {self.peek()[1]!r}")
        while self.word("using"):
            (u.named_graphs if self.word("named") else u.default_graphs).append(self.iri().value)
        self.need_word("where")
        self.labels = {}
        u.where = self.group()
        if graph is not None and not u.default_graphs and not u.named_graphs:
            u.where = A.Graph(graph, u.where)
        return u

    def graph_ref(self, everything: bool = False):
        if self.is_word("default") or everything and self.is_word("named", "all"):
            return self.next()[1].lower()
        self.word("graph")
        return self.iri()

    def quads(self, graph: Node | None, data: bool = False, blanks: bool = True) -> list:
        self.need("{")
        out: list = []
        while not self.op("}"):
            triples: list = []
            if self.word("graph"):
                name = self.term(variables=not data)
                triples = self.template()
                out += [(*t, name) for t in triples]
            else:
                self.triples(triples, paths=False)
                out += [(*t, graph) for t in triples]
            self.op(".")
        for quad in out:
            for n in quad:
                if isinstance(n, Var) and data and not n.name.startswith("_:"):
                    raise SparqlError("no variable may stand in DATA")
                if isinstance(n, Var) and n.name.startswith("_:") and not blanks:
                    raise SparqlError("no blank node may stand in a DELETE template")
        return out


def parse_query(text: str, base: str = "", prefixes: dict[str, str] | None = None) -> A.Query:
    return Parser(text, base, prefixes=prefixes).query()


def parse_update(text: str, base: str = "", prefixes: dict[str, str] | None = None, allow: bool = True) -> list[A.Update]:
    return Parser(text, base, allow, prefixes).update()
