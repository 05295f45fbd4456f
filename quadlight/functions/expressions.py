"""SPARQL expressions as columns. Errors are NULL; static types are kept wherever the arguments have them."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadlight import terms as T
from quadlight.plans.algebra import PathPattern
from quadlight.plans.parser import SparqlError
from quadlight.terms import BLANK, IRI, LITERAL, XSD, Value, Var

#: User functions: IRI -> function of values giving a value.
REGISTRY: dict[str, Callable[..., Value]] = {}


def register(iri: str, function: Callable[..., Value]) -> None:
    """Makes ``function(*values) -> Value`` callable by its IRI in every query."""
    REGISTRY[iri] = function


@dataclass
class Scope:
    """What an expression can see."""

    values: dict[str, Value]
    base: str = ""
    functions: dict[str, Callable[..., Value]] = field(default_factory=dict)
    exists: Callable | None = None  # pattern -> boolean column
    aggregates: dict[str, Value] = field(default_factory=dict)  # by repr of the aggregate
    row: Column | None = None  # tells solutions apart, for BNODE(str)


def evaluate(e, scope: Scope) -> Value:
    if isinstance(e, Var):
        return scope.values.get(e.name, T.null())
    if not isinstance(e, tuple):
        return T.constant(e)
    op, *args = e
    if op == "agg":
        if repr(e) not in scope.aggregates:
            raise SparqlError("an aggregate may not stand here")
        return scope.aggregates[repr(e)]
    if op == "exists":
        if scope.exists is None:
            raise SparqlError("EXISTS may not stand here")
        return _bool(scope.exists(args[0]))
    if op == "call":
        if args[0] in LIST_MEMBER:
            return _bool(scope.exists(list_member(args[1])))
        function = scope.functions.get(args[0]) or REGISTRY.get(args[0]) or CASTS.get(args[0]) or XPATH.get(args[0]) or OTHER.get(args[0])
        if function is None:
            raise SparqlError(f"unknown function <{args[0]}>")
        return function(*[evaluate(a, scope) for a in args[1]])
    if op in ("in", "not_in"):
        left = evaluate(args[0], scope)
        found = reduce(lambda x, y: x | y, [T.compare(left, evaluate(a, scope), "=") for a in args[1]], F.lit(False))
        return _bool(found if op == "in" else ~found)
    if op == "bound":
        return _bool(evaluate(args[0], scope).col.isNotNull())
    if op in ("iri", "uri"):
        return _iri(evaluate(args[0], scope), scope.base)
    if op == "bnode":
        if not args:
            return Value(F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit(""))), "blank")
        row = F.lit("") if scope.row is None else scope.row
        return Value(F.concat(F.lit("b"), F.md5(F.concat_ws("|", row, T.text(evaluate(args[0], scope))))), "blank")
    if op in FLIPPED and (found := _year_range(op, *args, scope)) is not None:
        return _bool(found)
    return OPERATORS[op](*[evaluate(a, scope) for a in args])


#: Comparisons with their sides exchanged.
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _year_range(op: str, a, b, scope: Scope) -> Column | None:
    """A native timestamp's year compared with a constant, as a range that reaches the scan; None for anything else."""
    if isinstance(b, tuple) and b[0] == "year":
        op, a, b = FLIPPED[op], b, a
    if not (isinstance(a, tuple) and a[0] == "year" and isinstance(b, T.Literal) and b.dt == XSD + "integer" and b.value.isdigit() and 1 <= int(b.value) < 9999):
        return None
    v = evaluate(a[1], scope)
    if v.type != "dateTime":
        return None
    low, high = (F.lit(f"{int(b.value) + k:04d}-01-01 00:00:00").cast("timestamp_ntz") for k in (0, 1))
    tests = {"=": (v.col >= low) & (v.col < high), "!=": (v.col < low) | (v.col >= high), "<": v.col < low, "<=": v.col < high, ">": v.col >= high, ">=": v.col >= low}
    return tests[op]


def list_member(args: list) -> PathPattern:
    """The pattern that matches if the first argument is a collection that holds the second."""
    if len(args) != 2 or not all(isinstance(a, (Var, T.Iri, T.Literal)) for a in args):
        raise SparqlError("listMember takes a list and a member, each a variable or a term")
    return PathPattern(args[0], ("seq", ("star", ("iri", T.RDF + "rest")), ("iri", T.RDF + "first")), args[1])


def _bool(c: Column) -> Value:
    return Value(c, "boolean")


def _string(c: Column) -> Value:
    return Value(c, "string")


# Operators


#: Decimals of this size or less have exact products.
SMALL = "decimal(19,9)"


def _exactly(op: str, a: Column, b: Column) -> Column:
    """A result of two decimals. Products and quotients of large ones go through doubles: Spark would cut their places to 6."""
    if op in "+-":
        return (F.try_add if op == "+" else F.try_subtract)(a, b).try_cast(T.DECIMAL)
    do = F.try_multiply if op == "*" else F.try_divide
    x, y = a.try_cast(SMALL), b.try_cast(SMALL)
    return F.when((x == a) & (y == b), do(x, y).try_cast(T.DECIMAL)).otherwise(do(a.cast("double"), b.cast("double")).try_cast(T.DECIMAL))


def _arithmetic(op: str) -> Callable[[Value, Value], Value]:
    do = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]

    def apply(a: Value, b: Value) -> Value:
        if a.numeric and b.numeric:
            kind = max(a.type, b.type, key=T.RANK.get)
            if kind == "integer" and op != "/":
                return Value(do(a.col, b.col), "integer")
            if kind in ("integer", "decimal"):
                x, y = (v.col.cast("decimal(20,0)") if v.type == "integer" else v.col for v in (a, b))
                return Value(do(x, y) if op in "+-" or "integer" in (a.type, b.type) else _exactly(op, x, y), "decimal")
            return Value(do(a.col.cast("double"), b.col.cast("double")), kind)
        if "term" not in (a.type, b.type):
            return T.null("double")
        rank = F.greatest(_rank(a), _rank(b))
        both = lambda f: (f(a), f(b))
        if op == "/":
            return _number_term(F.lit(None).cast(T.WHOLE), _exactly(op, *both(T.exact)), do(*both(T.number)), F.greatest(rank, F.lit(1)))
        return _number_term(do(*both(T.whole)).try_cast(T.WHOLE), _exactly(op, *both(T.exact)), do(*both(T.number)), rank)

    return apply


def _rank(v: Value) -> Column:
    if v.numeric:
        return F.lit(T.RANK[v.type])
    dt = v.col["dt"] if v.type == "term" else F.lit(None)
    return F.when(dt.isin(T.INTEGERS), 0).when(dt == XSD + "decimal", 1).when(dt == XSD + "float", 2).when(dt == XSD + "double", 3)


def _number_term(whole: Column, exact: Column, double: Column, rank: Column) -> Value:
    """A boxed number: the value of its rank."""
    lex = F.when(rank == 0, whole.cast("string")).when(rank == 1, T.decimal_text(exact)).otherwise(double.cast("string"))
    names = F.element_at(F.array(*[F.lit(XSD + t) for t in T.RANK]), rank + 1)
    return Value(F.when(lex.isNotNull() & rank.isNotNull(), T.boxed(LITERAL, lex, None, names)), "term")


def _unary_minus(v: Value) -> Value:
    if v.numeric:
        return Value(-v.col if v.type != "integer" else F.try_subtract(F.lit(0).cast("bigint"), v.col), v.type)
    return _number_term(-T.whole(v), -T.exact(v), -T.number(v), _rank(v))


def _or(*values: Value) -> Value:
    return _bool(reduce(lambda x, y: x | y, [T.ebv(v) for v in values]))


def _and(*values: Value) -> Value:
    return _bool(reduce(lambda x, y: x & y, [T.ebv(v) for v in values]))


def _common(values: list[Value]) -> tuple[list[Column], str, str | None]:
    """Columns of one type that hold the values, that type, and a template that they share."""
    kinds = {v.type for v in values}
    if len(kinds) == 1 and kinds != {"lang"}:
        kind = kinds.pop()
        if kind != "iri":
            return [v.col for v in values], kind, None
        if len({v.template for v in values}) == 1:
            return [v.col for v in values], kind, values[0].template
        return [v.lex() for v in values], kind, None
    return [v.box() for v in values], "term", None


def _if(c: Value, a: Value, b: Value) -> Value:
    test = T.ebv(c)
    (x, y), kind, template = _common([a, b])
    return Value(F.when(test, x).when(~test, y), kind, template)


def _coalesce(*values: Value) -> Value:
    if not values:
        return T.null()
    columns, kind, template = _common(list(values))
    return Value(F.coalesce(*columns), kind, template)


# Terms


def _str(v: Value) -> Value:
    if v.type == "blank":
        return T.null("string")
    if v.type == "term":
        return _string(F.when(v.col["kind"] != BLANK, v.col["lex"]))
    return _string(v.lex())


def _lang(v: Value) -> Value:
    if v.type == "term":
        return _string(F.when(v.col["kind"] == LITERAL, F.coalesce(v.col["lang"], F.lit(""))))
    if v.type in ("iri", "blank"):
        return T.null("string")
    return _string(F.when(v.col.isNotNull(), F.coalesce(v.lang, F.lit("")) if v.type == "lang" else F.lit("")))


def _datatype(v: Value) -> Value:
    if v.type == "term":
        c = v.col
        return Value(F.when(c["kind"] == LITERAL, F.coalesce(c["dt"], F.when(c["lang"].isNotNull(), T.RDF + "langString").otherwise(XSD + "string"))), "iri")
    if v.type in ("iri", "blank"):
        return T.null("iri")
    return Value(F.when(v.col.isNotNull(), F.lit(T.RDF + "langString" if v.type == "lang" else XSD + v.type)), "iri")


def _kind_test(kind: int, *static: str) -> Callable[[Value], Value]:
    def test(v: Value) -> Value:
        if v.type == "term":
            return _bool(v.col["kind"] == kind)
        return _bool(F.when(v.col.isNotNull(), F.lit(v.type in static)))

    return test


def _is_numeric(v: Value) -> Value:
    if v.type == "term":
        good = F.when(v.col["dt"].isin(T.INTEGERS), v.col["lex"].rlike("^[+-]?[0-9]+$")).otherwise(v.col["lex"].try_cast("double").isNotNull())
        return _bool(F.when(v.col.isNotNull(), F.coalesce(v.col["dt"].isin(T.NUMERIC), F.lit(False)) & good))
    return _bool(F.when(v.col.isNotNull(), F.lit(v.numeric)))


def _iri(v: Value, base: str) -> Value:
    if v.type == "iri":
        return v
    is_iri = v.col["kind"] == IRI if v.type == "term" else F.lit(False)
    s = F.coalesce(T.text(v), F.when(is_iri, v.lex()))
    whole = s.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    root = base if base.endswith(("/", "#")) else base.rpartition("/")[0] + "/" if "/" in base else base
    return Value(F.when(whole | F.lit(not base), s).otherwise(F.concat(F.lit(root), s)), "iri")


def _plain(v: Value) -> Column:
    """A literal without a language."""
    return F.when(T.language(v).isNull(), T.text(v))


def _strlang(v: Value, tag: Value) -> Value:
    return Value(F.when(T.text(tag).isNotNull(), _plain(v)), "lang", lang=F.lower(T.text(tag)))


def _strdt(v: Value, dt: Value) -> Value:
    return Value(F.when(_plain(v).isNotNull() & dt.col.isNotNull(), T.boxed(LITERAL, _plain(v), None, F.nullif(dt.lex(), F.lit(XSD + "string")))), "term")


def _langmatches(tag: Value, pattern: Value) -> Value:
    t, p = F.lower(T.text(tag)), F.lower(T.text(pattern))
    return _bool(F.when(p == "*", t != "").otherwise((t == p) | t.startswith(F.concat(p, F.lit("-")))))


# Strings


def _like(v: Value, made: Column) -> Value:
    """A string made from ``v`` keeps its language."""
    if v.type == "lang":
        return Value(made, "lang", lang=v.lang)
    if v.type == "term":
        return Value(F.when(made.isNotNull(), T.boxed(LITERAL, made, v.col["lang"])), "term")
    return _string(made)


def _fits(a: Value, b: Value) -> Column:
    """Whether b may be an argument beside a: no language, or the same."""
    if b.type == "string":
        return F.lit(True)
    return T.language(b).isNull() | F.coalesce(F.lower(T.language(a)) == F.lower(T.language(b)), F.lit(False))


def _string_test(do: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Value]:
    return lambda a, b: _bool(F.when(_fits(a, b), do(T.text(a), T.text(b))))


def _substr(v: Value, start: Value, length: Value | None = None) -> Value:
    s, at = T.text(v), F.round(T.number(start)).cast("int")
    low = F.greatest(at, F.lit(1))
    size = F.length(s) if length is None else at + F.round(T.number(length)).cast("int") - low
    return _like(v, F.substring(s, low, F.greatest(size, F.lit(0))))


def _before(v: Value, cut: Value) -> Value:
    s, c = T.text(v), T.text(cut)
    at = F.position(c, s)
    return _cut(v, cut, at, F.substring(s, F.lit(1), at - 1))


def _after(v: Value, cut: Value) -> Value:
    s, c = T.text(v), T.text(cut)
    at = F.position(c, s)
    return _cut(v, cut, at, F.substring(s, at + F.length(c), F.length(s)))


def _cut(v: Value, cut: Value, at: Column, made: Column) -> Value:
    """No match gives an empty plain literal."""
    if v.type == "string":
        return _string(F.when(_fits(v, cut), F.when(at > 0, made).otherwise("")))
    term = F.when(at > 0, _like(v, made).box()).when(at == 0, _string(F.lit("")).box())
    return Value(F.when(_fits(v, cut), term), "term")


def _concat(*values: Value) -> Value:
    if not values:
        return _string(F.lit(""))
    made = F.concat(*[T.text(v) for v in values])
    if all(v.type == "string" for v in values):
        return _string(made)
    first = T.language(values[0])
    same = reduce(lambda x, y: x & y, [T.language(v).eqNullSafe(first) for v in values])
    return Value(F.when(made.isNotNull(), T.boxed(LITERAL, made, F.when(same, first))), "term")


def _uri_encoded(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _pattern(p: Value, flags: Value | None) -> Column:
    """The regular expression with its flags in front; only the flags s, m, i, x and q are known."""
    if flags is None:
        return T.text(p)
    f = T.text(flags)
    kept = F.regexp_replace(f, "q", "")
    quoted = F.when(F.contains(f, F.lit("q")), F.concat(F.lit("\\Q"), T.text(p), F.lit("\\E"))).otherwise(T.text(p))
    return F.when(f.rlike("^[smixq]*$"), F.when(kept == "", quoted).otherwise(F.concat(F.lit("(?"), kept, F.lit(":"), quoted, F.lit(")"))))


def _regex(v: Value, p: Value, flags: Value | None = None) -> Value:
    return _bool(F.rlike(T.text(v), _pattern(p, flags)))


def _replace(v: Value, p: Value, by: Value, flags: Value | None = None) -> Value:
    return _like(v, F.regexp_replace(T.text(v), _pattern(p, flags), T.text(by)))


def _hash(do: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda v: _string(do(_plain(v)))


# Numbers


def _numeric(double: Callable[[Column], Column], integer: Callable[[Column], Column] = lambda c: c) -> Callable[[Value], Value]:
    def apply(v: Value) -> Value:
        if v.type == "integer":
            return Value(integer(v.col), "integer")
        if v.numeric:
            return Value(double(v.col) if v.type == "decimal" else double(v.col).cast("double"), v.type)
        return _number_term(integer(T.whole(v)), double(T.exact(v)).try_cast(T.DECIMAL), double(T.number(v)).cast("double"), _rank(v))

    return apply


def _half_up(c: Column) -> Column:
    """Rounds halves away from zero; very large values are whole already."""
    return F.when(F.abs(c) < 1e15, F.round(c)).otherwise(c)


# Dates


def _local(v: Value) -> Column:
    """The local time of a dateTime, as it is written."""
    if v.type == "dateTime":
        return v.col
    if v.type == "term":
        plain = F.regexp_replace(v.col["lex"], "(Z|[+-][0-9]{2}:[0-9]{2})$", "")
        return F.when(v.col["dt"] == XSD + "dateTime", plain.try_cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def _zone(v: Value) -> Column:
    """The zone as written; empty without one; NULL for anything but a dateTime."""
    if v.type == "dateTime":
        return F.when(v.col.isNotNull(), F.lit(""))
    if v.type == "term":
        return F.when(v.col["dt"] == XSD + "dateTime", F.regexp_extract(v.col["lex"], "(Z|[+-][0-9]{2}:[0-9]{2})$", 1))
    return F.lit(None).cast("string")


def _part(do: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda v: Value(do(_local(v)).cast("bigint"), "integer")


def _seconds(v: Value) -> Value:
    return Value(F.date_format(_local(v), "s.SSSSSS").cast("decimal(8,6)"), "decimal")


def _timezone(v: Value) -> Value:
    z = _zone(v)
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    sign = F.when(z.startswith("-"), "-").otherwise("")
    made = F.when((z == "Z") | (hours + minutes == 0), "PT0S").when(z != "", F.concat(sign, F.lit("PT"), part(hours, "H"), part(minutes, "M")))
    return Value(F.when(made.isNotNull(), T.boxed(LITERAL, made, None, F.lit(XSD + "dayTimeDuration"))), "term")


# Casts


def _lexical(v: Value) -> Column:
    """What a cast reads: the value of a literal."""
    if v.type == "term":
        return F.when(v.col["kind"] == LITERAL, v.col["lex"])
    return F.lit(None).cast("string") if v.type in ("iri", "blank") else v.lex()


def _flag(v: Value) -> Column:
    return T.as_boolean(v)


def cast_integer(v: Value) -> Value:
    if v.type == "integer":
        return v
    n = T.number(v)
    s = F.when(T.text(v).rlike(r"^\s*[-+]?[0-9]+\s*$"), F.trim(T.text(v))).try_cast("bigint")
    # A cast to an integer cuts places off.
    exactly = v.col.try_cast("bigint") if v.type == "decimal" else F.coalesce(T.whole(v).try_cast("bigint"), T.exact(v).try_cast("bigint"))
    whole = F.when(F.abs(n) < 9.2e18, n).try_cast("bigint")
    return Value(F.coalesce(_flag(v).cast("bigint"), exactly, whole, s), "integer")


def cast_decimal(v: Value) -> Value:
    if v.type == "decimal":
        return v
    n = T.number(v)
    s = F.when(T.text(v).rlike(r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$"), F.trim(T.text(v))).try_cast(T.DECIMAL)
    return Value(F.coalesce(_flag(v).cast("int").cast(T.DECIMAL), T.exact(v), F.when(~F.isnan(n), n).try_cast(T.DECIMAL), s), "decimal")


def _cast_float(kind: str) -> Callable[[Value], Value]:
    def cast(v: Value) -> Value:
        s = F.when(T.text(v).rlike(r"^\s*([-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?|[-+]?INF|NaN)\s*$"), T.text(v)).try_cast("double")
        return Value(F.coalesce(_flag(v).cast("double"), T.number(v), s), kind)

    return cast


def cast_boolean(v: Value) -> Value:
    n, s = T.number(v), T.text(v)
    return _bool(F.coalesce(_flag(v), (n != 0) & ~F.isnan(n), F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False)))


def cast_string(v: Value) -> Value:
    return _str(v)


def cast_datetime(v: Value) -> Value:
    if v.type == "dateTime":
        return v
    s = F.when(_lexical(v).rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"), _lexical(v))
    return Value(F.when(F.try_to_timestamp(s).isNotNull(), T.boxed(LITERAL, s, None, F.lit(XSD + "dateTime"))), "term")


CASTS = {XSD + "integer": cast_integer, XSD + "decimal": cast_decimal, XSD + "float": _cast_float("float"), XSD + "double": _cast_float("double"), XSD + "boolean": cast_boolean, XSD + "string": cast_string, XSD + "dateTime": cast_datetime}

OPERATORS: dict[str, Callable[..., Value]] = {
    **{op: _arithmetic(op) for op in "+-*/"},
    **{op: (lambda a, b, op=op: _bool(T.compare(a, b, op))) for op in ("=", "!=", "<", "<=", ">", ">=")},
    "or": _or,
    "and": _and,
    "not": lambda v: _bool(~T.ebv(v)),
    "plus": _numeric(lambda c: c),
    "minus": _unary_minus,
    "if": _if,
    "coalesce": _coalesce,
    "sameterm": lambda a, b: _bool(T.same_term(a, b)),
    "str": _str,
    "lang": _lang,
    "datatype": _datatype,
    "isiri": _kind_test(IRI, "iri"),
    "isuri": _kind_test(IRI, "iri"),
    "isblank": _kind_test(BLANK, "blank"),
    "isliteral": _kind_test(LITERAL, "string", "lang", "boolean", "dateTime", *T.RANK),
    "isnumeric": _is_numeric,
    "strlang": _strlang,
    "strdt": _strdt,
    "langmatches": _langmatches,
    "uuid": lambda: Value(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri"),
    "struuid": lambda: _string(F.uuid()),
    "strlen": lambda v: Value(F.length(T.text(v)).cast("bigint"), "integer"),
    "substr": _substr,
    "ucase": lambda v: _like(v, F.upper(T.text(v))),
    "lcase": lambda v: _like(v, F.lower(T.text(v))),
    "strstarts": _string_test(lambda a, b: a.startswith(b)),
    "strends": _string_test(lambda a, b: a.endswith(b)),
    "contains": _string_test(lambda a, b: F.contains(a, b)),
    "strbefore": _before,
    "strafter": _after,
    "concat": _concat,
    "encode_for_uri": lambda v: _string(_uri_encoded(T.text(v))),
    "regex": _regex,
    "replace": _replace,
    "md5": _hash(F.md5),
    "sha1": _hash(F.sha1),
    **{f"sha{n}": _hash(lambda c, n=n: F.sha2(c, n)) for n in (224, 256, 384, 512)},
    "abs": _numeric(F.abs, F.abs),
    "ceil": _numeric(F.ceil),
    "floor": _numeric(F.floor),
    "round": _numeric(_half_up),
    "rand": lambda: Value(F.rand(), "double"),
    "now": lambda: Value(F.current_timestamp().cast("timestamp_ntz"), "dateTime"),
    "year": _part(F.year),
    "month": _part(F.month),
    "day": _part(F.dayofmonth),
    "hours": _part(F.hour),
    "minutes": _part(F.minute),
    "seconds": _seconds,
    "timezone": _timezone,
    "tz": lambda v: _string(_zone(v)),
}


def _any_text(v: Value) -> Value:
    """XPath string functions read any literal or IRI, and drop its type."""
    return _str(v)


def _compared(a: Value, b: Value) -> Value:
    x, y = _any_text(a).col, _any_text(b).col
    return Value(F.when(x < y, -1).when(x == y, 0).when(x > y, 1).cast("bigint"), "integer")


def _plainly(name: str, n: int = 1) -> Callable[..., Value]:
    """A SPARQL function on the texts of the first ``n`` arguments."""
    return lambda *v: OPERATORS[name](*[_any_text(x) for x in v[:n]], *v[n:])


XPATH = {
    T.FN + name: f
    for name, f in {
        "matches": _plainly("regex"),
        "abs": OPERATORS["abs"],
        "ceiling": OPERATORS["ceil"],
        "floor": OPERATORS["floor"],
        "round": OPERATORS["round"],
        "round-half-to-even": _numeric(lambda c: F.bround(c)),
        "compare": _compared,
        "concat": lambda *v: _concat(*map(_any_text, v)),
        "substring": _plainly("substr"),
        "string-length": _plainly("strlen"),
        "upper-case": _plainly("ucase"),
        "lower-case": _plainly("lcase"),
        "encode-for-uri": _plainly("encode_for_uri"),
        "contains": _plainly("contains", 2),
        "starts-with": _plainly("strstarts", 2),
        "ends-with": _plainly("strends", 2),
        "year-from-dateTime": OPERATORS["year"],
        "month-from-dateTime": OPERATORS["month"],
        "day-from-dateTime": OPERATORS["day"],
        "hours-from-dateTime": OPERATORS["hours"],
        "minutes-from-dateTime": OPERATORS["minutes"],
        "seconds-from-dateTime": OPERATORS["seconds"],
        "timezone-from-dateTime": OPERATORS["timezone"],
    }.items()
}


def geo_distance(*v: Value) -> Value:
    """Kilometres between (lat, lon) and (lat, lon), or two "lat lon" texts, on a sphere of 6372.795 km radius."""
    if len(v) == 2:
        parts = [F.split(F.trim(_any_text(x).col), r"[\s,]+") for x in v]
        degrees = [F.get(p, F.lit(i)).try_cast("double") for p in parts for i in (0, 1)]
    else:
        degrees = [T.number(x) for x in v]
    a, b, c, d = (F.radians(x) for x in degrees)
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return Value(2 * 6372.795 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))), "double")


def _warned(v: Value) -> Value:
    """The value itself. Its plan's text goes to the log when the query is compiled: values are on the executors."""
    logging.getLogger("quadlight").warning("warn: %s", v.col)
    return v


#: Names of the functions that tell whether a collection holds a member.
LIST_MEMBER = ("http://jena.hpl.hp.com/ARQ/function#listMember", "java:com.hp.hpl.jena.query.function.library.listMember")
#: Names of widely used extension functions.
OTHER = {
    "java:com.hp.hpl.jena.query.function.library.sha1sum": lambda v: _string(F.sha1(_any_text(v).col)),
    "java:com.hp.hpl.jena.query.function.library.now": OPERATORS["now"],
    "http://kasei.us/2007/09/functions/warn": lambda v: _warned(v),
    "java:com.hp.hpl.jena.query.function.library.langeq": lambda v, p: _langmatches(_lang(v), p),
    "java:com.ldodds.sparql.Distance": geo_distance,
}
