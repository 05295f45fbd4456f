"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON object, or a struct, of any of the layouts in ``LAYOUTS``. The fingerprint, a hash of those of its
nested field paths that a layout knows, selects a declarative mapping to canonical turns (role, text); fields that the
mapping does not read are kept beside the turns. Turns are marked as ``<turn role>``, a line end, the text, ``</turn>`` and
a line end. Inside roles and texts a backslash becomes ``\\b``, < ``\\l`` and > ``\\g``, so no text can forge a mark, and what
was written can be read back exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: All fields that a mapping reads.
FIELDS = (
    "prompt string, response string, completion string, instruction string, input string, output string, system string, question string, answer string, "
    "messages array<struct<role string, content string>>, conversations array<struct<`from` string, value string>>"
)
TURNS = "array<struct<role string, text string>>"

#: Layouts by name: the turns as (role, field), or as (array, role field, text field). Their fields are the paths that
#: identify them. Of the layouts that a record has all paths of, the one with the most counts, then the first here.
LAYOUTS = {
    "messages": ("messages", "role", "content"),
    "conversations": ("conversations", "from", "value"),
    "system_instruction_input": [("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")],
    "instruction_input": [("user", "instruction"), ("user", "input"), ("assistant", "output")],
    "system_instruction": [("system", "system"), ("user", "instruction"), ("assistant", "output")],
    "system_prompt_response": [("system", "system"), ("user", "prompt"), ("assistant", "response")],
    "prompt_response": [("user", "prompt"), ("assistant", "response")],
    "prompt_completion": [("user", "prompt"), ("assistant", "completion")],
    "question_answer": [("user", "question"), ("assistant", "answer")],
    "instruction": [("user", "instruction"), ("assistant", "output")],
}
#: A record of fewer bytes than this is never too large for a JSON reader.
LARGE = 16_000_000
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_paths(how: tuple | list) -> list[str]:
    """The nested field paths that a layout reads, sorted."""
    if isinstance(how, tuple):
        return sorted([how[0], f"{how[0]}[].{how[1]}", f"{how[0]}[].{how[2]}"])
    return sorted(field for _, field in how)


def _ranked() -> list[tuple[str, tuple | list]]:
    """Layouts that read arrays first, then those with more paths."""
    return sorted(LAYOUTS.items(), key=lambda x: (isinstance(x[1], list), -len(layout_paths(x[1]))))


def fingerprint(there: dict[str, Column], paths: list[str]) -> Column:
    """A hash of those of ``paths`` that are there."""
    return F.xxhash64(F.array(*[F.when(there[p], F.lit(p)) for p in paths]))


def expected(paths: list[str]) -> Column:
    return F.xxhash64(F.array(*[F.lit(p) for p in paths]))


def _json_paths(record: Column) -> dict[str, Column]:
    """Which of the known paths a JSON record has. An array without elements has the paths of any."""
    value = F.try_parse_json(record)
    part = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
    there: dict[str, Column] = {}
    for _, how in _ranked():
        if isinstance(how, tuple):
            shape = F.schema_of_variant(part(how[0]))
            there[how[0]] = F.coalesce(shape.startswith("ARRAY<"), F.lit(False))
            for field in how[1:]:
                there[f"{how[0]}[].{field}"] = F.coalesce(shape.isin("ARRAY<VOID>", "ARRAY<OBJECT<>>") | shape.rlike(rf"^ARRAY<OBJECT<(.*, )?{field}: "), F.lit(False))
        else:
            for _, field in how:
                there[field] = F.coalesce(part(field).isNotNull(), F.lit(False))
    return there


def escape(c: Column) -> Column:
    return reduce(lambda x, y: F.replace(x, F.lit(y[0]), F.lit(y[1])), (("\\", "\\b"), ("<", "\\l"), (">", "\\g")), c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, y: F.replace(x, F.lit(y[1]), F.lit(y[0])), ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")), c)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _role(c: Column) -> Column:
    return reduce(lambda x, y: F.when(c == y[0], y[1]).otherwise(x), ROLES.items(), _text(c))


def _mapped(there: dict[str, Column], record: Column) -> tuple[Column, Column]:
    """(layout, turns) of the first layout whose fingerprint is the record's; nulls without one."""
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)

    def turn(who: str, field: str):
        return lambda x: F.struct(_role(x[who]).alias("role"), _text(x[field]).alias("text"))

    for name, how in reversed(_ranked()):
        paths = layout_paths(how)
        if not all(p in there for p in paths):
            continue
        here = fingerprint(there, paths) == expected(paths)
        if isinstance(how, tuple):
            made = F.coalesce(F.transform(record[how[0]], turn(how[1], how[2])), F.array().cast(TURNS))
        else:
            made = F.array(*[F.struct(F.lit(who).alias("role"), _text(record[field]).alias("text")) for who, field in how])
        layout, turns = F.when(here, name).otherwise(layout), F.when(here, made.cast(TURNS)).otherwise(turns)
    return layout, turns


def _but(fields: Column, read: list[str] | tuple[str, ...]) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.isin(*read))


def _each_but(elements: Column, read: list[str] | tuple[str, ...]) -> Column:
    return F.transform(elements, lambda m: _but(m, read))


def _extra(record: Column, layout: Column, options: dict[str, str]) -> Column:
    """What the layout does not read, as a JSON object of JSON texts: other fields, and of arrays the other fields of each
    element. Null if there is nothing more, the whole record if there is no layout."""
    fields = F.from_json(record, "map<string,string>", options)
    out = F.when(layout.isNull(), record)
    for name, how in LAYOUTS.items():
        read = [how[0]] if isinstance(how, tuple) else [f for _, f in how]
        more = _but(fields, read)
        if isinstance(how, tuple):
            elements = F.from_json(record, f"{how[0]} array<map<string,string>>", options)[how[0]]
            others = _each_but(elements, how[1:])
            some = F.exists(others, lambda m: F.size(m) > 0)
            more = F.map_concat(more, F.when(F.coalesce(some, F.lit(False)), F.create_map(F.lit(how[0]), F.to_json(others))).otherwise(F.from_json(F.lit("{}"), "map<string,string>")))
        out = F.when((layout == name) & (F.size(more) > 0), F.to_json(more)).otherwise(out)
    return out


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Adds ``layout``, ``turns`` (array of role, text) and ``extra`` (JSON of the fields that the layout does not read).

    A record of no known layout, or that is no JSON, has a null layout, null turns, and itself as ``extra``; null fields
    count as empty texts. A record that is JSON but too large for a fingerprint (variants hold 128 MB, their texts 20
    million characters) is an error. Columns of these names that are there already are replaced, others kept."""
    options = {"maxStringLen": str((1 << 31) - 1)}
    record = F.col(record_col)
    found = records.withColumn("_r", F.from_json(record, f"{FIELDS}, _corrupt string", {**options, "columnNameOfCorruptRecord": "_corrupt"}))
    layout, turns = _mapped(_json_paths(record), F.col("_r"))
    lost = (F.octet_length(record) >= LARGE) & F.try_parse_json(record).isNull() & F.col("_r").isNotNull() & F.col("_r._corrupt").isNull()
    error = F.raise_error(F.concat(F.lit("a record is too large to be read as a whole, bytes: "), F.octet_length(record)))
    found = found.withColumn("layout", F.when(lost, error.cast("string")).otherwise(layout)).withColumn("turns", F.when(lost, error.cast(TURNS)).otherwise(turns))
    return found.withColumn("extra", _extra(record, F.col("layout"), options)).drop("_r")


def _struct_paths(kind: StructType) -> dict[str, Column]:
    """The field paths of a struct's type. They are the same for every row, so their hashes are constants."""
    there = {f.name: F.lit(True) for f in kind.fields}
    for f in kind.fields:
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            there |= {f"{f.name}[].{g}": F.lit(True) for g in f.dataType.elementType.names}
    return there


def struct_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """As ``canonical_turns`` for records that are structs: ``layout`` and ``turns``; no JSON reader bounds what they hold."""
    layout, turns = _mapped(_struct_paths(records.schema[record_col].dataType), F.col(record_col))
    return records.withColumn("layout", layout).withColumn("turns", turns)


def format_turns(df: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``, the (start, length) in code points of each assistant text in it."""
    head = lambda t: F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">\n"))
    part = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    df = df.withColumn("_parts", part)
    formatted = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit("</turn>\n"))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start int, length int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        here, size = a["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct(here.alias("start"), size.alias("length")))
        return F.struct((here + size + F.lit(8)).alias("at"), F.when(p["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return df.withColumn("formatted", formatted).withColumn("loss_spans", F.aggregate("_parts", start, step, lambda a: a["spans"])).drop("_parts")


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    parts = F.filter(F.split(formatted, "</turn>\n", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        ends = F.position(F.lit(">\n"), x)
        return F.struct(unescape(F.substring(x, F.lit(7), ends - 7)).alias("role"), unescape(F.substring(x, ends + 2, F.length(x))).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def _in_order(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id_col, _rows: array of turn, role, text in order)."""
    row = F.struct(F.col(turn_col).alias("t"), _text(F.col(role_col)).alias("r"), _text(F.col(text_col)).alias("x"))
    return turns.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("_rows"))


def conversations_as_structs(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, record): the ``messages`` record of each conversation as a struct."""
    rows = _in_order(turns, id_col, turn_col, role_col, text_col)
    messages = F.transform("_rows", lambda m: F.struct(m["r"].alias("role"), m["x"].alias("content")))
    return rows.select(id_col, F.struct(messages.alias("messages")).alias("record"))


def conversations_as_records(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One ``messages`` record a conversation (id_col, record), its rows by turn. Ties of a turn go by role and text,
    repeated rows stay, rows of a null id form one conversation, null turns come first, null roles and texts are empty."""
    rows = _in_order(turns, id_col, turn_col, role_col, text_col)
    messages = F.transform("_rows", lambda m: F.struct(m["r"].alias("role"), m["x"].alias("content")))
    return rows.select(id_col, F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def format_chats(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with layout, turns, extra, formatted and loss_spans. Where there are no turns to read (no known layout)
    ``formatted`` is null, never empty. An empty table gives an empty result; columns of these names that are there already
    are replaced, others kept."""
    return format_turns(canonical_turns(records, record_col))
