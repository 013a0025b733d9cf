"""Chat formatting by schema fingerprints: the nested field paths of a record are hashed, the
hash selects a declarative mapping, the mapping gives canonical turns.  DataFrame and SQL
functions only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical turns of a record.
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: its fields, and its turns as an SQL expression over them."""

    name: str
    fields: str
    turns: str

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(T._parse_datatype_string(self.fields))


_ROLE = "CASE lower({0}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {0} END"


def _pairs(*fields: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{role}', 'text', {field})" for role, field in fields) + ")"


def _listed(name: str, role: str, text: str) -> str:
    return f"transform({name}, m -> named_struct('role', {_ROLE.format('m.' + role)}, 'text', m.{text}))"


_TASK = "concat_ws('\\n', instruction, nullif(input, ''))"
#: The layouts known; a new one is one more row.
MAPPINGS = [
    Mapping("turn rows", "role string, text string", "array(named_struct('role', role, 'text', text))"),
    Mapping("messages", "messages array<struct<content:string,role:string>>", _listed("messages", "role", "content")),
    Mapping("conversations", "conversations array<struct<from:string,value:string>>", _listed("conversations", "`from`", "value")),
    Mapping("prompt and completion", "prompt string, completion string", _pairs(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", "prompt string, response string", _pairs(("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", "question string, answer string", _pairs(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", "instruction string, output string", _pairs(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", "instruction string, input string, output string", _pairs(("user", _TASK), ("assistant", "output"))),
    Mapping(
        "instruction with system", "system string, instruction string, input string, output string",
        _pairs(("system", "system"), ("user", _TASK), ("assistant", "output")),
    ),
    Mapping(
        "nested prompt", "prompt struct<system:string,user:string>, response string",
        _pairs(("system", "prompt.system"), ("user", "prompt.user"), ("assistant", "response")),
    ),
]


def _shape(kind: T.DataType) -> str:
    """Nested field paths of a type as one text, fields by name, leaves as _."""
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {_shape(f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_shape(kind.elementType)}>"
    return "_"


def fingerprint_of(kind: T.DataType) -> str:
    """The fingerprint of a table's or column's type."""
    return hashlib.md5(_shape(kind).encode()).hexdigest()


def fingerprint(record: Column) -> Column:
    """The fingerprint of a JSON record; null if it is no JSON."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    leaf = r"\b(?:STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|DATE|TIMESTAMP|BINARY|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"
    return F.md5(F.encode(F.regexp_replace(shape, leaf, "_"), "utf-8"))


def turns_of_records(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``layout`` and ``turns`` of the JSON text in column ``record``.

    The fingerprint of each record selects its mapping; records of an unknown layout, broken
    JSON and nulls have a null layout and null turns, and stay.  Other columns stay.
    """
    out = records.withColumn("__fp", fingerprint(F.col(record)))
    layout = turns = None
    for i, m in enumerate(MAPPINGS):
        out = out.withColumn(f"__r{i}", F.when(F.col("__fp") == m.fingerprint, F.from_json(record, m.fields)))
        expr = F.expr(_over(m, f"__r{i}"))
        at = F.col("__fp") == m.fingerprint
        layout = F.when(at, m.name) if layout is None else layout.when(at, m.name)
        turns = F.when(at, expr.cast(TURNS)) if turns is None else turns.when(at, expr.cast(TURNS))
    out = out.withColumns({"layout": layout, "turns": turns})
    return out.drop("__fp", *[f"__r{i}" for i in range(len(MAPPINGS))])


def _over(m: Mapping, column: str) -> str:
    """The mapping's turns, its fields taken from a struct column."""
    names = [f.name for f in T._parse_datatype_string(m.fields).fields]
    fields = ", ".join(f"'{n}', {column}.`{n}`" for n in names)
    inner = m.turns
    for n in sorted(names, key=len, reverse=True):
        inner = _qualified(inner, n)
    return f"transform(array(named_struct({fields})), r -> {inner})[0]"


def _qualified(sql: str, name: str) -> str:
    import re

    parts = re.split(r"('(?:[^'\\]|\\.)*')", sql)  # leave string literals as they are
    return "".join(p if p.startswith("'") else re.sub(rf"(?<![\w.`]){name}\b(?!\s*->)", f"r.{name}", p) for p in parts)


def turns_of_table(table: DataFrame, fields: list[str]) -> DataFrame:
    """``table`` with ``layout`` and ``turns`` from its typed ``fields``: here the type of the
    whole table has one fingerprint.  An unknown layout is an error that names it."""
    kind = T.StructType([table.schema[f] for f in fields])
    known = {m.fingerprint: m for m in MAPPINGS}
    mapping = known.get(fingerprint_of(kind))
    if mapping is None:
        raise ValueError(f"no mapping for the layout {_shape(kind)}")
    return table.withColumns({"layout": F.lit(mapping.name), "turns": F.expr(mapping.turns).cast(TURNS)})


#: The template: a turn is START role \n text END.  Every string in CONTROLS is a control
#: string; inside a text it gets one backslash after its first character, and one that has
#: backslashes there gets one more, so taking one away gives the text back.
START, END = "<s>", "</s>"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>)", "$1$2$3")


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """One row per conversation: ``formatted`` text and ``loss`` mask from rows ``role, text``.

    ``loss`` lists the half-open code point ranges of the assistant texts in ``formatted``,
    as structs start, end.  Null roles and texts count as empty.  Rows are ordered by
    ``order``; equal ones then by role and text.
    """
    w = Window.partitionBy(conversation).orderBy(*order, "role", "text")
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    rows = turns.select(conversation, *order, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"__n": F.row_number().over(w), "__head": F.length(head), "__body": escaped(F.col("text"))})
    rows = rows.withColumn("__out", F.concat(head, "__body", F.lit(END)))
    rows = rows.withColumn("__end", F.sum(F.length("__out")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("__end") - F.length("__out") + F.col("__head")
    span = F.when(F.col("role") == "assistant", F.struct(F.lit(0).alias("o"), start.alias("start"), (start + F.length("__body")).alias("end")))
    rows = rows.withColumn("__span", span)
    done = rows.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct("__n", "__out", "__span"))).alias("t"))
    return done.select(
        conversation, F.array_join(F.transform("t", lambda x: x["__out"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["__span"].isNotNull()), lambda x: F.struct(x["__span"]["start"].alias("start"), x["__span"]["end"].alias("end"))).alias("loss"),
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped, as they were."""
    parts = F.split(formatted, END)
    body = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(
        body,
        lambda p: F.struct(
            _role_back(F.split_part(p, F.lit("\n"), F.lit(1))).alias("role"),
            unescaped(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.length(p))).alias("text"),
        ),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))


def format_turn_table(table: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """Formatted conversations and loss masks of a table of turns (``role, text``, ordered by
    ``order``); other columns are ignored.  Rows without a conversation id are one
    conversation, whose id is null."""
    mapped = turns_of_table(table.select(conversation, order, "role", "text"), ["role", "text"])
    rows = mapped.select(conversation, order, F.posexplode("turns").alias("__k", "__t")).select(conversation, order, "__k", "__t.role", "__t.text")
    return render(rows, conversation, [order, "__k"])


def format_records(records: DataFrame, conversation: str, record: str = "record") -> DataFrame:
    """Formatted conversations and loss masks of JSON records, one conversation each; records
    of unknown layout are left out here (see ``turns_of_records``)."""
    rows = turns_of_records(records.select(conversation, record), record).select(conversation, F.posexplode("turns").alias("__k", "__t"))
    return render(rows.select(conversation, "__k", "__t.role", "__t.text"), conversation, ["__k"])


def digest(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the formatted text gives back, per conversation."""
    back = formatted.select(conversation, "formatted", parsed(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("texts"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("texts", "")
    return back.select(
        conversation, F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
