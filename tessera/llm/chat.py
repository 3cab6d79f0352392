"""Chat formatting by schema fingerprint (operator 10). DataFrame and SQL functions only.

Records come in layouts that differ: flat turn rows, message lists, prompt/response pairs,
instruction/input/output triples. A layout is known by its fingerprint: the hash of its sorted nested
field paths. A registry maps each fingerprint to a declarative mapping (Spark SQL expressions) into
canonical turns, an array of (role, text). Records whose fingerprint is unknown keep a null turns
column and their fingerprint, so nothing is dropped unseen.

The template writes a turn as ``### role: text </turn>`` and a line feed. Inside roles and texts a
backslash is doubled, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\c`` and, in roles, a colon ``\\o``; so
control strings only ever stand where the template put them, and reading back is exact.

Cases: a null text counts as empty, a null role as an empty role; a null turn number comes first; turns that share
a number come by role, then text; repeated rows are turns of their own; a null conversation id is a
conversation; an empty table gives an empty table; other columns are ignored. A record that is null, isn't JSON, is empty or mixes layouts (a message of text beside one of
parts, say) has a layout that isn't known, and null turns; its text stays with the caller under its id. Repeated records are each answered.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, running_sums

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
TURNS = "array<struct<role:string,text:string>>"

#: Field paths of a known layout, and the SQL that maps a record r of it to turns.
#: Paths are written as in the fingerprint: nested by a dot, [] for the elements of an array.
LAYOUTS: dict[tuple[str, ...], str] = {
    ("messages[].content", "messages[].role"): "transform(try_variant_get(r, '$.messages', 'array<struct<role string, content string>>'), m -> struct(m.role AS role, m.content AS text))",
    ("turns[].role", "turns[].text"): "transform(try_variant_get(r, '$.turns', 'array<struct<role string, text string>>'), m -> struct(m.role AS role, m.text AS text))",
    ("conversations[].from", "conversations[].value"): "transform(try_variant_get(r, '$.conversations', 'array<struct<`from` string, value string>>'), m -> struct(CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END AS role, m.value AS text))",
    ("prompt", "response"): "array(struct('user' AS role, try_variant_get(r, '$.prompt', 'string') AS text), struct('assistant' AS role, try_variant_get(r, '$.response', 'string') AS text))",
    ("completion", "prompt"): "array(struct('user' AS role, try_variant_get(r, '$.prompt', 'string') AS text), struct('assistant' AS role, try_variant_get(r, '$.completion', 'string') AS text))",
    ("instruction", "output"): "array(struct('user' AS role, try_variant_get(r, '$.instruction', 'string') AS text), struct('assistant' AS role, try_variant_get(r, '$.output', 'string') AS text))",
    ("input", "instruction", "output"): "array(struct('user' AS role, concat_ws('\\n\\n', try_variant_get(r, '$.instruction', 'string'), nullif(try_variant_get(r, '$.input', 'string'), '')) AS text), struct('assistant' AS role, try_variant_get(r, '$.output', 'string') AS text))",
    ("messages[].content[].text", "messages[].content[].type", "messages[].role"): "transform(try_variant_get(r, '$.messages', 'array<struct<role string, content array<struct<type string, text string>>>>'), m -> struct(m.role AS role, array_join(transform(filter(m.content, c -> c.type = 'text'), c -> c.text), '') AS text))",
    ("prompt", "response", "system"): "array(struct('system' AS role, try_variant_get(r, '$.system', 'string') AS text), struct('user' AS role, try_variant_get(r, '$.prompt', 'string') AS text), struct('assistant' AS role, try_variant_get(r, '$.response', 'string') AS text))",
}
#: The same for tables of turn rows: key, order, role and text columns.
ROW_LAYOUTS: dict[tuple[str, ...], tuple[str, str, str, str]] = {
    ("conv_id", "role", "text", "turn"): ("conv_id", "turn", "role", "text"),
    ("content", "role", "session_id", "turn_index"): ("session_id", "turn_index", "role", "content"),
}


def fingerprint_of_paths(paths) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type: a.b for fields, a[] for elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return schema_paths(kind.elementType, prefix + "[]") if isinstance(kind, T.ArrayType) else [prefix]


#: Parts of a variant's schema text: a field's name (quoted if need be), what opens an array or object, what closes one, a plain type.
SCHEMA_PARTS = r"(?:`(?:[^`]|``)*`|[\p{L}\p{N}_]+): |ARRAY<|OBJECT<|>|[A-Z_]+(?:\([0-9, ]*\))?"


def record_paths(record: Column) -> Column:
    """Sorted field paths of a parsed JSON record, however deep, from its own schema: all elements of an array are merged, and a string is a string whatever it says."""
    state = "struct<at:string,within:array<string>,paths:array<string>,last:string>"

    def step(s: Column, part: Column) -> Column:
        name = F.regexp_replace(part, ": $", "")
        name = F.when(name.startswith("`"), F.replace(F.substring(name, 2, 2147483647).substr(F.lit(1), F.length(name) - 2), F.lit("``"), F.lit("`"))).otherwise(name)
        top = F.element_at(s["within"], -1)
        named = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        # An object without fields is a field itself.
        empty = (part == ">") & (s["last"] == "OBJECT<")
        at = F.when(part.endswith(": "), named).when(part == "ARRAY<", F.concat(s["at"], F.lit("[]"))).when(empty, top).otherwise(s["at"])
        within = F.when(part.isin("ARRAY<", "OBJECT<"), F.concat(s["within"], F.array(at))).when(part == ">", F.slice(s["within"], 1, F.size(s["within"]) - 1)).otherwise(s["within"])
        leaf = ~(part.endswith(": ") | part.isin("ARRAY<", "OBJECT<", ">")) | empty
        return F.struct(at.alias("at"), within.alias("within"), F.when(leaf, F.concat(s["paths"], F.array(at))).otherwise(s["paths"]).alias("paths"), part.alias("last")).cast(state)

    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("at"), none.alias("within"), none.alias("paths"), F.lit("").alias("last")).cast(state)
    return F.array_sort(F.aggregate(schema_parts(record), start, step, lambda s: s["paths"]))


def schema_parts(record: Column) -> Column:
    return F.regexp_extract_all(F.schema_of_variant(record), F.lit(SCHEMA_PARTS), F.lit(0))


def record_fingerprint(record: Column) -> Column:
    """Fingerprint of a parsed JSON record: the hash of its sorted field paths, and of a mark where elements of an array have values of several kinds at one path."""
    mixed = F.when(F.array_contains(schema_parts(record), "VARIANT"), F.lit("\n?")).otherwise("")
    return F.xxhash64(F.concat(F.array_join(record_paths(record), "\n"), mixed))


def canonical_turns(df: DataFrame, id_col: str = "id", record_col: str = "record", layouts: dict | None = None) -> DataFrame:
    """id, fingerprint and turns of JSON records in any registered layout; turns is null where the layout is unknown."""
    known = LAYOUTS if layouts is None else layouts
    rows = df.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(record_col)).alias("r"))
    rows = rows.select("id", record_fingerprint(F.col("r")).alias("fingerprint"), "r")
    turns = F.lit(None).cast(TURNS)
    for paths, mapping in known.items():
        turns = F.when(F.col("fingerprint") == fingerprint_of_paths(paths), F.expr(mapping).cast(TURNS)).otherwise(turns)
    return rows.select("id", "fingerprint", turns.alias("turns"))


def fingerprint(paths) -> str:
    """Hash of the sorted field paths of a table."""
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def row_layout(paths: list[str]) -> tuple[str, str, str, str]:
    """The registered mapping of a table's fingerprint; failing that, of its fields that some layout names; failing that, of the first layout all of whose fields it has.

    A table's rows share its schema, so it is fingerprinted once.
    """
    known = {fingerprint(k): m for k, m in ROW_LAYOUTS.items()}
    named = {f for k in ROW_LAYOUTS for f in k}
    for some in (set(paths), set(paths) & named, *(set(paths) & set(k) for k in ROW_LAYOUTS)):
        if found := known.get(fingerprint(some)):
            return found
    raise ValueError(f"no layout of turn rows has the fingerprint of {sorted(paths)}")


def turns_of_rows(df: DataFrame) -> DataFrame:
    """id and turns of a table of turn rows whose column names a registered layout has, whatever other columns there are.

    Turns of one conversation are one value by contract, so they meet in one row; partial lists are
    built before the shuffle, and conversations are dealt by their key.
    """
    key, order, role, text = row_layout(schema_paths(df.schema))
    turn = F.struct(F.col(order).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gathered = df.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select("id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in [("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\c"), *([(":", "\\o"), ("\n", "\\n")] if role else [])]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Pairs of backslashes are found from the left, so codes are only looked for between them."""

    def part(p: Column) -> Column:
        for plain, code in [("###", "\\h"), ("</turn>", "\\c"), (":", "\\o"), ("\n", "\\n")]:
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    plain = F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")
    return F.when(F.contains(text, F.lit("\\")), plain).otherwise(text)


def format_chats(df: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """id, formatted and loss_spans (start and end in code points of formatted, end exclusive) from id and turns.

    Spans cover the escaped texts of the trained role, one each, in order.
    """
    parts = F.transform(
        F.coalesce("turns", F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escaped(F.coalesce(t["role"], F.lit("")), True), F.lit(BETWEEN)).alias("head"),
            escaped(F.coalesce(t["text"], F.lit(""))).alias("body"),
            (F.coalesce(t["role"], F.lit("")) == trained_role).alias("trained"),
        ),
    )
    rows = df.select("id", F.transform(parts, lambda p: p.withField("head_n", F.length(p["head"]).cast("long")).withField("body_n", F.length(p["body"]).cast("long"))).alias("parts"))
    size = F.transform("parts", lambda p: p["head_n"] + p["body_n"] + F.lit(len(CLOSE)).cast("long"))

    def spans_of(parts: Column, ends: Column) -> Column:
        own = F.transform(parts, lambda p, i: F.struct(p["trained"].alias("trained"), (ends[i] - len(CLOSE) - p["body_n"]).alias("start"), (ends[i] - len(CLOSE)).alias("end")))
        return F.transform(F.filter(own, lambda s: s["trained"]), lambda s: s.dropFields("trained"))

    spans = let(F.col("parts"), lambda parts: let(running_sums(size), lambda ends: spans_of(parts, ends)))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return rows.select("id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text."""
    blocks = F.split(formatted, " </turn>\\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(b: Column) -> Column:
        b = F.substring(b, len(OPEN) + 1, 2147483647)
        at = F.instr(b, BETWEEN)
        return F.struct(unescaped(b.substr(F.lit(1), at - 1)).alias("role"), unescaped(b.substr(at + len(BETWEEN), F.lit(2147483647))).alias("text"))

    return F.transform(blocks, turn)
