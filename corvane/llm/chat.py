"""Chat formatting: layouts to canonical turns to one training text, in DataFrame functions only.

Layouts are told apart by a schema fingerprint: the nested field paths (struct fields as `a.b`, array elements as
`a[]`) are sorted and hashed, and the hash selects a declarative mapping. Typed tables have one fingerprint; JSON
columns have one per row. A layout without a mapping gives no turns and keeps its fingerprint for a report.

Canonical turns are (conv_id, turn, role, text). The template writes `<turn role="R">text</turn>` per turn. Texts and
roles are escaped first: backslash becomes `\\s`, `<` becomes `\\l` and the double quote `\\q`, so no control string
can occur inside them, and the three replacements undo each other exactly.

Null texts and roles count as empty. Turns are ordered by turn (null first), then role and text; repeated rows stay.
Turns with a null conv_id form one conversation. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import table

TURN = "struct<turn:bigint,role:string,text:string>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All nested leaf paths of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: name of the layout: its leaf paths, and its turns as (role, path of the text) or as a list (path, role field, text field).
#: A role in quotes is constant. `rows`: each row is one turn already.
LAYOUTS: dict[str, dict] = {
    "turn rows": {"paths": ["conv_id", "turn", "role", "text"], "rows": ("turn", "role", "text")},
    "prompt": {"paths": ["conv_id", "prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    "completion": {"paths": ["conv_id", "prompt", "completion"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    "question": {"paths": ["conv_id", "question", "answer"], "turns": [("user", "question"), ("assistant", "answer")]},
    "instruction": {"paths": ["conv_id", "instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    "instruction with input": {"paths": ["conv_id", "instruction", "input", "output"], "turns": [("user", "instruction", "input"), ("assistant", "output")]},
    "system prompt": {"paths": ["conv_id", "system", "prompt", "response"], "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "messages": {"paths": ["conv_id", "messages[].role", "messages[].content"], "list": ("messages", "role", "content")},
    "conversations": {"paths": ["conv_id", "conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    "nested data": {"paths": ["conv_id", "data.messages[].role", "data.messages[].content"], "list": ("data.messages", "role", "content")},
}
BY_FINGERPRINT = {fingerprint(v["paths"]): k for k, v in LAYOUTS.items()}
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), role), role)


def _turns(layout: dict, text: callable, items: callable) -> Column:
    """The turns of one row as an array. text(path) and items(path, role, text) read the row."""
    if "list" in layout:
        return F.transform(items(*layout["list"]), lambda x, i: F.struct(i.cast("long").alias("turn"), _role(x["role"]).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    made = []
    for i, (role, *paths) in enumerate(layout["turns"]):
        made.append(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.concat_ws("\n", *[F.when(text(p) != "", text(p)) for p in paths]).alias("text")))
    return F.array(*made)


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a typed table. Columns beside those of a layout are left out of the fingerprint
    if no layout takes all columns: the layout with most paths that are all there is chosen then."""
    paths = field_paths(df.schema)
    name = BY_FINGERPRINT.get(fingerprint(paths)) or max((k for k, v in LAYOUTS.items() if set(v["paths"]) <= set(paths)), key=lambda k: len(LAYOUTS[k]["paths"]), default=None)
    if name is None:
        raise ValueError(f"no layout for fields {sorted(paths)}")
    layout, conv = LAYOUTS[name], F.col("conv_id").cast("long").alias("conv_id")
    if "rows" in layout:
        turn, role, text = layout["rows"]
        return df.select(conv, F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    read = lambda at, role, text: F.transform(F.col(at), lambda x: F.struct(x[role].cast("string").alias("role"), x[text].cast("string").alias("text")))
    turns = _turns(layout, lambda p: F.col(p).cast("string"), read)
    return df.select(conv, F.explode(turns).alias("t")).select("conv_id", "t.*")


def json_fingerprint(variant: Column) -> Column:
    """Fingerprint of one variant value: its schema without types, as sorted leaf paths."""
    shape = F.schema_of_variant(variant)
    # OBJECT<a: ARRAY<OBJECT<b: STRING>>> is what schema_of_variant says; names are sorted and types are dropped
    return F.sha2(F.regexp_replace(shape, r"(?<=[:<] ?)(VOID|STRING|BIGINT|BOOLEAN|DOUBLE|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "x"), 256)


def _shape(paths: list[str]) -> str:
    """What schema_of_variant says of a layout, with x for every type."""
    tree: dict = {}
    for p in sorted(paths):
        at = tree
        for part in p.split("."):
            at = at.setdefault(part, {})
    say = lambda t: "OBJECT<" + ", ".join(f"{k.removesuffix('[]')}: " + ("ARRAY<" * k.endswith("[]")) + (say(v) if v else "x") + ">" * k.endswith("[]") for k, v in sorted(t.items())) + ">"
    return say(tree)


def canonical_turns_json(df: DataFrame, json: str = "json") -> DataFrame:
    """(conv_id, turn, role, text) of a column of JSON records, each row in any known layout.

    Rows that are no JSON or of no known layout give no turns; `unknown_layouts` reports them. Lists in which elements
    differ in their fields count by the fields of all elements together.
    """
    rows = df.select(F.try_parse_json(F.col(json)).alias("v")).withColumn("f", json_fingerprint(F.col("v")))
    text = lambda p: F.try_variant_get("v", f"$.{p}", "string")
    items = lambda at, role, text: F.transform(F.try_variant_get("v", f"$.{at}", f"array<struct<`{role}`:string,`{text}`:string>>"), lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))
    turns = F.lit(None)
    for layout in LAYOUTS.values():
        if "rows" in layout:
            made = F.array(F.struct(F.try_variant_get("v", "$.turn", "bigint").alias("turn"), _role(text("role")).alias("role"), F.coalesce(text("text"), F.lit("")).alias("text")))
        else:
            made = _turns(layout, text, items)
        turns = F.when(F.col("f") == hashlib.sha256(_shape(layout["paths"]).encode()).hexdigest(), made).otherwise(turns)
    return rows.select(F.try_variant_get("v", "$.conv_id", "bigint").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.*")


def unknown_layouts(df: DataFrame, json: str = "json") -> DataFrame:
    """(fingerprint, rows, example shape) of JSON rows that no layout takes."""
    known = [hashlib.sha256(_shape(v["paths"]).encode()).hexdigest() for v in LAYOUTS.values()]
    rows = df.select(F.try_parse_json(F.col(json)).alias("v")).select(json_fingerprint(F.col("v")).alias("fingerprint"), F.schema_of_variant("v").alias("shape"))
    return rows.where(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(known)).groupBy("fingerprint").agg(F.count("*").alias("rows"), F.min("shape").alias("shape"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit('"'), F.lit("\\q"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\q"), F.lit('"')), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the training text of each conversation, and the spans (start, length; code
    points) of it that the loss covers: the texts of role `learn`."""
    t = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit('<turn role="'), escape(F.col("role")), F.lit('">')).alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("piece", F.concat("head", "body", F.lit("</turn>")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")).cast("int")
    t = t.select("conv_id", F.struct(start.alias("start"), F.length("body").alias("length"), (F.col("role") == learn).alias("learn"), "piece").alias("p"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    spans = F.transform(F.filter("p", lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return t.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(texts: DataFrame) -> DataFrame:
    """(conv_id, turns array of (role, text), loss_text): what a formatted text says, unescaped."""
    parts = F.filter(F.split("formatted", "</turn>", -1), lambda x: x != "")
    head = len('<turn role="')

    def turn(x: Column) -> Column:
        quote = F.position(F.lit('">'), x)
        return F.struct(unescape(F.substring(x, F.lit(head + 1), quote - head - 1)).alias("role"), unescape(F.substring(x, quote + 2, F.length(x))).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    return texts.select("conv_id", F.transform(parts, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Conversation -7, in another layout than the table's.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark, sf_dir) -> DataFrame:
    """All conversations, and conversation -7 given in the `messages` layout, formatted and read back."""
    say = F.lit(CONTROL_TEXT)
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), say.alias("content")) for r in ("user", "assistant")]).alias("messages"))
    turns = canonical_turns(table(spark, sf_dir, "conversations")).unionByName(canonical_turns(extra))
    back = read_back(formatted(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), e AS (SELECT *, length(role) + length(text) + 21 + len(regexp_extract_all(role || text, '[\\<"]')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
