"""Facts out of C++ text, at declaration level, with SQL functions only.

A file is cut into lexical pieces by one regular expression; comments are blanked (their line ends stay, so line numbers hold).
Statements are what lies between `;`, `{` and `}`; running sums over a file's statements give lines and brace depth, and the
last opening of each depth gives the container. There is no type checking: what needs it comes in through `uses`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.brackets import STRING, after_calls, behind, closing, inside, items, trimmed
from corvane.functions.text import is_exposed, path_stem, prefix_kind, unix_path

# Macros of the engine's reflection system.
REFLECTION = ["UCLASS", "USTRUCT", "UENUM", "UINTERFACE", "UPROPERTY", "UFUNCTION", "UPARAM", "UMETA", "UDELEGATE"]
# Words of the language that the token classes tell apart.
KEYWORDS = ["auto", "bool", "break", "case", "catch", "char", "class", "const", "constexpr", "continue", "default", "delete", "do", "double", "else", "enum", "explicit", "extern", "false", "final", "float", "for", "friend", "goto", "if", "inline", "int", "long", "mutable", "namespace", "new", "noexcept", "nullptr", "operator", "override", "private", "protected", "public", "return", "short", "signed", "sizeof", "static", "struct", "switch", "template", "this", "throw", "true", "try", "typedef", "typename", "union", "unsigned", "using", "virtual", "void", "while"]

_PIECES = rf"(?s){STRING}|'(?:[^'\\\n]++|\\.)*+'|//[^\n]*|/\*.*?(?:\*/|\z)|[^\"'/]++|."


def without_comments(content: Column, strings: bool = True) -> Column:
    """The text with comments blanked; without strings, literals become empty ones."""

    def piece(t: Column) -> Column:
        blank = F.when(F.startswith(t, F.lit("/*")), F.regexp_replace(t, r"[^\n]", "")).when(F.startswith(t, F.lit("//")), "")
        return (blank if strings else blank.when(F.startswith(t, F.lit('"')), '""')).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(_PIECES), 0), piece), "")


def lines_in(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def extract_reflection(files: DataFrame) -> DataFrame:
    """(path, line, macro, specifiers, meta, declaration): each reflection macro with its specifiers, its meta keys, and the text that follows."""
    names = "|".join(REFLECTION)
    cut = F.split(without_comments(F.col("content")), rf"(?=\b(?:{names})\s*\()")
    rows = files.select("path", F.posexplode(cut).alias("n", "text"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", F.coalesce(F.sum(lines_in(F.col("text"))).over(w), F.lit(0)) + 1)
    rows = macro_calls(rows, rf"^({names})\s*(?=\()").withColumn("items", items(F.col("args")))
    is_meta = lambda x: x.rlike(r"^meta\s*=")
    inner = F.regexp_extract(F.coalesce(F.get(F.filter("items", is_meta), F.lit(0)), F.lit("")), r"(?s)^meta\s*=\s*\((.*)\)$", 1)
    key = lambda x: F.trim(F.regexp_extract(x, r"^([^=]*)", 1))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)), r'(?s)^"(.*)"$', "$1")
    entries = F.transform(items(inner), lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    first = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    meta = F.map_from_entries(F.transform(first, lambda k: F.struct(k.alias("key"), F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"].alias("value"))))
    rest = F.regexp_extract(trimmed(F.col("rest")), r"(?s)^([^;{]*)", 1)
    return rows.select("path", F.col("line").cast("int").alias("line"), "macro", F.filter("items", lambda x: ~is_meta(x)).alias("specifiers"), meta.alias("meta"), F.trim(F.regexp_replace(rest, r"\s+", " ")).alias("declaration"))


def macro_calls(rows: DataFrame, head: str) -> DataFrame:
    """Rows whose text begins with a call, with macro (the name), args (what is in its parentheses) and rest. head: a pattern of the name up to the parenthesis."""
    rows = rows.where(F.col("text").rlike(head)).withColumn("macro", F.regexp_extract("text", head, 1))
    called = F.substring(F.col("text"), F.length(F.regexp_extract("text", head, 0)) + 1, F.length("text"))
    rows = rows.withColumn("_call", called).withColumn("_end", closing(F.col("_call"))).where("_end > 0")
    return rows.withColumn("args", F.expr("substring(_call, 2, _end - 2)")).withColumn("rest", F.expr("substring(_call, _end + 1, length(_call))")).drop("_call", "_end")


def extract_includes(files: DataFrame) -> DataFrame:
    """(path, line, target_text) of include lines, in order."""
    rows = files.select("path", F.posexplode(F.split(without_comments(F.col("content")), "\n")).alias("n", "text"))
    target = F.regexp_extract("text", r'^\s*#\s*include\s*["<]([^">]+)[">]', 1)
    return rows.select("path", (F.col("n") + 1).alias("line"), target.alias("target_text")).where("target_text <> ''")


def statements(files: DataFrame) -> DataFrame:
    """(path, n, text, line, end_line, depth, container, opens): the statements of each file with line range, brace depth and innermost container."""
    clean = F.regexp_replace(without_comments(F.col("content"), strings=False), r"(?m)^[ \t]*#(?:[^\n\\]++|\\\r?\n|\\.)*+", "")
    # a default value in braces, which ends with its parameter, is no block
    clean = F.regexp_replace(clean, r"(=\s*)\{([^{};]*)\}(?=\s*[,)])", "$1($2)")
    rows = files.select("path", F.posexplode(F.split(clean, r"(?<=[;{}])|(?<=\b(?:public|protected|private):)")).alias("n", "raw"))
    w = Window.partitionBy("path").orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lead = F.length("raw") - F.length(F.ltrim(F.regexp_replace("raw", r"^\s+", "")))
    step = F.when(F.endswith("raw", F.lit("{")), 1).when(F.endswith("raw", F.lit("}")), -1).otherwise(0)
    first = F.coalesce(F.sum(lines_in(F.col("raw"))).over(before), F.lit(0)) + 1
    rows = rows.withColumn("line", first + lines_in(F.substring(F.col("raw"), F.lit(1), lead))).withColumn("end_line", first + lines_in(F.col("raw"))).withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)))
    rows = rows.withColumn("text", F.trim(F.regexp_replace("raw", r"\s+", " "))).withColumn("opens", F.endswith("raw", F.lit("{")))
    named = F.nullif(F.regexp_extract("text", r"\b(?:class|struct|union|enum(?: class)?|namespace)\s+(?:\w+_API\s+)?(\w+)(?:\s+final)?\s*(?::[^:].*)?\{$", 1), F.lit(""))
    rows = rows.withColumn("_name", named).where("text <> ''")
    # an opening brace is the container of the depth below it until the next one that opens there
    level = F.explode(F.when(F.col("opens"), F.array(F.struct(F.lit(0).alias("role"), F.col("depth").alias("level")), F.struct(F.lit(1).alias("role"), (F.col("depth") + 1).alias("level")))).otherwise(F.array(F.struct(F.lit(0).alias("role"), F.col("depth").alias("level")))))
    both = rows.withColumn("_l", level)
    inside = Window.partitionBy("path", "_l.level").orderBy("n", "_l.role").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("_l.role") == 1, F.struct("_name")), ignorenulls=True).over(inside)
    return both.withColumn("container", opened["_name"]).where("_l.role = 0").select("path", "n", "text", F.col("line").cast("int"), F.col("end_line").cast("int"), F.col("depth").cast("int"), "container", "opens")


def extract_declarations(files: DataFrame) -> DataFrame:
    """(path, line, end_line, kind, name, container, bases, params, type_text, flags): types, functions, fields, enum values, namespaces, macros, declaration level only."""
    s = statements(files)
    s = s.withColumn("text", after_calls(F.col("text"), [*REFLECTION, "GENERATED_BODY", "GENERATED_UCLASS_BODY"])).withColumn("text", F.trim(F.regexp_replace("text", r"^(?:public|protected|private)\s*:\s*", "")))
    # what stands before the first parenthesis, in it, and behind it
    opens = F.instr("text", "(")
    called = F.substring(F.col("text"), opens, F.length("text"))
    s = s.withColumn("_head", F.when(opens > 0, F.left(F.col("text"), opens - 1))).withColumn("_args", F.when(opens > 0, inside(called))).withColumn("_tail", F.when(opens > 0, behind(called)))
    kind_re = r"^(?:template\s*<[^>]*>\s*)?(class|struct|union|enum(?: class)?|namespace)\s+(?:\w+_API\s+)?(\w+)(?:\s+final)?\s*(?::([^:].*?))?\s*\{$"
    head_re = r"^((?:(?:virtual|static|inline|explicit|constexpr|friend|FORCEINLINE|extern|\w+_API)\s+)*+)([\w:<>,&*\s]*?)\s*\b(~?\w+(?:::~?\w+)*+)\s*$"
    tail_re = r"^\s*((?:const|override|final|noexcept)\b\s*)*+(=\s*0|=\s*default|=\s*delete)?\s*(?::[^:].*)?[;{]$"
    field_re = r"^((?:(?:static|const|mutable|constexpr|inline)\s+)*+)([\w:<>,&*\s]+?[\s&*>])(\w+)\s*(?:\[[^\]]*\])?\s*(?:=.*|\{)?;?$"
    starts = lambda words: F.col("text").rlike(rf"^(?:{words})\b")
    s = s.withColumn("_type", F.col("text").rlike(kind_re)).withColumn("_func", ~F.col("_type") & F.coalesce(F.col("_head").rlike(head_re) & F.col("_tail").rlike(tail_re), F.lit(False)) & ~starts("if|for|while|switch|return|else|do|catch"))
    s = s.withColumn("_field", ~F.col("_type") & ~F.col("_func") & F.endswith("text", F.lit(";")) & F.col("text").rlike(field_re) & ~starts("return|using|typedef|friend|delete|goto|break|continue|class|struct|enum"))
    is_type, is_func, is_field = (F.col(c) for c in ("_type", "_func", "_field"))
    g = lambda r, i, c="text": F.trim(F.regexp_extract(c, r, i))
    kind = F.when(is_type, g(kind_re, 1)).when(is_func, F.lit("function")).when(is_field, F.lit("field"))
    name = F.when(is_type, g(kind_re, 2)).when(is_func, g(head_re, 3, "_head")).otherwise(g(field_re, 3))
    bases = F.transform(F.filter(F.split(g(kind_re, 3), ","), lambda b: F.trim(b) != ""), lambda b: F.regexp_replace(F.trim(b), r"^(?:(?:public|protected|private|virtual)\s+)*", ""))
    param = lambda p: F.struct(F.trim(F.regexp_replace(F.regexp_replace(p, r"=.*$", ""), r"\b\w+\s*$", "")).alias("type"), F.regexp_extract(F.regexp_replace(p, r"\s*=.*$", ""), r"[\s&*>](\w+)\s*$", 1).alias("name"), F.contains(p, F.lit("=")).alias("has_default"))
    params = F.transform(F.filter(items(F.col("_args"), angles=True), lambda x: x != "void"), param)
    told = F.struct(
        F.when(kind.startswith("enum"), "enum").otherwise(kind).alias("kind"), name.alias("name"),
        F.when(is_type & ~g(kind_re, 1).startswith("enum"), bases).alias("bases"), F.when(is_func, params).alias("params"), F.when(is_func, g(head_re, 2, "_head")).when(is_field, g(field_re, 2)).alias("type_text"),
        F.coalesce(F.when(is_func, F.col("_head").rlike(r"\bvirtual\b")), F.lit(False)).alias("is_virtual"), F.col("text").rlike(r"\bstatic\b").alias("is_static"),
        F.col("text").rlike(r"\)\s*(?:const\s+)?override\b").alias("is_override"), F.col("text").rlike(r"\)\s*[\w\s]*\bfinal\b").alias("is_final"), F.col("text").rlike(r"\)\s*const\b").alias("is_const"), F.col("text").rlike(r"=\s*0\s*;$").alias("is_pure"), (is_func & F.col("opens")).alias("has_body"),
    )

    def declares(d: Column) -> Column:
        """What lies in function bodies, and macro calls, are no declarations."""
        made = (d["type_text"] != "") | d["name"].contains("::") | d["name"].startswith("~") | (d["name"] == F.col("container"))
        return d["kind"].isNotNull() & (~d["kind"].isin("function", "field") | (((F.col("depth") == 0) | F.col("container").isNotNull()) & F.coalesce(made, F.lit(False))))

    # exploded, so that filters on what is told aren't put in its place, over and over
    out = s.select("path", "line", "end_line", "container", F.explode(F.filter(F.array(told), declares)).alias("_d")).select("path", "line", "end_line", "container", "_d.*")
    # the old style enum: namespace X { enum Type { ... } } is an enum named X
    inner = (F.col("kind") == "enum") & (F.col("name") == "Type") & F.col("container").isNotNull()
    named = Window.partitionBy("path", F.when(inner, F.col("container")).otherwise(F.col("name")))
    out = out.withColumn("_enum", F.max(inner).over(named))
    return out.select("path", "line", "end_line", F.when((F.col("kind") == "namespace") & F.col("_enum"), "enum").otherwise(F.col("kind")).alias("kind"), *[c for c in out.columns if c not in ("path", "line", "end_line", "kind", "_enum")])


def extract_delegates(files: DataFrame) -> DataFrame:
    """(path, line, macro, type_name, params, is_dynamic, is_multicast, returns, errors) of delegate declarations, with what is wrong in them."""
    cut = F.split(without_comments(F.col("content")), r"(?=\bDECLARE_\w*DELEGATE\w*\s*\()")
    rows = files.select("path", F.posexplode(cut).alias("n", "text"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", (F.coalesce(F.sum(lines_in(F.col("text"))).over(w), F.lit(0)) + 1).cast("int"))
    rows = macro_calls(rows, r"^(DECLARE_\w*DELEGATE\w*)\s*(?=\()")
    # the preprocessor cuts at every comma that isn't in parentheses, also inside angle brackets
    dynamic, multicast, returns = F.col("macro").contains("DYNAMIC"), F.col("macro").contains("MULTICAST"), F.col("macro").contains("RetVal")
    rows = rows.withColumn("items", items(F.col("args"))).withColumn("type_name", F.get("items", F.when(returns, 1).otherwise(0)))
    rows = rows.withColumn("params", F.slice("items", F.when(returns, 3).otherwise(2), F.size("items")))
    words = {"One": 1, "Two": 2, "Three": 3, "Four": 4, "Five": 5, "Six": 6, "Seven": 7, "Eight": 8, "Nine": 9}
    told = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.nullif(F.regexp_extract("macro", r"_([A-Za-z]+)Params?$", 1), F.lit(""))), F.lit(0))
    expected = F.when(dynamic, told * 2).otherwise(told)
    wrong = F.array_compact(F.array(
        F.when(F.exists("params", lambda p: p.rlike("<[^>]*$")), "comma in a type"),
        F.when(dynamic & ~F.exists("params", lambda p: p.rlike("<[^>]*$")) & (F.size("params") == told) & (told > 0), "parameter name missing"),
        F.when(multicast & returns, "multicast delegates return nothing"),
        F.when((F.size("params") != expected) & ~(dynamic & (F.size("params") == told)) & ~F.exists("params", lambda p: p.rlike("<[^>]*$")), "wrong number of parameters"),
    ))
    return rows.select("path", "line", "macro", "type_name", "params", dynamic.alias("is_dynamic"), multicast.alias("is_multicast"), returns.alias("returns"), wrong.alias("errors"))


def expand_generated_names(macro_uses: DataFrame) -> DataFrame:
    """(path, line, name, container) of names that macros make: macro_uses (path, line, macro, args array)."""
    accessors = F.transform(F.array(F.lit("Get{}"), F.lit("Set{}"), F.lit("Init{}"), F.lit("Get{}Attribute")), lambda p: F.replace(p, F.lit("{}"), F.get("args", F.lit(1))))
    names = F.when(F.col("macro") == "ATTRIBUTE_ACCESSORS", accessors).when(F.col("macro") == "REGISTER_NAME", F.array(F.concat(F.lit("NAME_"), F.get("args", F.size("args") - 1))))
    return macro_uses.select("path", "line", F.explode(names).alias("name"), F.when(F.col("macro") == "ATTRIBUTE_ACCESSORS", F.get("args", F.lit(0))).alias("container"))


def expected_definitions(symbols: DataFrame) -> DataFrame:
    """(symbol_id, container_id, name): functions to be written for native events and remote calls."""
    has = lambda s: F.array_contains("specifiers", s)
    remote = has("Server") | has("Client") | has("NetMulticast")
    none = F.col("is_pure") | has("BlueprintImplementableEvent") | F.col("in_interface")
    made = F.array_compact(F.array(F.when(has("BlueprintNativeEvent") | remote, F.concat("name", F.lit("_Implementation"))), F.when(remote & has("WithValidation"), F.concat("name", F.lit("_Validate")))))
    return symbols.where(~F.coalesce(none, F.lit(False))).select("symbol_id", "container_id", F.explode(made).alias("name"))


def pair_header_source(files: DataFrame) -> DataFrame:
    """(header, source): files of one module and relative stem, Public and Classes facing Private."""
    key = F.regexp_replace(F.regexp_replace(unix_path("path"), r"\.[^./]*$", ""), r"/(Public|Classes|Private)/", "/")
    k = files.select("path", key.alias("_key"))
    return k.where(F.lower("path").rlike(r"\.h$")).select("_key", F.col("path").alias("header")).join(k.where(F.lower("path").rlike(r"\.cpp$")).select("_key", F.col("path").alias("source")), "_key").select("header", "source")


#: Lexical tokens.
_TOKENS = rf"(?s)//[^\n]*|/\*.*?(?:\*/|\z)|{STRING}|'(?:[^'\\\n]++|\\.)*+'|(?m:^[ \t]*#[ \t]*\w+)|\d[\w.']*|[\p{{L}}\p{{N}}_]+|[^\s\w]"


def word_counts(files: DataFrame) -> DataFrame:
    """(path, n): identifiers and keywords of each file, as tokenize tells them, counted without a row per token."""
    is_word = lambda t: t.rlike(r"^[\p{L}_]") & ~t.isin([*REFLECTION, "GENERATED_BODY"])
    words = F.filter(F.regexp_extract_all("content", F.lit(_TOKENS), 0), is_word)
    return files.select("path", F.coalesce(F.size(words), F.lit(0)).cast("long").alias("n"))


def tokenize(files: DataFrame) -> DataFrame:
    """(path, n, token, kind): lexical tokens in order, with their class."""
    t = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(_TOKENS), 0)).alias("n", "token"))
    starts = lambda x: F.startswith("token", F.lit(x))
    kind = (
        F.when(starts("///") | starts("/**"), "doc comment").when(starts("//") | starts("/*"), "comment").when(starts('"') | starts("'"), "string").when(F.ltrim("token").startswith("#"), "directive")
        .when(F.col("token").rlike(r"^\d"), "number").when(F.col("token").isin(REFLECTION + ["GENERATED_BODY"]), "reflection macro").when(F.col("token").isin(KEYWORDS), "keyword").when(F.col("token").rlike(r"^[\p{L}_]"), "identifier").otherwise("punctuation")
    )
    return t.withColumn("token", F.trim("token")).withColumn("kind", kind)


def classify_tokens(tokens: DataFrame, symbols: DataFrame, anc: DataFrame | None = None) -> DataFrame:
    """Identifier tokens with `class`, and with `exposed` where symbols have specifiers.

    The class is the kind of the symbol of that name (of several kinds the first by name); for types below AActor or UObject, where
    ancestors are given (symbols with symbol_id then), it is actor or object; else what the name's prefix says. A name is exposed if some symbol of it is.
    """
    kind, known = F.col("kind"), symbols
    if anc is not None:
        roots = symbols.where("name in ('AActor', 'UObject')").select(F.col("symbol_id").alias("ancestor_id"), F.col("name").alias("_root"))
        up = anc.join(roots, "ancestor_id").groupBy(F.col("type_id").alias("symbol_id")).agg(F.min("_root").alias("_root"))
        known = symbols.join(up, "symbol_id", "left")
        kind = F.when(F.col("_root") == "AActor", "actor").when(F.col("_root") == "UObject", "object").otherwise(kind)
    exposed = F.max(is_exposed("specifiers")) if "specifiers" in symbols.columns else F.lit(False)
    known = known.groupBy("name").agg(F.min(kind).alias("_kind"), exposed.alias("_exposed"))
    out = tokens.where("kind = 'identifier'").join(known, tokens["token"] == known["name"], "left")
    more = [F.coalesce("_exposed", F.lit(False)).alias("exposed")] if "specifiers" in symbols.columns else []
    return out.select(*tokens.columns, F.coalesce("_kind", prefix_kind("token")).alias("class"), *more)


def generated_header(path: str | Column = "path") -> Column:
    return F.concat(path_stem(path), F.lit(".generated.h"))
