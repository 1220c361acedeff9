"""Inspections: each rule is a set operation over the core tables that gives findings.

tables: name to DataFrame, as in `corvane.schemas`, with `types` (type_id = symbol_id), `ancestors`, `members` and others
where a rule says so. A rule whose tables are missing is left out by `inspect_all`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.brackets import STRING, behind, items
from corvane.functions.text import format_arity, name_prefix, path_stem, pointee_type
from corvane.operators.extract import macro_calls, expected_definitions, lines_in, without_comments
from corvane.operators.usages import conflicting_specifiers

RULES: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}
COLUMNS = ["path", "line", "rule", "severity", "symbol", "message", "fix"]


def rule(f: Callable) -> Callable:
    RULES[f.__name__.removeprefix("inspect_")] = f
    return f


def findings(df: DataFrame, name: str, severity: str, message: str | Column, fix: Column | None = None, symbol: str = "name") -> DataFrame:
    """Rows with path and line as findings."""
    said = F.lit(message) if isinstance(message, str) else message
    what = F.col(symbol).cast("string") if symbol in df.columns else F.lit(None).cast("string")
    return df.select("path", F.col("line").cast("int").alias("line"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), what.alias("symbol"), said.alias("message"), (F.lit(None).cast("string") if fix is None else fix).alias("fix"))


def has(spec: str) -> Column:
    return F.coalesce(F.array_contains("specifiers", spec), F.lit(False))


def _reflected_headers(t: dict) -> DataFrame:
    return t["symbols"].where("macro in ('UCLASS', 'USTRUCT', 'UENUM', 'UINTERFACE')").where(F.lower("path").endswith(".h")).groupBy("path").agg(F.min("line").alias("line"))


def _generated(t: dict) -> DataFrame:
    return t["includes"].where(F.col("target_text").endswith(".generated.h"))


@rule
def inspect_generated_missing(t: dict) -> DataFrame:
    return findings(_reflected_headers(t).join(_generated(t).select("path"), "path", "left_anti"), "generated_missing", "error", "the generated header isn't included", F.concat(F.lit('#include "'), path_stem("path"), F.lit('.generated.h"')))


@rule
def inspect_generated_not_last(t: dict) -> DataFrame:
    last = t["includes"].groupBy("path").agg(F.max("line").alias("_last"))
    return findings(_generated(t).join(last, "path").where("line < _last"), "generated_not_last", "error", "the generated header isn't the last include", symbol="target_text")


@rule
def inspect_generated_name(t: dict) -> DataFrame:
    wrong = F.regexp_extract("target_text", r"([^/\\]*)\.generated\.h$", 1) != path_stem("path")
    return findings(_generated(t).where(wrong), "generated_name", "error", "the generated header has another name than the file", F.concat(path_stem("path"), F.lit(".generated.h")), "target_text")


@rule
def inspect_generated_body(t: dict) -> DataFrame:
    bodies = t["macro_uses"].where("macro in ('GENERATED_BODY', 'GENERATED_UCLASS_BODY', 'GENERATED_USTRUCT_BODY')").select("path", F.col("line").alias("_at"))
    s = t["symbols"].where("macro in ('UCLASS', 'USTRUCT', 'UINTERFACE')")
    return findings(s.join(bodies, (s["path"] == bodies["path"]) & F.col("_at").between(s["line"], s["end_line"]), "left_anti"), "generated_body", "error", "the type has no GENERATED_BODY()", F.lit("GENERATED_BODY()"))


@rule
def inspect_prefix(t: dict) -> DataFrame:
    """Actors take A, other objects U, structs F, enums E, interfaces I; unreflected types are not asked."""
    up = t["ancestors"].join(t["symbols"].select(F.col("symbol_id").alias("ancestor_id"), F.col("name").alias("_base")), "ancestor_id").where("_base in ('AActor', 'UObject')").groupBy("type_id").agg(F.max(F.when(F.col("_base") == "AActor", 2).otherwise(1)).alias("_up"))
    s = t["symbols"].where("macro in ('UCLASS', 'USTRUCT', 'UENUM')").join(up.withColumnRenamed("type_id", "symbol_id"), "symbol_id", "left")
    want = F.when(F.col("macro") == "USTRUCT", "F").when(F.col("macro") == "UENUM", "E").when((F.col("_up") == 2) | (F.col("name") == "AActor"), "A").otherwise("U")
    return findings(s.where(~name_prefix("name").eqNullSafe(want)), "prefix", "error", F.concat(F.lit("the name takes the prefix "), want), F.concat(want, F.regexp_replace("name", "^[AUFEI](?=[A-Z])", "")))


@rule
def inspect_private_exposed(t: dict) -> DataFrame:
    open_ = F.coalesce(F.lower(F.element_at("meta", "AllowPrivateAccess")) == "true", F.lit(False))
    return findings(t["symbols"].where((F.col("access") == "private") & (has("BlueprintReadWrite") | has("BlueprintReadOnly")) & ~open_), "private_exposed", "error", "a private property is exposed without AllowPrivateAccess", F.lit('meta = (AllowPrivateAccess = "true")'))


def _specifiers(t: dict) -> DataFrame:
    return t["symbols"].select("symbol_id", "path", "line", "name", "macro", F.explode("specifiers").alias("_spec")).withColumn("specifier", F.trim(F.regexp_extract("_spec", r"^([^=]*)", 1))).withColumn("value", F.regexp_extract("_spec", r'=\s*"?([^"]*)"?\s*$', 1))


@rule
def inspect_conflicts(t: dict) -> DataFrame:
    c = conflicting_specifiers(_specifiers(t), t["specifier_catalog"])
    return findings(c.join(t["symbols"].select("symbol_id", "path", "line", "name"), "symbol_id"), "conflicts", "error", F.concat("specifier", F.lit(" excludes "), F.array_join("conflicts", ", ")))


@rule
def inspect_pure_without_output(t: dict) -> DataFrame:
    out = F.exists("params", lambda p: F.contains(p["type"], F.lit("&")) & ~p["type"].rlike(r"\bconst\b"))
    return findings(t["symbols"].where(has("BlueprintPure") & (F.trim("type_text") == "void") & ~F.coalesce(out, F.lit(False))), "pure_without_output", "error", "a pure function gives nothing")


@rule
def inspect_function_in_struct(t: dict) -> DataFrame:
    structs = t["symbols"].where("macro = 'USTRUCT'").select(F.col("symbol_id").alias("container_id"))
    return findings(t["symbols"].where("macro = 'UFUNCTION'").join(structs, "container_id", "left_semi"), "function_in_struct", "error", "a reflected struct can't have reflected functions")


def _inherited(t: dict, own: DataFrame) -> DataFrame:
    """own (container_id, ...) for each container and, where ancestors are given, for all types below it."""
    if "ancestors" not in t:
        return own
    below = t["ancestors"].select(F.col("type_id").alias("_type"), F.col("ancestor_id").alias("container_id"))
    return own.unionByName(below.join(own, "container_id").drop("container_id").withColumnRenamed("_type", "container_id"))


@rule
def inspect_replicated_using(t: dict) -> DataFrame:
    """The function may be the class's own or a base's."""
    own = _inherited(t, t["symbols"].where("macro = 'UFUNCTION'").select("container_id", F.col("name").alias("value")))
    s = _specifiers(t).where("specifier = 'ReplicatedUsing'").join(t["symbols"].select("symbol_id", "container_id"), "symbol_id")
    return findings(s.join(own, ["container_id", "value"], "left_anti"), "replicated_using", "error", F.concat(F.lit("no reflected function is named "), "value"), F.concat(F.lit("OnRep_"), "name"))


@rule
def inspect_replication_list(t: dict) -> DataFrame:
    props = t["symbols"].where(has("Replicated") | F.exists("specifiers", lambda x: F.startswith(x, F.lit("ReplicatedUsing"))))
    have = t["symbols"].where("name = 'GetLifetimeReplicatedProps'").select("container_id")  # the list of a base doesn't hold them
    return findings(props.join(have, "container_id", "left_anti"), "replication_list", "error", "the class has no GetLifetimeReplicatedProps")


@rule
def inspect_missing_definitions(t: dict) -> DataFrame:
    e = expected_definitions(t["symbols"].withColumn("in_interface", F.lit(False)) if "in_interface" not in t["symbols"].columns else t["symbols"])
    gone = e.join(t["symbols"].where("has_body").select("container_id", "name"), ["container_id", "name"], "left_anti").withColumnRenamed("name", "_wanted")
    s = gone.join(t["symbols"].select("symbol_id", "path", "line", "name", "type_text"), "symbol_id")
    stub = F.concat_ws(" ", F.coalesce("type_text", F.lit("void")), F.concat("container_id", F.lit("::"), "_wanted", F.lit("()\n{\n}")))
    return findings(s, "missing_definitions", "error", F.concat("_wanted", F.lit(" isn't defined")), stub)


@rule
def inspect_specifiers(t: dict) -> DataFrame:
    c = t["specifier_catalog"].select("macro", "specifier", F.col("needs_value").alias("_needs"), F.lit(True).alias("_known"))
    s = _specifiers(t).join(c, ["macro", "specifier"], "left").where(F.col("_known").isNull() | (F.col("_needs") & (F.col("value") == "")))
    return findings(s, "specifiers", "error", F.concat("specifier", F.when(F.col("_known").isNull(), " is unknown").otherwise(" lacks its value")))


def _object_pointers(t: dict) -> DataFrame:
    objects = t["ancestors"].join(t["symbols"].where("name = 'UObject'").select(F.col("symbol_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("type_id")
    names = t["symbols"].join(objects.withColumnRenamed("type_id", "symbol_id"), "symbol_id", "left_semi").select("name").unionByName(t["symbols"].where("name = 'UObject'").select("name")).distinct()
    fields = t["symbols"].where("kind = 'field'").where(F.col("type_text").rlike(r"^\s*(const\s+)?(class\s+)?\w+\s*\*\s*$"))
    return fields.withColumn("_pointee", pointee_type("type_text")).join(names.withColumnRenamed("name", "_pointee"), "_pointee", "left_semi")


@rule
def inspect_object_ptr(t: dict) -> DataFrame:
    return findings(_object_pointers(t).where("macro = 'UPROPERTY'"), "object_ptr", "suggestion", "a reflected object pointer may be a TObjectPtr", F.concat(F.lit("TObjectPtr<"), pointee_type("type_text"), F.lit(">")))


@rule
def inspect_untracked_pointer(t: dict) -> DataFrame:
    return findings(_object_pointers(t).where("macro is null"), "untracked_pointer", "error", "an object pointer is neither reflected nor smart", F.lit("UPROPERTY()"))


@rule
def inspect_assignable(t: dict) -> DataFrame:
    fixed = t["delegates"].where("not is_dynamic").select(F.trim("type_name").alias("_type"))
    s = t["symbols"].where(has("BlueprintAssignable")).withColumn("_type", F.trim("type_text"))
    return findings(s.join(fixed, "_type", "left_semi"), "assignable", "error", "the delegate isn't dynamic")


@rule
def inspect_const_writes(t: dict) -> DataFrame:
    s = t["symbols"].select("symbol_id", F.col("is_const").alias("_const"))
    f = t["symbols"].where("is_const and kind = 'function'").select(F.col("symbol_id").alias("in_function_id"), F.col("container_id").alias("_own"))
    u = t["uses"].where("use_kind = 'write'").join(s, "symbol_id", "left").join(f, "in_function_id", "left")
    bad = F.col("_const") | F.col("receiver_const") | F.col("_own").eqNullSafe(F.col("receiver_type")) & F.col("_own").isNotNull()
    return findings(u.where(F.coalesce(bad, F.lit(False))), "const_writes", "error", "a constant is written to")


@rule
def inspect_const_calls(t: dict) -> DataFrame:
    s = t["symbols"].where("kind = 'function' and not is_const and not is_static").select("symbol_id")
    return findings(t["uses"].where("use_kind = 'call' and receiver_const").join(s, "symbol_id", "left_semi"), "const_calls", "error", "a function that isn't const is called on a constant object")


@rule
def inspect_unknown_member(t: dict) -> DataFrame:
    m = t["members"].select(F.col("type_id").alias("receiver_type"), "name").distinct()
    known = m.select("receiver_type").distinct()
    return findings(t["uses"].where("receiver_type is not null").join(known, "receiver_type", "left_semi").join(m, ["receiver_type", "name"], "left_anti"), "unknown_member", "error", "the type has no such member")


@rule
def inspect_argument_count(t: dict) -> DataFrame:
    p = t["symbols"].where("kind = 'function' and params is not null").select(F.col("container_id").alias("receiver_type"), "name", F.size(F.filter("params", lambda x: ~F.coalesce(x["has_default"], F.lit(False)))).alias("_lo"), F.size("params").alias("_hi"))
    calls = t["uses"].where("use_kind = 'call' and receiver_type is not null and argc is not null").join(p.select("receiver_type", "name").distinct(), ["receiver_type", "name"], "left_semi")
    o = p.toDF("_t", "_n", "_lo", "_hi")
    ok = (calls["receiver_type"] == o["_t"]) & (calls["name"] == o["_n"]) & calls["argc"].between(o["_lo"], o["_hi"])
    return findings(calls.join(o, ok, "left_anti"), "argument_count", "error", "no overload takes that many arguments")


@rule
def inspect_access(t: dict) -> DataFrame:
    return findings(t["access_checks"].where("not accessible"), "access", "error", F.concat(F.lit("the member is "), "access"))


#: What to look for in code without comments and strings; conditions and statements may go over several lines.
ASSIGNMENT_IN_IF = r"^(?:if|while)\s*\(\s*[\w.\->\[\]]+\s*=(?!=)[^=;]*\)"
CONDITION = r"^(?:if|for|while)\s*(?=\()"
SELF_ASSIGNMENT = r"^([\w.\->\[\]:]+)\s*=\s*\1\s*;"


def code_pieces(files: DataFrame, at: str) -> DataFrame:
    """(path, line, text, before): the code of each file cut where the pattern `at` matches, with the line of each piece's first word and what ends the piece before."""
    cut = F.split(without_comments(F.col("content"), strings=False), at)
    rows = files.select("path", F.posexplode(cut).alias("n", "raw"))
    w = Window.partitionBy("path").orderBy("n")
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    above = F.coalesce(F.sum(lines_in(F.col("raw"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.coalesce(F.right(F.regexp_replace(F.lag("raw").over(w), r"\s+$", ""), F.lit(1)), F.lit(""))
    return rows.select("path", (above + 1 + lines_in(F.substring(F.col("raw"), F.lit(1), lead))).alias("line"), F.regexp_replace("raw", r"^\s+", "").alias("text"), end.alias("before"))


#: Pieces that begin with a condition, and statements.
_CONDITIONS, _STATEMENTS = r"(?=\b(?:if|for|while)\s*\()", r"(?<=[;{}])"


@rule
def inspect_assignment_in_condition(t: dict) -> DataFrame:
    found = code_pieces(t["source_files"], _CONDITIONS).where(F.col("text").rlike(ASSIGNMENT_IN_IF))
    return findings(found, "assignment_in_condition", "warning", "an assignment is the condition")


def _behind_condition(text: Column) -> Column:
    return behind(F.substring(text, F.length(F.regexp_extract(text, CONDITION, 0)) + 1, F.length(text)))


@rule
def inspect_empty_statement(t: dict) -> DataFrame:
    """A `while` right after a closing brace ends a do loop."""
    found = code_pieces(t["source_files"], _CONDITIONS).where(F.col("text").rlike(CONDITION)).where(_behind_condition(F.col("text")).rlike(r"^\s*;")).where(~(F.startswith("text", F.lit("while")) & (F.col("before") == "}")))
    return findings(found, "empty_statement", "warning", "a semicolon is the whole body")


@rule
def inspect_self_assignment(t: dict) -> DataFrame:
    found = code_pieces(t["source_files"], _STATEMENTS).where(F.col("text").rlike(SELF_ASSIGNMENT))
    return findings(found, "self_assignment", "warning", "a value is assigned to itself")


@rule
def inspect_format_arguments(t: dict) -> DataFrame:
    """Log and format calls (path, line, format, n_args): conversions against arguments; found in the text of the files."""
    text = without_comments(F.col("content"))
    cut = F.split(text, r"(?=\b(?:UE_LOG|FString::Printf)\s*\()")
    rows = t["source_files"].select("path", F.posexplode(cut).alias("n", "text"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", F.coalesce(F.sum(lines_in(F.col("text"))).over(w), F.lit(0)) + 1)
    rows = macro_calls(rows, r"^(UE_LOG|FString::Printf)\s*(?=\()").withColumn("_items", items(F.col("args")))
    first = F.when(F.col("macro") == "UE_LOG", 2).otherwise(0)
    literal = rf"(?s)^TEXT\s*\(\s*({STRING})\s*\)$"
    rows = rows.withColumn("_format", F.get("_items", first)).where(F.col("_format").rlike(literal)).withColumn("_args", F.size("_items") - first - 1)
    return findings(rows.where(format_arity(F.regexp_extract("_format", literal, 1)) != F.col("_args")), "format_arguments", "warning", "conversions and arguments differ in number")


def inspect_all(tables: dict[str, DataFrame], rules: list[str] | None = None) -> DataFrame:
    """The findings of all rules, or of those named; without `rules`, ones whose tables are missing are left out."""
    parts = []
    for name, f in RULES.items():
        if rules is not None and name not in rules:
            continue
        try:
            parts.append(f(tables))
        except KeyError:
            if rules is not None:
                raise
    return reduce(DataFrame.unionByName, parts)


def error_list(found: DataFrame) -> DataFrame:
    """Findings without suggestions."""
    return found.where("severity <> 'suggestion'")


def filter_diagnostics(diagnostics: DataFrame, headers: DataFrame, stale: DataFrame, events: DataFrame, mode: str = "HideFalse") -> DataFrame:
    """Diagnostics that are worth showing.

    headers: path (file that reports), target_text of includes whose header exists. stale: path of files whose generated header is missing or older.
    events: name of reflected functions. HideFalse hides, in a file where an existing header "can't be opened", all but really missing includes;
    with a stale generated header, errors on reflection macros, generated names and on definitions made from a reflected function.
    """
    if mode == "ShowAll":
        return diagnostics
    if mode == "HideAll":
        return diagnostics.where(F.lit(False))
    d = diagnostics.withColumn("_include", F.col("code") == "E1696").withColumn("_target", F.regexp_extract("message", r'"([^"]+)"', 1))
    real = headers.select("path", F.col("target_text").alias("_target"), F.lit(True).alias("_exists")).distinct()
    d = d.join(real, ["path", "_target"], "left").withColumn("_false", F.col("_include") & F.col("_exists").isNotNull())
    d = d.join(d.where("_false").select("path", F.lit(True).alias("_broken")).distinct(), "path", "left")
    d = d.join(stale.select("path", F.lit(True).alias("_stale")).distinct(), "path", "left")
    stem = F.regexp_replace(F.regexp_replace("token", "^Execute_", ""), "_(Implementation|Validate)$", "")
    d = d.withColumn("_event", F.when(stem != F.col("token"), stem)).join(events.select(F.col("name").alias("_event"), F.lit(True).alias("_has")).distinct(), "_event", "left")
    generated = F.col("token").rlike(r"^(U(CLASS|STRUCT|ENUM|INTERFACE|PROPERTY|FUNCTION|PARAM|META)|GENERATED_\w*BODY|Super|ThisClass|StaticClass)$") | F.col("_has").isNotNull()
    hide = (F.col("_broken").isNotNull() & ~(F.col("_include") & ~F.col("_false"))) | (F.col("_stale").isNotNull() & generated)
    return d.where(~F.coalesce(hide, F.lit(False))).select(*diagnostics.columns)
