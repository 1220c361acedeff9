"""Scalar functions on columns of names, texts and declarations. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Specifiers that expose a declaration to visual scripts.
EXPOSED = ["BlueprintCallable", "BlueprintPure", "BlueprintReadWrite", "BlueprintReadOnly", "BlueprintAssignable", "BlueprintImplementableEvent", "BlueprintNativeEvent", "BlueprintType", "Blueprintable"]
# Smart pointer templates that are looked through.
POINTERS = ["TObjectPtr", "TWeakObjectPtr", "TSharedPtr", "TUniquePtr"]
BREADCRUMB = " › "


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_prefix(name: str | Column) -> Column:
    """The prefix class (A, U, F, E or I) of a type name; null if it has none."""
    return F.nullif(F.regexp_extract(column(name), r"^([AUFEI])[A-Z]", 1), F.lit(""))


def prefix_kind(name: str | Column) -> Column:
    """What a name alone says of its type: object, value, enum, interface or unknown."""
    p = name_prefix(name)
    return F.when(p.isin("A", "U"), "object").when(p == "F", "value").when(p == "E", "enum").when(p == "I", "interface").otherwise("unknown")


def format_arity(text: str | Column) -> Column:
    """Conversions in a format string (a doubled percent sign is none)."""
    return F.regexp_count(F.replace(column(text), F.lit("%%"), F.lit("")), F.lit("%"))


def breadcrumb(parts: str | Column) -> Column:
    return F.array_join(column(parts), BREADCRUMB)


def is_exposed(specifiers: str | Column) -> Column:
    return F.coalesce(F.arrays_overlap(column(specifiers), F.array(*[F.lit(x) for x in EXPOSED])), F.lit(False))


def initials(name: str | Column) -> Column:
    """The capitals of a name."""
    return F.regexp_replace(column(name), "[^A-Z]", "")


def subsequence(name: str | Column, query: str) -> Column:
    """Whether the letters of query occur in name in this order, without case."""
    return F.lower(column(name)).rlike(".*".join(re.escape(c) for c in query.lower()))


def typo_distance(query: str) -> int:
    return 1 if len(query) <= 8 else 2


def typo(name: str | Column, query: str, most: int | None = None) -> Column:
    """Whether some word of name is within the typo distance of query, without case."""
    d = typo_distance(query) if most is None else most
    words = F.split(F.lower(column(name)), r"[^a-z0-9]+")
    return F.exists(words, lambda w: F.levenshtein(w, F.lit(query.lower()), d) >= 0)


def pointee_type(type_text: str | Column) -> Column:
    """What a smart or raw pointer type points at; null for other types."""
    smart = F.regexp_extract(column(type_text), rf"^\s*(?:const\s+)?(?:{'|'.join(POINTERS)})\s*<\s*(?:const\s+|class\s+)*([\w:]+)", 1)
    raw = F.regexp_extract(column(type_text), r"^\s*(?:const\s+)?(?:class\s+)?([\w:]+)\s*\*", 1)
    return F.coalesce(F.nullif(smart, F.lit("")), F.nullif(raw, F.lit("")))


def path_stem(path: str | Column) -> Column:
    """The file name without folder and extension."""
    return F.regexp_extract(column(path), r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def unix_path(path: str | Column) -> Column:
    return F.replace(column(path), F.lit("\\"), F.lit("/"))


def include_text(path: str | Column, from_folder: str | Column | None = None) -> Column:
    """The text that an include of this file is written with: relative to the module's public or private root, else to the folder given, else whole."""
    p = unix_path(path)
    rooted = F.nullif(F.regexp_extract(p, r"/(?:Public|Classes|Private)/(.+)$", 1), F.lit(""))
    options = [rooted]
    if from_folder is not None:
        base = F.concat(F.rtrim(unix_path(from_folder), F.lit("/")), F.lit("/"))
        options.append(F.when(F.startswith(p, base), F.substring(p, F.length(base) + 1, F.length(p))))
    return F.coalesce(*options, p)


def guess_words(text: str | Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(column(text), F.lit(r"(\w+)"), 1)


def literal_pattern(text: str | Column) -> Column:
    """A text as a regular expression that matches it literally."""
    return F.regexp_replace(column(text), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
