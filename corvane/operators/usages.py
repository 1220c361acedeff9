"""Usage counters, summaries and unions of uses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage_counts(refs: DataFrame) -> DataFrame:
    """(symbol_id, n_assets): distinct assets that use each symbol."""
    return refs.groupBy("symbol_id").agg(F.count_distinct("asset_path").alias("n_assets"))


def usage_with_derived(refs: DataFrame, anc: DataFrame) -> DataFrame:
    """(symbol_id, n_assets): distinct assets that use a type or one derived from it.

    References are made distinct before they are copied to the ancestors, and (ancestor, asset) pairs before they are counted,
    so a root type's count is a sum of partial counts.
    """
    used = refs.select("symbol_id", "asset_path").distinct()
    up = used.join(anc.select(F.col("type_id").alias("symbol_id"), "ancestor_id"), "symbol_id").select(F.col("ancestor_id").alias("symbol_id"), "asset_path")
    return used.unionByName(up).distinct().groupBy("symbol_id").agg(F.count("*").alias("n_assets"))


def usage_matrix(refs: DataFrame, kinds: list[str]) -> DataFrame:
    """(symbol_id, one column per kind): distinct assets by kind of use; the kinds are given, so no pass finds them."""
    return refs.groupBy("symbol_id").pivot("ref_kind", kinds).agg(F.count_distinct("asset_path")).na.fill(0)


def index_summary(refs: DataFrame) -> DataFrame:
    """(module, ref_kind, n_refs, n_assets) with subtotals: null stands for all."""
    return refs.rollup("module", "ref_kind").agg(F.count("*").alias("n_refs"), F.count_distinct("asset_path").alias("n_assets"))


def index_overview(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """index_summary with a row for each detected module alias (old_module, new_module, n_classes): ref_kind is `alias`, n_refs its classes."""
    told = aliases.select(F.col("old_module").alias("module"), F.lit("alias").alias("ref_kind"), F.col("n_classes").alias("n_refs"), F.lit(0).cast("long").alias("n_assets"), F.col("new_module").alias("alias_of"))
    return index_summary(refs).withColumn("alias_of", F.lit(None).cast("string")).unionByName(told)


def assets_by_parent(assets: DataFrame) -> DataFrame:
    """(parent_path, n_assets, assets) with the assets in order: one array a parent, so for parents whose assets a task can hold;
    `ranked_assets` has no such bound."""
    return assets.groupBy("parent_path").agg(F.count("*").alias("n_assets"), F.sort_array(F.collect_list("asset_path")).alias("assets"))


def ranked_assets(assets: DataFrame) -> DataFrame:
    """(parent_path, position, asset_path): as assets_by_parent, a row per asset."""
    w = Window.partitionBy("parent_path").orderBy("asset_path")
    return assets.select("parent_path", F.row_number().over(w).alias("position"), "asset_path")


def specifier_values(symbols: DataFrame) -> DataFrame:
    """(key, value, n): values of meta keys in use."""
    return symbols.select(F.explode("meta").alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


def module_overview(symbols: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(module, kind, n_symbols[, deps])."""
    out = symbols.groupBy("module", "kind").agg(F.count("*").alias("n_symbols"))
    return out.join(modules.select("module", "deps"), "module", "left") if modules is not None else out


def search_summary(hits: DataFrame) -> DataFrame:
    """(asset_path, text_kind, n_hits)."""
    return hits.groupBy("asset_path", "text_kind").agg(F.count("*").alias("n_hits"))


def arity_ranges(functions: DataFrame) -> DataFrame:
    """(callee, min_args, max_args) over the overloads (callee, min_args, max_args)."""
    return functions.groupBy("callee").agg(F.min("min_args").alias("min_args"), F.max("max_args").alias("max_args"))


def find_usages(*parts: DataFrame) -> DataFrame:
    """All uses (path, line, col, symbol_id), each once: direct ones, macro arguments, macro bodies at their expansions, specifier values."""
    return reduce(DataFrame.unionByName, [p.select("path", "line", "col", "symbol_id") for p in parts]).distinct()


def macro_body_uses(expansions: DataFrame, bodies: DataFrame) -> DataFrame:
    """Uses in macro bodies, at the places where the macro (macro_id) is expanded."""
    return expansions.select("macro_id", "path", "line", "col").join(bodies.select("macro_id", "symbol_id").distinct(), "macro_id").select("path", "line", "col", "symbol_id")


def split_uncertain(uses: DataFrame) -> DataFrame:
    """Uses with `uncertain` (receiver type unknown) and `list_order`, which puts these last."""
    unknown = F.col("receiver_type").isNull()
    return uses.withColumn("uncertain", unknown).withColumn("list_order", unknown.cast("int"))


def unknown_specifiers(used: DataFrame, catalog: DataFrame) -> DataFrame:
    """(macro, specifier, n): used specifiers (symbol_id, macro, specifier) that the catalog of this engine version lacks."""
    return used.join(catalog.select("macro", "specifier"), ["macro", "specifier"], "left_anti").groupBy("macro", "specifier").agg(F.count("*").alias("n"))


def conflicting_specifiers(used: DataFrame, catalog: DataFrame) -> DataFrame:
    """(symbol_id, specifier, conflicts): specifiers of a declaration that another one on it excludes."""
    have = used.groupBy("symbol_id", "macro").agg(F.collect_set("specifier").alias("have"))
    told = used.select("symbol_id", "macro", "specifier").distinct().join(catalog.select("macro", "specifier", "conflicts_with"), ["macro", "specifier"])
    both = told.join(have, ["symbol_id", "macro"]).withColumn("conflicts", F.array_sort(F.array_intersect("have", "conflicts_with")))
    return both.where(F.size("conflicts") > 0).select("symbol_id", "specifier", "conflicts")


def plugin_roots(projects: DataFrame) -> DataFrame:
    """(project, root): the Plugins folder of each project and its additional plugin folders, each once."""
    return projects.select("project", F.explode(F.concat(F.array(F.concat(F.col("dir"), F.lit("/Plugins"))), F.coalesce("additional_plugin_directories", F.array().cast("array<string>")))).alias("root")).distinct()
