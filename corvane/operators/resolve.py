"""Joins that resolve names: redirects, asset references, modules, scopes, includes.

Every join has an equality key; ranges and prefixes are turned into keys (line blocks, exploded prefixes) first, so none
becomes a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import unix_path
from corvane.operators.scans import scan, time_block
from corvane.operators.tables import saved

#: Lines of a file that share a key in scope joins.
LINE_BLOCK = 256


def closed_redirects(redirects: DataFrame) -> DataFrame:
    """(old_name, new_name) with chains followed to their end by doubling; names that end in a cycle are dropped. A name that redirects to itself and to others goes to the smallest of the others.

    As long as a chain is open, a doubling ends some names; what is left once none ends goes round in a cycle.
    """
    now = one = saved(redirects.where("old_name <> new_name").groupBy("old_name").agg(F.min("new_name").alias("new_name")), "redirects")
    old = one.select(F.col("old_name").alias("new_name"))
    last, open_names = None, now.join(old, "new_name", "left_semi").count()
    while open_names and open_names != last:
        step = now.select(F.col("old_name").alias("new_name"), F.col("new_name").alias("_next"))
        now = saved(now.join(step, "new_name", "left").select("old_name", F.coalesce("_next", "new_name").alias("new_name")), "redirects")
        last, open_names = open_names, now.join(old, "new_name", "left_semi").count()
    return now.join(old, "new_name", "left_anti").select("old_name", "new_name")


def apply_redirects(df: DataFrame, redirects: DataFrame, col: str, closed: bool = False) -> DataFrame:
    """The input with names in col replaced by what they are now."""
    r = (redirects if closed else closed_redirects(redirects)).select(F.col("old_name").alias(col), F.col("new_name").alias("_new"))
    return df.join(r, col, "left").withColumn(col, F.coalesce("_new", F.col(col))).select(*df.columns)


def resolve_asset_refs(asset_refs: DataFrame, symbols: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """asset_refs with symbol columns: references whose target, after redirects, is a known symbol. Key: target_id = symbol_id."""
    refs = apply_redirects(asset_refs, redirects, "target_id") if redirects is not None else asset_refs
    return refs.join(symbols.withColumnRenamed("symbol_id", "target_id"), "target_id")


def match_property_names(asset_refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(asset_path, target_name, symbol_id, match): property references matched by name only, all candidates kept.

    The asset side is made distinct first, so a common name costs one row per asset.
    """
    names = asset_refs.select("asset_path", "target_name").distinct()
    return names.join(symbols.select("symbol_id", F.col("name").alias("target_name")), "target_name").withColumn("match", F.lit("name")).select("asset_path", "target_name", "symbol_id", "match")


def count_property_matches(asset_refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target_name, n_matches, n_assets): the rows and the distinct assets that match_property_names gives for each name.

    Every asset of a name meets every symbol of it, so the two sides are counted and the counts multiplied; no pair is made. An asset or a symbol without a path or number counts as a row there too.
    """
    assets = asset_refs.select("asset_path", "target_name").distinct().groupBy("target_name").agg(F.count("*").alias("_refs"), F.count("asset_path").alias("n_assets"))
    own = symbols.groupBy(F.col("name").alias("target_name")).agg(F.count("*").alias("_symbols"))
    return assets.join(own, "target_name").select("target_name", (F.col("_refs") * F.col("_symbols")).alias("n_matches"), "n_assets")


def detect_module_aliases(refs: DataFrame, symbols: DataFrame, least: int = 1) -> DataFrame:
    """(old_module, new_module, n_classes): modules that references name but no symbol has, with the module that has most of those classes."""
    wanted = refs.select(F.col("target_module").alias("module"), F.col("target_name").alias("name")).distinct()
    lost = wanted.join(symbols.select("module", "name").distinct(), ["module", "name"], "left_anti").join(symbols.select("module").distinct(), "module", "left_anti")
    found = lost.withColumnRenamed("module", "old_module").join(symbols.select("name", F.col("module").alias("new_module")).distinct(), "name")
    n = found.groupBy("old_module", "new_module").agg(F.count("*").alias("n_classes")).where(F.col("n_classes") >= least)
    best = Window.partitionBy("old_module").orderBy(F.desc("n_classes"), "new_module")
    return n.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def unused_api(symbols: DataFrame, asset_refs: DataFrame) -> DataFrame:
    """Symbols that no asset refers to. Key: symbol_id = target_id."""
    return symbols.join(asset_refs.select(F.col("target_id").alias("symbol_id")), "symbol_id", "left_anti")


def missing_definitions(expected: DataFrame, definitions: DataFrame) -> DataFrame:
    """Expected definitions (container_id, name, ...) without one."""
    return expected.join(definitions.select("container_id", "name"), ["container_id", "name"], "left_anti")


def missing_specifier_targets(values: DataFrame, functions: DataFrame, anc: DataFrame | None = None) -> DataFrame:
    """Specifier values (type_id, value, ...) that name no function of the type or of a base."""
    own = functions.select("type_id", F.col("name").alias("value"))
    if anc is not None:
        own = own.unionByName(anc.join(own.withColumnRenamed("type_id", "ancestor_id"), "ancestor_id").select("type_id", "value"))
    return values.join(own, ["type_id", "value"], "left_anti")


def missing_members(uses: DataFrame, members: DataFrame) -> DataFrame:
    """Uses with a known receiver type whose name is no member. members: effective members (type_id, name)."""
    m = members.select(F.col("type_id").alias("receiver_type"), "name").distinct()
    return uses.where("receiver_type is not null").join(m, ["receiver_type", "name"], "left_anti")


def arity(params: Column) -> tuple[Column, Column]:
    """Fewest and most arguments that a parameter list takes."""
    return F.size(F.filter(params, lambda p: ~F.coalesce(p["has_default"], F.lit(False)))), F.size(params)


def bad_arity(calls: DataFrame, overloads: DataFrame) -> DataFrame:
    """Calls (callee, argc, ...) whose argument count no overload (callee, min_args, max_args) takes; unknown callees are no finding."""
    o = overloads.select(F.col("callee").alias("_callee"), "min_args", "max_args")
    known = calls.join(o.select(F.col("_callee").alias("callee")).distinct(), "callee", "left_semi")
    return known.join(o, (F.col("callee") == F.col("_callee")) & F.col("argc").between(F.col("min_args"), F.col("max_args")), "left_anti")


def access_checks(uses: DataFrame, members: DataFrame, anc: DataFrame, friends: DataFrame) -> DataFrame:
    """uses (use_id, from_type, symbol_id) with access, owner and `accessible`: public; own; protected and derived; or a friend.

    members: symbol_id, owner, access. friends: owner, from_type (nested types are given as friends too).
    """
    u = uses.join(members.select("symbol_id", "owner", "access"), "symbol_id")
    u = u.join(anc.select(F.col("type_id").alias("from_type"), F.col("ancestor_id").alias("owner"), F.lit(True).alias("_derived")), ["from_type", "owner"], "left")
    u = u.join(friends.select("owner", "from_type", F.lit(True).alias("_friend")).distinct(), ["owner", "from_type"], "left")
    ok = (F.col("access") == "public") | F.col("from_type").eqNullSafe(F.col("owner")) | ((F.col("access") == "protected") & F.col("_derived").isNotNull()) | F.col("_friend").isNotNull()
    return u.withColumn("accessible", F.coalesce(ok, F.lit(False))).drop("_derived", "_friend")


def access_violations(uses: DataFrame, members: DataFrame, anc: DataFrame, friends: DataFrame) -> DataFrame:
    """The uses that may not reach their member."""
    return access_checks(uses, members, anc, friends).where("not accessible")


def path_prefixes(path: str) -> Column:
    """All folders above a path, longest last."""
    parts = F.split(unix_path(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def assign_by_folder(files: DataFrame, folders: DataFrame, dir_col: str, name_col: str) -> DataFrame:
    """files (path, ...) with the name of the nearest folder above that is listed; null if none is. Folders are exploded prefixes, so this is an equality join."""
    p = files.select("path").distinct().withColumn("_dir", F.explode(path_prefixes("path")))
    d = folders.select(F.rtrim(unix_path(dir_col), F.lit("/")).alias("_dir"), F.col(name_col).alias("_name"))
    near = p.join(d, "_dir").groupBy("path").agg(F.max_by("_name", F.struct(F.length("_dir"), "_name")).alias(name_col))
    return files.join(near, "path", "left")


def assign_module(files: DataFrame, modules: DataFrame) -> DataFrame:
    return assign_by_folder(files, modules, "dir", "module")


def assign_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    return assign_by_folder(files, projects, "dir", "project")


def enclosing_scope(points: DataFrame, scopes: DataFrame, block: int = LINE_BLOCK) -> DataFrame:
    """points (point_id, path, line) with scope_id, the innermost scope (path, line, end_line, scope_id) around each; points outside all are left out.

    Scopes are exploded over blocks of lines, so a file with very many scopes meets only those near by; the innermost one is a grouped maximum.
    """
    s = scopes.select("path", F.col("line").alias("_start"), F.col("end_line").alias("_end"), "scope_id").where("_start <= _end")
    s = s.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor(F.col("_end") / block))))
    p = points.withColumn("_block", F.floor(F.col("line") / block))
    hit = p.join(s, ["path", "_block"]).where("line between _start and _end")
    return hit.groupBy(*points.columns).agg(F.max_by("scope_id", F.struct("_start", -F.col("_end"), "scope_id")).alias("scope_id"))


def guard_of(symbols: DataFrame, guards: DataFrame, block: int = LINE_BLOCK) -> DataFrame:
    """symbols (symbol_id, path, line) with the innermost preprocessor guard (path, line, end_line, guard) around them; null outside."""
    p = symbols.select(F.col("symbol_id").alias("point_id"), "path", "line")
    g = enclosing_scope(p, guards.withColumnRenamed("guard", "scope_id"), block)
    return symbols.join(g.select(F.col("point_id").alias("symbol_id"), F.col("scope_id").alias("guard")), "symbol_id", "left")


def missing_module_deps(inherits: DataFrame, type_modules: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, needs, n_types): modules whose types derive from a module that they don't depend on. type_modules: type_id, module."""
    child, parent = type_modules.toDF("child_id", "module"), type_modules.toDF("parent_id", "needs")
    need = inherits.join(child, "child_id").join(parent, "parent_id").where("module <> needs").groupBy("module", "needs").agg(F.count_distinct("child_id").alias("n_types"))
    return need.join(modules.select("module", F.explode("deps").alias("needs")), ["module", "needs"], "left_anti")


def missing_includes(uses: DataFrame, headers: DataFrame, seen: DataFrame, forward: DataFrame) -> DataFrame:
    """(path, name, header): names used in a file whose header it neither includes, directly or not, nor forward declares.

    headers: name, header. seen: path, reached (an include closure). forward: path, name.
    """
    need = uses.select("path", "name").distinct().join(headers, "name").where("path <> header")
    return need.join(seen.select("path", F.col("reached").alias("header")), ["path", "header"], "left_anti").join(forward.select("path", "name"), ["path", "name"], "left_anti").select("path", "name", "header")


def attribute_hangs(hangs: DataFrame, ui_ops: DataFrame) -> DataFrame:
    """hangs (session, ts, hang_id) with the last operation (session, ts, op) begun at or before: a union and a scan by session, no range join."""
    both = hangs.select("session", "ts", "hang_id", F.lit(None).cast("string").alias("op"), F.lit(1).alias("_o")).unionByName(ui_ops.select("session", "ts", F.lit(None).cast(hangs.schema["hang_id"].dataType).alias("hang_id"), "op", F.lit(0).alias("_o")))
    return scan(both, ["session"], ["ts", "_o"], time_block("ts"), lasts={"op": F.col("op")}).where("_o = 1").select("hang_id", "session", "ts", "op")


def resolve_includes(includes: DataFrame, compile_commands: DataFrame, files: DataFrame) -> DataFrame:
    """includes (path, line, target_text) with resolved_path: the first of the file's own include paths under which the target exists; null if none."""
    dirs = compile_commands.select(F.col("file").alias("path"), F.posexplode("include_paths").alias("_pos", "_dir"))
    tries = includes.join(dirs, "path").select("path", "line", "_pos", F.concat(F.rtrim(unix_path("_dir"), F.lit("/")), F.lit("/"), "target_text").alias("resolved_path"))
    hit = tries.join(files.select(F.col("path").alias("resolved_path")), "resolved_path", "left_semi").groupBy("path", "line").agg(F.min_by("resolved_path", "_pos").alias("resolved_path"))
    return includes.drop("resolved_path").join(hit, ["path", "line"], "left")


def available_types(types: DataFrame, modules: DataFrame, enabled_plugins: DataFrame) -> DataFrame:
    """Types (with module) that a project may derive from: modules without a plugin, and those of enabled plugins."""
    open_modules = modules.where("plugin is null").select("module").unionByName(modules.join(enabled_plugins.select("plugin"), "plugin", "left_semi").select("module"))
    return types.join(open_modules, "module", "left_semi")
