"""Type, override and include graphs as tables: closures, trees, members.

Closures double: what is reached in exactly n steps, joined with what is reached in up to n, gives what is reached in up to 2 n, so a graph of
depth d takes about log2(d) rounds, and each round is written out. Ancestors are stored, not descendants per root, so a root with
millions of types below costs no more rows than their depths. A node reached by several paths is kept once, at its smallest depth; a
cycle ends the walk, and no node is its own ancestor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import pointee_type
from corvane.operators.cycles import shortest_cycles
from corvane.operators.tables import saved

#: Rounds of a walk from seeds that are written as one table; a bound that no real graph comes near, beyond which it raises.
MERGE, MOST_ROUNDS = 8, 1_000_000


def closure(edges: DataFrame, src: str, dst: str, seeds: DataFrame | None = None, loops: bool = False) -> DataFrame:
    """(src, dst, depth) for all that is reachable. seeds: the src to start from (default: all). loops: keep src = dst.

    A pair at distance n < d <= 2 n has a node between its ends at distance n of the first, so pairs at exactly n and all pairs up to n give it; a pair
    that is found so has its distance as the least sum. If no pair is exactly 2 n apart, none is further.
    """
    step = saved(edges.select(F.col(src).alias("_from"), F.col(dst).alias("_to")).where("_from is not null and _to is not null").distinct(), "edges")
    first = step.select(F.col("_from").alias(src), F.col("_to").alias(dst), F.lit(1).alias("depth"))
    if seeds is not None:
        return _walk(step, first.join(seeds.select(src).distinct(), src, "left_semi"), src, dst, loops)
    found = [first if loops else first.where(F.col(src) != F.col(dst))]
    n = 1
    while True:
        known = reduce(DataFrame.unionByName, found)
        far = found[-1].where(F.col("depth") == n).select(src, F.col(dst).alias("_mid"))
        if far.isEmpty():
            return known
        new = far.join(known.select(F.col(src).alias("_mid"), dst, (F.col("depth") + n).alias("depth")), "_mid")
        new = (new if loops else new.where(F.col(src) != F.col(dst))).groupBy(src, dst).agg(F.min("depth").alias("depth"))
        found.append(saved(new.join(known.select(src, dst), [src, dst], "left_anti"), "closure"))
        n *= 2


def _walk(step: DataFrame, first: DataFrame, src: str, dst: str, loops: bool) -> DataFrame:
    """The closure of some sources, semi-naive: each round joins what the last one found with the edges and drops what is known.

    Rounds go on until one adds nothing, so their number is the longest of the shortest ways; MERGE tables of the same rank are
    written as one, so plans stay short.
    """
    new = saved(first if loops else first.where(F.col(src) != F.col(dst)), "closure")
    found = [(0, new)]
    for depth in range(2, MOST_ROUNDS):
        known = reduce(DataFrame.unionByName, (f for _, f in found))
        new = new.select(src, F.col(dst).alias("_from")).join(step, "_from").select(src, F.col("_to").alias(dst)).distinct()
        if not loops:
            new = new.where(F.col(src) != F.col(dst))
        new = saved(new.join(known.select(src, dst), [src, dst], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if new.isEmpty():
            return known
        found.append((0, new))
        while len(found) >= MERGE and found[-MERGE][0] == found[-1][0]:
            rank = found[-1][0] + 1
            found[-MERGE:] = [(rank, saved(reduce(DataFrame.unionByName, (f for _, f in found[-MERGE:])), "closure"))]
    raise RuntimeError("the closure has not settled")


def ancestors(inherits: DataFrame) -> DataFrame:
    """(type_id, ancestor_id, depth), nearest first by depth; interfaces are parents like others."""
    return closure(inherits.select(F.col("child_id").alias("type_id"), F.col("parent_id").alias("ancestor_id")), "type_id", "ancestor_id")


def with_self(anc: DataFrame, types: DataFrame) -> DataFrame:
    """Ancestors with every type as its own at depth 0. types: type_id."""
    return types.select("type_id", F.col("type_id").alias("ancestor_id"), F.lit(0).alias("depth")).unionByName(anc)


def descendants(anc: DataFrame, inherits: DataFrame, root) -> DataFrame:
    """(type_id, depth, path): all below root as a tree; path holds the ids from root down to the type, a sort key.

    The path follows, at each type, the parent that is nearest to the root (smallest id among equals).
    """
    below = saved(anc.where(F.col("ancestor_id") == F.lit(root)).select("type_id", "depth"), "descendants")
    here = below.unionByName(below.sparkSession.range(1).select(F.lit(root).alias("type_id"), F.lit(0).alias("depth")))
    up = inherits.select(F.col("child_id").alias("type_id"), F.col("parent_id").alias("parent")).join(here.toDF("parent", "parent_depth"), "parent")
    parent = below.join(up, "type_id").where("parent_depth = depth - 1").groupBy("type_id", "depth").agg(F.min("parent").alias("parent"))
    parent = saved(parent, "tree")
    done = [saved(parent.where("depth = 1").select("type_id", "depth", F.array("parent", "type_id").alias("path")), "paths")]
    last = parent.agg(F.max("depth")).first()[0] or 0
    for d in range(2, last + 1):
        above = done[-1].select(F.col("type_id").alias("parent"), "path")
        done.append(saved(parent.where(F.col("depth") == d).join(above, "parent").select("type_id", "depth", F.concat("path", F.array("type_id")).alias("path")), "paths"))
    return reduce(DataFrame.unionByName, done)


def subclass_counts(anc: DataFrame) -> DataFrame:
    """(ancestor_id, n_total, n_direct)."""
    return anc.groupBy("ancestor_id").agg(F.count("*").alias("n_total"), F.count_if(F.col("depth") == 1).alias("n_direct"))


def cap_descendants(anc: DataFrame, names: DataFrame, n: int = 2000) -> DataFrame:
    """At most n derived types of each ancestor: by depth, then name, then id. names: type_id, name."""
    w = Window.partitionBy("ancestor_id").orderBy("depth", "name", "type_id")
    return anc.join(names.select("type_id", "name"), "type_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def derived_assets(assets: DataFrame, anc: DataFrame) -> DataFrame:
    """(type_id, asset_path, via, via_kind): assets below each type, directly, through other assets or through derived types.

    assets: asset_path, parent_path, where a parent is an asset or a type. `via` is the asset's own parent; null if that is the type itself.
    """
    direct = assets.select("asset_path", F.col("parent_path").alias("via"))
    parents = direct.join(direct.select(F.col("asset_path").alias("via")), "via", "left_semi")
    chain = closure(parents, "asset_path", "via")
    # the type at the end of each asset's chain: that of its topmost asset
    tops = chain.select("asset_path", F.col("via").alias("top")).unionByName(direct.select("asset_path", F.col("asset_path").alias("top")))
    roots = tops.join(direct.select(F.col("asset_path").alias("top"), F.col("via").alias("root")), "top").join(direct.select(F.col("asset_path").alias("root")), "root", "left_anti").select("asset_path", "root")
    base = roots.join(direct, "asset_path")
    own = base.select(F.col("root").alias("type_id"), "asset_path", "via", "root")
    up = base.join(anc.select(F.col("type_id").alias("root"), F.col("ancestor_id").alias("type_id")), "root").select("type_id", "asset_path", "via", "root")
    kind = F.when(F.col("via") == F.col("type_id"), None).when(F.col("via") == F.col("root"), "type").otherwise("asset")
    return own.unionByName(up).select("type_id", "asset_path", F.when(F.col("via") != F.col("type_id"), F.col("via")).alias("via"), kind.alias("via_kind"))


def override_chain(functions: DataFrame, anc: DataFrame) -> DataFrame:
    """(function_id, origin_id, n_bases): for each function, its first declaration among the ancestors and how many redeclare it.

    functions: function_id, type_id, name, signature. A function that no ancestor has is its own origin.
    """
    base = functions.select(F.col("type_id").alias("ancestor_id"), "name", "signature", F.col("function_id").alias("base_id"))
    hits = functions.join(anc, "type_id").join(base, ["ancestor_id", "name", "signature"])
    top = hits.groupBy("function_id").agg(F.max_by("base_id", F.struct("depth", "base_id")).alias("origin_id"), F.count("*").alias("n_bases"))
    return functions.select("function_id").join(top, "function_id", "left").select("function_id", F.coalesce("origin_id", "function_id").alias("origin_id"), F.coalesce("n_bases", F.lit(0)).alias("n_bases"))


def event_name(name: str) -> Column:
    """The event that a native implementation stands for."""
    return F.regexp_replace(F.col(name), "_(Implementation|Validate)$", "")


def event_implementations(functions: DataFrame, anc: DataFrame, asset_refs: DataFrame) -> DataFrame:
    """(event_id, implementer, implementer_kind): subclasses that write `_Implementation`, and assets that implement the event."""
    events = functions.where("is_native_event").select(F.col("function_id").alias("event_id"), F.col("type_id").alias("ancestor_id"), "name")
    made = functions.where(F.col("name").endswith("_Implementation")).select("function_id", "type_id", event_name("name").alias("name"))
    self_or_up = made.select("type_id").distinct().select("type_id", F.col("type_id").alias("ancestor_id")).unionByName(anc.select("type_id", "ancestor_id"))
    native = made.join(self_or_up, "type_id").join(events, ["ancestor_id", "name"]).select("event_id", F.col("function_id").alias("implementer"), F.lit("type").alias("implementer_kind"))
    assets = asset_refs.where("ref_kind in ('implement', 'override')").join(events, F.col("target_id") == F.col("event_id")).select("event_id", F.col("asset_path").alias("implementer"), F.lit("asset").alias("implementer_kind"))
    return native.unionByName(assets).distinct()


def overridable(functions: DataFrame, anc: DataFrame, types: DataFrame) -> DataFrame:
    """(type_id, function_id, declared_in, write_as): inherited virtual functions that a type may still override.

    The nearest declaration counts; final or deprecated ones, and those the type already has, are left out.
    """
    base = functions.where("is_virtual").select(F.col("type_id").alias("ancestor_id"), "name", "signature", "function_id", "is_final", "is_deprecated", "is_native_event")
    near = Window.partitionBy("type_id", "name", "signature").orderBy("depth", "ancestor_id", "function_id")
    seen = types.select("type_id").join(anc, "type_id").join(base, "ancestor_id").withColumn("_n", F.row_number().over(near)).where("_n = 1 and not is_final and not is_deprecated")
    own = functions.select("type_id", event_name("name").alias("name"), "signature").distinct()
    return seen.join(own, ["type_id", "name", "signature"], "left_anti").select("type_id", "function_id", F.col("ancestor_id").alias("declared_in"), F.when(F.col("is_native_event"), F.concat("name", F.lit("_Implementation"))).otherwise(F.col("name")).alias("write_as"))


def effective_members(members: DataFrame, anc: DataFrame, types: DataFrame) -> DataFrame:
    """(type_id, member_id, name, depth, accessible): members seen on each type; an own member hides a base's of that name and signature.

    members: member_id, type_id, name, signature, access. Private members of bases stay, marked as not accessible.
    """
    m = members.select(F.col("type_id").alias("ancestor_id"), "member_id", "name", "signature", "access")
    hide = Window.partitionBy("type_id", "name", "signature").orderBy("depth", "ancestor_id", "member_id")
    seen = with_self(anc, types).join(m, "ancestor_id").withColumn("_n", F.row_number().over(hide)).where("_n = 1")
    return seen.select("type_id", "member_id", "name", "depth", ((F.col("access") != "private") | (F.col("depth") == 0)).alias("accessible"))


def static_members(members: DataFrame, anc: DataFrame, types: DataFrame) -> DataFrame:
    """effective_members (members with is_static) as a static function sees them: static ones, unless a nearer member hides them."""
    return effective_members(members, anc, types).join(members.where("is_static").select("member_id"), "member_id", "left_semi")


def pointee_members(fields: DataFrame, members: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(field_id, member_id, name, via): what may follow a field of pointer type: members of the object pointed at (via ->) and, for
    smart pointers, those of the wrapper itself (via .).

    fields: field_id, type_text. members: effective members (type_name, member_id, name). wrappers: type_name of the pointer template, member_id, name.
    """
    f = fields.select("field_id", pointee_type("type_text").alias("type_name"), F.regexp_extract("type_text", r"^\s*(?:const\s+)?(\w+)\s*<", 1).alias("_wrapper")).where("type_name is not null")
    seen = f.join(members.select("type_name", "member_id", "name"), "type_name").select("field_id", "member_id", "name", F.lit("->").alias("via"))
    own = f.join(wrappers.select(F.col("type_name").alias("_wrapper"), "member_id", "name"), "_wrapper").select("field_id", "member_id", "name", F.lit(".").alias("via"))
    return seen.unionByName(own)


def include_closure(includes: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(path, reached, depth): all files that a file sees through includes; seeds: path, the files of interest."""
    edges = includes.select("path", F.col("resolved_path").alias("reached"))
    return closure(edges, "path", "reached", seeds)


def filter_tree(anc: DataFrame, hits: DataFrame) -> DataFrame:
    """type_id of hits and of all their ancestors."""
    return hits.select("type_id").unionByName(anc.join(hits.select("type_id"), "type_id", "left_semi").select(F.col("ancestor_id").alias("type_id"))).distinct()


def wait_cycles(waits: DataFrame) -> DataFrame:
    """Threads in a cycle of waits (waiter, holder): each with the length of its shortest cycle. Chains cost no more rows than they have edges; see `cycles`."""
    edges = waits.select(F.col("waiter").alias("u"), F.col("holder").alias("v"))
    found = shortest_cycles(edges, lambda inside: closure(inside, "u", "v", loops=True))
    return found.select(F.col("node").alias("thread"), F.col("cycle_length").cast("int").alias("cycle_length"))
