"""Type trees as intervals, so that ancestry is a comparison of two numbers and no closure is stored.

Each type has one parent in a forest; its place in the order of a walk through the forest (`pre`) and the last place below it (`last`) are its label: what stands in
[pre, last] is below it. Further parents (interfaces) and edges that close a cycle are rows of their own, `extra`.

The walk is an Euler tour: a step down and a step up for each type, each of which knows the next one, ranked by doubling: log2 of twice the number of
types rounds, whatever the shape, each round a join of steps that point at different ones, so it has no hot key. Siblings stand in the order of their hashes and meet by
blocks of these, so a parent with a third of all types is spread over tasks.

What the labels give without copying rows to ancestors: counts and sums below each type are differences of running sums; types in a set of intervals are found by sweeping over the places; distinct
assets below each type are counted by taking off, for neighbours of an asset in the walk, one at the type that both are below.
Only for types that have descendants outside their own interval (interfaces, and what is above them) are the intervals of these kept beside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.cycles import pointers
from corvane.operators.hierarchy import closure
from corvane.operators.scans import line_block, scan
from corvane.operators.tables import saved

#: Bits of a hash that order siblings inside a block; the others, 12, number the blocks.
INSIDE = 52
#: References of an asset from which on it isn't counted by one task; pairs that are sorted at once; bytes of a batch of them.
HOT, PAIRS, BATCH = 1 << 20, 4 << 20, 4 << 20


def split(inherits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (child_id, parent_id) as a forest, in which each type has one parent, and as the rest. The parent is a class before an interface (is_interface, if there), and the smallest among equals. A cycle is cut above its smallest type. Types that are their own parents and nulls have no edge."""
    interface = F.coalesce(F.col("is_interface"), F.lit(False)) if "is_interface" in inherits.columns else F.lit(False)
    edges = inherits.select(F.col("child_id").alias("u"), F.col("parent_id").alias("v"), interface.alias("late")).where("u is not null and v is not null and u <> v")
    edges = saved(edges.groupBy("u", "v").agg(F.min("late").alias("late")), "edges")
    first = saved(edges.groupBy("u").agg(F.min(F.struct("late", "v")).alias("least")).select("u", "least.v"), "parents")
    _, going = pointers(first)
    on = going.join(going.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    tree = saved(first.join(on.where("u = least").select("u"), "u", "left_anti"), "forest")
    rest = saved(edges.join(tree, ["u", "v"], "left_anti"), "extra-parents")
    return tree.toDF("type_id", "parent_id"), rest.select("u", "v").toDF("type_id", "parent_id")


def label(inherits: DataFrame, types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """labels (type_id, parent_id, pre, last, depth) of all types in inherits (child_id, parent_id) and types (type_id), and extra (type_id, parent_id), the edges that aren't in the forest.

    depth is that in the forest, roots have 0 and a null parent. The order of siblings is fixed, so labels of the same edges are the same.
    """
    tree, extra = split(inherits)
    nodes = tree.select(F.explode(F.array("type_id", "parent_id")).alias("id")).unionByName(extra.select(F.explode(F.array("type_id", "parent_id")).alias("id")))
    if types is not None:
        nodes = nodes.unionByName(types.select(F.col("type_id").alias("id")).where("id is not null"))
    nodes = nodes.distinct().join(tree.toDF("id", "parent"), "id", "left").withColumn("_h", F.xxhash64("id"))
    told = scan(nodes, ["parent"], ["_h", "id"], F.shiftright("_h", INSIDE), nexts={"next": F.col("id")})
    child = tree.groupBy(F.col("parent_id").alias("id")).agg(F.min_by("type_id", F.struct(F.xxhash64("type_id"), "type_id")).alias("first"))
    told = saved(told.join(child, "id", "left").select("id", "parent", "next", "first"), "siblings")

    number = lambda x: F.lit(x).cast("long")
    down = told.select("id", F.lit(False).alias("up"), F.coalesce("first", "id").alias("to"), F.col("first").isNull().alias("to_up"), number(1).alias("n"), number(1).alias("d"))
    up = told.select("id", F.lit(True).alias("up"), F.coalesce("next", "parent").alias("to"), F.col("next").isNull().alias("to_up"), number(0).alias("n"), number(-1).alias("d"))
    steps = saved(down.unionByName(up), "steps")
    while not steps.where("to is not null").isEmpty():
        there = steps.select(F.col("id").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("_to"), F.col("to_up").alias("_to_up"), F.col("n").alias("_n"), F.col("d").alias("_d"))
        further = steps.where("to is not null").join(there, ["to", "to_up"])
        further = further.select("id", "up", F.col("_to").alias("to"), F.col("_to_up").alias("to_up"), (F.col("n") + F.col("_n")).alias("n"), (F.col("d") + F.col("_d")).alias("d"))
        steps = saved(steps.where("to is null").unionByName(further), "steps")
    # n: types from the step on, d: how many less are open at the end
    total = told.count()
    at = steps.groupBy("id").agg(F.max(F.expr("case when not up then n end")).alias("a"), F.max(F.expr("case when up then n end")).alias("b"), F.max(F.expr("case when not up then -d end")).alias("depth"))
    made = at.join(told.select("id", "parent"), "id").select(F.col("id").alias("type_id"), F.col("parent").alias("parent_id"), (F.lit(total) - F.col("a")).alias("pre"), (F.lit(total) - F.col("b") - 1).alias("last"), F.col("depth").cast("int").alias("depth"))
    return saved(made, "labels"), extra


def is_below(pre: str | Column, above_pre: str | Column, above_last: str | Column) -> Column:
    """Whether a type is the other or below it in the forest."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return (col(pre) >= col(above_pre)) & (col(pre) <= col(above_last))


def _levels(labels: DataFrame) -> int:
    return ((labels.agg(F.max("pre")).first()[0] or 0) + 1).bit_length()


def _inside(outer: DataFrame, places: DataFrame, levels: int) -> DataFrame:
    """(ancestor_id, pre): the places (pre) in each of the intervals (ancestor_id, pre, last).

    An interval is cut into blocks of 2^level places that begin at multiples of it, two a level at most (one row if a type has nothing below it), and a place is in one block a level: a join on equal blocks.
    """
    told = outer.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    told = told.withColumn("a", F.expr("shiftright(pre + shiftleft(1L, level) - 1, level)")).withColumn("b", F.expr("shiftright(last + 1, level)")).where("a < b")
    told = told.select("ancestor_id", "level", F.explode(F.array_compact(F.array(F.expr("case when a % 2 = 1 then a end"), F.expr("case when b % 2 = 1 then b - 1 end")))).alias("block"))
    places = places.distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("block", F.expr("shiftright(pre, level)"))
    return told.join(places, ["level", "block"]).select("ancestor_id", "pre")


def intervals(labels: DataFrame, extra: DataFrame) -> DataFrame:
    """(ancestor_id, pre, last): for each type with descendants outside its own interval, the disjoint intervals that hold it and all its descendants.

    An extra edge puts all below its child below all that its parent is or is below, and so on over further extra edges. Rows grow with extra edges times the depth of their
    parents (interfaces, so a few), not with types.
    """
    targets = labels.join(extra.select(F.col("parent_id").alias("type_id")).distinct(), "type_id", "left_semi")
    above = _inside(labels.select(F.col("type_id").alias("ancestor_id"), "pre", "last"), targets.select("pre"), _levels(labels)).join(targets.select("pre", F.col("type_id").alias("parent_id")), "pre")
    pairs = saved(above.join(extra, "parent_id").select("ancestor_id", F.col("type_id").alias("below_id")).distinct(), "below-extra")
    step = pairs.join(extra.select(F.col("type_id").alias("ancestor_id")).distinct(), "ancestor_id", "left_semi")
    further = closure(step, "ancestor_id", "below_id").select(F.col("ancestor_id").alias("below_id"), F.col("below_id").alias("_further"))
    pairs = pairs.unionByName(pairs.join(further, "below_id").select("ancestor_id", F.col("_further").alias("below_id"))).where("ancestor_id <> below_id").distinct()
    place = labels.select("type_id", "pre", "last")
    pairs = pairs.join(place.toDF("below_id", "pre", "last"), "below_id").join(place.toDF("ancestor_id", "own_pre", "own_last"), "ancestor_id")
    outside = saved(pairs.where(~is_below("pre", "own_pre", "own_last")).select("ancestor_id", "pre", "last"), "outside")
    own = place.withColumnRenamed("type_id", "ancestor_id").join(outside.select("ancestor_id").distinct(), "ancestor_id", "left_semi").select("ancestor_id", "pre", "last")
    # intervals of a forest lie in one another or apart, so those that open while none is open are the outer ones
    both = outside.unionByName(own)
    ends = both.select("ancestor_id", F.col("pre").alias("at"), F.lit(1).alias("sign"), "last").unionByName(both.select("ancestor_id", (F.col("last") + 1).alias("at"), F.lit(-1).alias("sign"), "last"))
    swept = scan(ends, ["ancestor_id"], ["at", "sign", "last"], line_block("at"), sums={"open": F.col("sign")})
    return saved(swept.where("sign = 1 and open = 1").select("ancestor_id", F.col("at").alias("pre"), "last"), "intervals")


def subclass_counts(labels: DataFrame, extra: DataFrame, outer: DataFrame) -> DataFrame:
    """(ancestor_id, n_total, n_direct) of types with descendants. outer: `intervals`."""
    direct = labels.where("parent_id is not null").select("parent_id").unionByName(extra.select("parent_id")).groupBy(F.col("parent_id").alias("ancestor_id")).agg(F.count("*").alias("n_direct"))
    wide = outer.groupBy("ancestor_id").agg((F.sum(F.expr("last - pre + 1")) - 1).alias("_wide"))
    own = labels.select(F.col("type_id").alias("ancestor_id"), F.expr("last - pre").alias("_own"))
    return direct.join(own, "ancestor_id").join(wide, "ancestor_id", "left").select("ancestor_id", F.coalesce("_wide", "_own").alias("n_total"), "n_direct")


def below(labels: DataFrame, outer: DataFrame, root) -> DataFrame:
    """(type_id, position): all below one type, in the order of the walk. No rows for a type that isn't there."""
    rows = labels.where(F.col("type_id") != F.lit(root))
    found = labels.where(F.col("type_id") == F.lit(root)).select("pre", "last").first()
    if found is None:
        return rows.where("false").select("type_id", F.col("pre").alias("position"))
    wide = outer.where(F.col("ancestor_id") == F.lit(root))
    if wide.isEmpty():
        return rows.where(F.col("pre").between(found.pre, found.last)).select("type_id", F.col("pre").alias("position"))
    none = F.lit(None).cast(labels.schema["type_id"].dataType)
    opens = wide.select(F.lit(0).alias("all"), none.alias("type_id"), F.col("pre").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("sign"))
    closes = wide.select(F.lit(0).alias("all"), none.alias("type_id"), (F.col("last") + 1).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("sign"))
    told = rows.select(F.lit(0).alias("all"), "type_id", F.col("pre").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("sign"))
    swept = scan(told.unionByName(opens).unionByName(closes), ["all"], ["at", "kind"], line_block("at"), sums={"open": F.col("sign")})
    return swept.where("kind = 2 and open > 0").select("type_id", F.col("at").alias("position"))


def sums_below(labels: DataFrame, values: DataFrame) -> DataFrame:
    """labels with `total`, the sum of values (pre, x) in each type's own interval: a running sum at its last place, less that before its first."""
    own = values.groupBy("pre").agg(F.sum("x").alias("x"))
    rows = labels.withColumn("_all", F.lit(0)).join(own, "pre", "left").withColumn("x", F.coalesce("x", F.lit(0)))
    upto = saved(scan(rows, ["_all"], ["pre"], line_block("pre"), sums={"upto": F.col("x")}).drop("_all"), "running-sums")
    end = upto.select(F.col("pre").alias("last"), F.col("upto").alias("_end"))
    return upto.join(end, "last").withColumn("total", F.expr("_end - upto + x")).select(*labels.columns, "total")


def filter_tree(labels: DataFrame, extra: DataFrame, outer: DataFrame, hits: DataFrame) -> DataFrame:
    """type_id of hits and of all their ancestors; hits that aren't labelled stand alone."""
    asked = hits.select("type_id").where("type_id is not null").distinct()
    places = labels.join(asked, "type_id", "left_semi").select("pre", F.lit(1).alias("x"))
    counted = sums_below(labels, places)
    own = counted.where("total > 0").select("type_id")
    # the same for the intervals elsewhere: each begins and ends with a labelled type
    start = counted.select("pre", F.col("last"), "total")
    wide = outer.join(start, ["pre", "last"]).where("total > 0").select(F.col("ancestor_id").alias("type_id"))
    return asked.unionByName(own).unionByName(wide).distinct()


def meeting_places(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (i, j, n; i < j, places in the walk) with `pre`, the place of the lowest type that both are or are below. Pairs of different trees are left out.

    It is the parent of the least deep type in (i, j]. Least depths over 2^k places from each on are doubled from those over 2^(k - 1), as far as pairs need them; a pair reads two of these.
    """
    pairs = saved(pairs, "neighbours").withColumn("k", F.length(F.bin(F.col("j") - F.col("i"))) - 1)
    most = pairs.agg(F.max("k")).first()[0]
    parents = labels.select(F.col("type_id").alias("parent_id"), F.col("pre").alias("up"))
    level = labels.join(parents, "parent_id", "left").select("pre", F.struct("depth", "up").alias("least"))
    levels = [saved(level, "least-depths")]
    for k in range(1, (most or 0) + 1):
        there = levels[-1].select((F.col("pre") - (1 << (k - 1))).alias("pre"), F.col("least").alias("_least"))
        levels.append(saved(levels[-1].join(there, "pre").select("pre", F.least("least", "_least").alias("least")), "least-depths"))
    table = reduce(DataFrame.unionByName, (x.withColumn("k", F.lit(k)) for k, x in enumerate(levels)))
    read = pairs.select("i", "j", "n", "k", F.explode(F.array(F.col("i") + 1, F.expr("j - shiftleft(1L, k) + 1"))).alias("pre"))
    met = read.join(table, ["k", "pre"]).groupBy("i", "j").agg(F.min("least").alias("least"), F.first("n").alias("n"))
    return met.select("i", "j", "n", F.col("least.up").alias("pre")).where("pre is not null")


def _merged(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, and the sums of their counts."""
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    return at[first], np.add.reduceat(n, first) if len(first) else n


def _distinct_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows (asset_path, ats), those of an asset one after another, become partial counts (at, n) of the assets that have each number."""
    none = np.zeros(0, "int64")
    at, n, waiting, size = none, none, [], 0
    last, own = None, none  # of the asset that may go on in the next batch

    def told(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        assets, lists = batch.column("asset_path"), batch.column("ats")
        asset = assets.dictionary_encode().indices.to_numpy()
        pairs = np.repeat(asset.astype("int64"), np.diff(lists.offsets.to_numpy()))
        ats = lists.flatten().to_numpy().astype("int64")
        if last is not None:
            if assets[0] == last:
                pairs, ats = np.append(pairs, np.full(len(own), asset[0])), np.append(ats, own)
            else:
                waiting, size = [*waiting, own], size + len(own)
        most = int(ats.max(initial=0)) + 1
        key = np.sort(pairs * most + ats)
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        pairs, ats = np.divmod(key, most)
        goes_on = pairs == asset[-1]
        last, own = assets[-1], ats[goes_on]
        waiting, size = [*waiting, ats[~goes_on]], size + len(ats) - len(own)
        if size >= PAIRS:
            found = np.concatenate(waiting)
            at, n = _merged(np.append(at, found), np.append(n, np.ones(len(found), "int64")))
            waiting, size = [], 0
            if len(at) >= PAIRS:
                yield told(at, n)
                at, n = none, none
    found = np.concatenate([*waiting, own])
    yield told(*_merged(np.append(at, found), np.append(n, np.ones(len(found), "int64"))))


def assets_inside(cool: DataFrame, many: DataFrame | None, outer: DataFrame, labels: DataFrame) -> DataFrame:
    """(symbol_id, n_assets): distinct assets of the places (asset_path, pre) in the intervals of each type of outer.

    A place has one list of the types that hold it, and goes with it to the task of its asset, which tells the asset's types apart and counts them: pairs of a type and an asset are no rows. Assets of
    very many places are given apart, as `many`, and dealt by type too, as rows.
    """
    own = labels.select(F.col("type_id").alias("ancestor_id"), F.col("pre").alias("at"))
    levels = _levels(labels)
    places = cool.select("pre") if many is None else cool.select("pre").unionByName(many.select("pre"))
    inside = _inside(outer.join(own, "ancestor_id").select(F.col("at").alias("ancestor_id"), "pre", "last"), places, levels).withColumnRenamed("ancestor_id", "at")
    lists = saved(inside.groupBy("pre").agg(F.collect_list(F.col("at").cast("int" if levels < 31 else "long")).alias("ats")), "types-above")
    spark, batch = labels.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(batch).rstrip("b")) > BATCH:
        spark.conf.set(batch, str(BATCH))
    told = cool.join(lists, "pre").select("asset_path", "ats").repartition("asset_path").sortWithinPartitions("asset_path")
    counts = told.mapInArrow(_distinct_counts, "at long, n long")
    if many is not None:
        pairs = many.join(lists, "pre").select("asset_path", F.explode("ats").alias("at")).withColumn("at", F.col("at").cast("long")).distinct()
        counts = counts.unionByName(pairs.groupBy("at").agg(F.count("*").alias("n")))
    return counts.groupBy("at").agg(F.sum("n").alias("n_assets")).join(own, "at").select(F.col("ancestor_id").alias("symbol_id"), "n_assets")


def usage_with_derived(refs: DataFrame, labels: DataFrame, outer: DataFrame) -> DataFrame:
    """(symbol_id, n_assets): distinct assets that use a type or one derived from it. refs: symbol_id, asset_path.

    An asset counts once at each type that it uses, and is taken off once where two neighbours of its types in the walk meet: so it counts once in every interval that holds any of them, and no reference is copied to an ancestor.
    Types with descendants elsewhere (`outer`) are counted by their intervals: references are copied to these only. Symbols that aren't labelled count their own assets.
    """
    used = saved(refs.select("symbol_id", "asset_path").where("symbol_id is not null and asset_path is not null").distinct(), "used")
    placed = saved(used.join(labels.select(F.col("type_id").alias("symbol_id"), "pre"), "symbol_id").select("asset_path", "pre"), "used-places")
    hot = saved(placed.groupBy("asset_path").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("asset_path"), "hot-assets")
    cool, many = (placed, None) if hot.isEmpty() else (placed.join(hot, "asset_path", "left_anti"), placed.join(hot, "asset_path", "left_semi"))
    near = cool.withColumn("next", F.lead("pre").over(Window.partitionBy("asset_path").orderBy("pre")))
    if many is not None:
        near = near.unionByName(scan(many, ["asset_path"], ["pre"], line_block("pre"), nexts={"next": F.col("pre")}))
    near = near.where("next is not null")
    met = meeting_places(labels, near.groupBy(F.col("pre").alias("i"), F.col("next").alias("j")).agg(F.count("*").alias("n")))
    values = placed.groupBy("pre").agg(F.count("*").alias("x")).unionByName(met.select("pre", (-F.col("n")).alias("x")))
    own = sums_below(labels, values).where("total > 0").select(F.col("type_id").alias("symbol_id"), F.col("total").alias("n_assets"))
    alone = used.join(labels.select(F.col("type_id").alias("symbol_id")), "symbol_id", "left_anti").groupBy("symbol_id").agg(F.count("*").alias("n_assets"))
    if outer.isEmpty():
        return own.unionByName(alone)
    wide = assets_inside(cool, many, outer, labels)
    return own.join(outer.select(F.col("ancestor_id").alias("symbol_id")).distinct(), "symbol_id", "left_anti").unionByName(wide).unionByName(alone)
