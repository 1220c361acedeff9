"""Cycles in directed graphs, in rows that grow with the edges, times the logarithm of the longest chain.

1. Trimming: edges on no cycle go. Nodes with one edge out point on; doubled pointers tell where each such way ends, and if that is a node without an edge out, all of the way goes at once
   (the same for edges in). So a chain of any length costs a logarithm of rounds, not one a node.
2. Simple cycles: where all nodes have one edge out (or in) after trimming, pointers that never end go round. A cycle's nodes are what 2^k steps lead to; its smallest node names it.
   Graphs in which each thread waits for one lock have no others.
3. What is left is cut into strongly connected components by forward and backward colours, and shortest cycles are searched inside one component only, by a doubling closure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.tables import saved


def pointers(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of steps (u, v), one for each u: (u, v) with v where the way from u ends, and (u, v, least) of those that never end, with v on the cycle that they lead to and the smallest node passed.

    A doubling ends some ways as long as there are any that end; the others are doubled until they have gone round.
    """
    now = saved(step.select("u", "v", F.least("u", "v").alias("least")), "pointers")
    domain = now.select(F.col("u").alias("v"))

    def doubled(p: DataFrame) -> DataFrame:
        there = p.select(F.col("u").alias("v"), F.col("v").alias("_v"), F.col("least").alias("_least"))
        return saved(p.join(there, "v", "left").select("u", F.coalesce("_v", "v").alias("v"), F.least("least", "_least").alias("least")), "pointers")

    last, n = None, now.join(domain, "v", "left_semi").count()
    while n and n != last:
        now = doubled(now)
        last, n = n, now.join(domain, "v", "left_semi").count()
    ended, round_ = now.join(domain, "v", "left_anti").select("u", "v"), now.join(domain, "v", "left_semi")
    if n:
        steps, round_ = 1, saved(step.join(round_.select("u"), "u", "left_semi").select("u", "v", F.least("u", "v").alias("least")), "pointers")
        while steps < n:
            steps, round_ = 2 * steps, doubled(round_)
    return ended, round_.select("u", "v", "least")


def _single(edges: DataFrame) -> DataFrame:
    """The edges of nodes with one edge out."""
    return edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").select("u", "v")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that touch none of nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_anti").join(nodes.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges (u, v) that remain when nodes without an edge in or without an edge out are taken away until there are none."""
    before, now = None, edges.count()
    while now and now != before:
        for _ in range(2):
            ends = edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_anti").distinct()
            ended, _round = pointers(_single(edges))
            dead = ends.select(F.col("v").alias("node")).unionByName(ended.join(ends, "v", "left_semi").select(F.col("u").alias("node")))
            edges = saved(_turned(_without(edges, saved(dead, "dead"))), "edges")
        before, now = now, edges.count()
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (u, v), named by their largest node. Rounds are as many as the longest of the shortest ways in a component."""
    edges, found = saved(edges.select("u", "v"), "edges"), []
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    while not edges.isEmpty():
        colour = saved(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
        changed = True
        while changed:  # the largest node that reaches each
            sent = edges.join(colour.toDF("u", "_sent"), "u").groupBy(F.col("v").alias("node")).agg(F.max("_sent").alias("_sent"))
            new = saved(colour.join(sent, "node", "left").select("node", F.greatest("colour", "_sent").alias("colour"), (F.col("_sent") > F.col("colour")).alias("_new")), "colours")
            colour, changed = new.select("node", "colour"), not new.where("_new").isEmpty()
        same = saved(edges.join(colour.toDF("u", "cu"), "u").join(colour.toDF("v", "cv"), "v").where("cu = cv").select("u", "v"), "edges")
        front = colour.where("node = colour")
        reached = [front]
        while not front.isEmpty():  # what reaches the colour's own node
            known = reduce(DataFrame.unionByName, reached)
            front = saved(same.join(front.toDF("v", "colour"), "v").select(F.col("u").alias("node"), "colour").distinct().join(known, ["node", "colour"], "left_anti"), "reached")
            reached.append(front)
        own = saved(reduce(DataFrame.unionByName, reached), "component")
        found.append(own.select("node", F.col("colour").alias("component")))
        edges = saved(_without(same, own), "edges")
    alone = nodes.withColumn("component", F.col("node"))  # nodes whose edges all lead to other components
    return reduce(DataFrame.unionByName, found).unionByName(alone.join(reduce(DataFrame.unionByName, found).select("node"), "node", "left_anti")) if found else alone


def shortest_cycles(edges: DataFrame, closure) -> DataFrame:
    """(node, cycle_length) of the nodes of edges (u, v) that lie on a cycle. closure: of (u, v), all (u, v, depth) with u = v kept."""
    edges = saved(edges.where("u is not null and v is not null").select("u", "v").distinct(), "edges")
    found = [edges.where("u = v").select(F.col("u").alias("node"), F.lit(1).cast("long").alias("cycle_length"))]
    rest = trimmed(edges.where("u <> v"))
    while True:
        solved = []
        for way in (rest, _turned(rest)):
            _, going = pointers(_single(way))
            on = saved(going.join(going.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("node"), "least"), "cycles")
            solved.append(on.join(on.groupBy("least").agg(F.count("*").alias("cycle_length")), "least").select("node", "cycle_length"))
        done = saved(solved[0].unionByName(solved[1]).distinct(), "cycles")
        if done.isEmpty():
            break
        found.append(done)
        rest = trimmed(_without(rest, done))
    if not rest.isEmpty():
        c = strong_components(rest)
        inside = rest.join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v").where("cu = cv").select("u", "v")
        found.append(closure(inside).where("u = v").select(F.col("u").alias("node"), F.col("depth").cast("long").alias("cycle_length")))
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("cycle_length").alias("cycle_length"))
