"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the node; its result is written to the shared folder, so lineage stays
short and a lost executor costs one step. A hub's edges are rows, never one value: the adaptive join splits them. The
driver sees two numbers a step (count and checksum of the edges), never the edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import saved, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = saved, most_steps: int = 60) -> DataFrame:
    """(u, v): each node that isn't the smallest of its component, with that smallest node.

    edges: u, v (long). Null ends and loops are ignored; repeated edges do no harm; no edges give no rows. keep writes the result.
    """
    with scratch(edges.sparkSession) as save:
        now = save(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        told = None
        for _ in range(most_steps):
            now = save(_small_star(save(_large_star(now), "large-star")), "small-star")
            sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if sums == told:
                return keep(now, "components")
            told = sums
    raise RuntimeError("the components have not settled")
