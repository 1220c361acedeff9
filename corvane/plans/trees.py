"""Queries over interval labels of a type tree with interfaces, and SQL that walks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import intervals
from corvane.plans import standins as v
from corvane.plans.registry import query

#: All pairs of a type and what is above it.
OVER = """e AS (SELECT p_partkey AS c, p_partkey // 3 AS p FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey % 7 = 3),
r(c, a) AS (SELECT c, p FROM e UNION SELECT r.c, e.p FROM r JOIN e ON r.a = e.c)"""


@query("""WITH RECURSIVE d(type_id, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN d ON p_partkey // 3 = type_id WHERE p_partkey > 0)
SELECT type_id, depth FROM d""")
def type_labels(spark, sf) -> DataFrame:
    """The labels, computed anew; their order is tested by walks."""
    return intervals.label(v.inherits_more(spark, sf))[0].select("type_id", "depth")


@query(f"""WITH RECURSIVE {OVER} SELECT a AS ancestor_id, n_total, n_direct FROM (SELECT a, count(*) AS n_total FROM r WHERE c <> a GROUP BY a) JOIN (SELECT p AS a, count(*) AS n_direct FROM e WHERE c <> p GROUP BY p) USING (a)""")
def interval_subclass_counts(spark, sf) -> DataFrame:
    return intervals.subclass_counts(*v.type_labels(spark, sf))


@query(f"WITH RECURSIVE {OVER} SELECT c AS type_id FROM r WHERE a = 2 AND c <> 2")
def interval_descendants(spark, sf) -> DataFrame:
    labels, _, outer = v.type_labels(spark, sf)
    return intervals.below(labels, outer, 2).select("type_id")


@query(f"WITH RECURSIVE {OVER}, h AS (SELECT p_partkey FROM part WHERE p_name = 'red bolt') SELECT p_partkey AS type_id FROM h UNION SELECT a FROM r JOIN h ON c = p_partkey")
def interval_filtered_tree(spark, sf) -> DataFrame:
    hits = v.symbols(spark, sf).where("name = 'red bolt'").select(F.col("symbol_id").alias("type_id"))
    return intervals.filter_tree(*v.type_labels(spark, sf), hits)


@query(f"""WITH RECURSIVE {OVER}, s AS (SELECT c, a FROM r UNION SELECT p_partkey, p_partkey FROM part)
SELECT a AS symbol_id, count(DISTINCT l_orderkey) AS n_assets FROM lineitem JOIN s ON l_partkey = c GROUP BY a""")
def interval_usage(spark, sf) -> DataFrame:
    """Distinct assets of each type and what is below it, by labels."""
    labels, _, outer = v.type_labels(spark, sf)
    return intervals.usage_with_derived(v.asset_refs(spark, sf).select(F.col("target_id").alias("symbol_id"), "asset_path"), labels, outer)
