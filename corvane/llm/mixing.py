"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

The targets: sources in code point order, null last, take the weights in turn and share `share` times all words. A
target stops at `most` times its source's words; what that leaves goes to the other sources by weight, again until no
target is above its stop. The sampling: within a source every document expects rate = target / words copies. Documents
are put in order, the expected copies are summed up, one random offset per source (from the seed) is added, and a
document is emitted once for each whole number that its step crosses. So a document gets floor(rate) or ceil(rate)
copies. The order is by size class, then by a hash, so that every class of sizes is sampled evenly and a source's words
come within about one large document of the target.

Null texts have size 0. Documents of size 0 are sampled like the others but take no words. A source without words has
target 0 and emits nothing. Repeated rows (same id) are ordered by size, then share a rank order that doesn't matter,
as they are alike. Columns of the input stay in `mixed`; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, table, text_of

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, "mix-1"
#: A source's rows are ranked in (size class, one of SPLITS hash ranges) groups, so that no source lands in one task.
SPLITS = 256


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with `target`: one row per source, so the windows over all of them stay small.

    A source stops when its cap is at most its share. In the order of cap per weight those that stop come first, so the
    stopping ones are a prefix: found with running sums and no loop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), turn + 1)
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(share)).withColumn("all_weight", F.sum("weight").over(every))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("stops", F.col("cap") * F.col("weight_left") <= (F.col("budget") - F.col("cap_before")) * F.col("weight"))
    open_sum = lambda c: F.coalesce(F.sum(F.when(~F.col("stops"), F.col(c))).over(every), F.lit(0))
    stop_sum = F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(every), F.lit(0))
    left = (F.col("budget") - stop_sum) * F.col("weight") / open_sum("weight")
    return t.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(left.cast("double")).alias("target"))


def _size_class(size: Column) -> Column:
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 2, 3))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, keep: tuple = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), and the columns in `keep`.

    Ranks are built in two steps: rows are counted per (source, size class, hash range), those counts are summed up within the
    source, and each group adds the rank inside it. The counts are at most SPLITS times a few dozen classes a source.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    base = base.withColumn("key", key).withColumn("class", _size_class(F.col("size")))
    base = base.withColumn("split", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % SPLITS)
    group = ["source", "class", "split"]
    counts = base.groupBy(*group).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("class", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "source_size", "target")
    within = Window.partitionBy(*group).orderBy("key", "doc_id", "size")
    ranked = base.withColumn("within", F.row_number().over(within))
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.class") == F.col("s.class")) & (F.col("r.split") == F.col("s.split"))
    ranked = ranked.alias("r").join(starts.alias("s"), same).select("r.*", "before", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    name = F.concat(F.lit(seed), F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), "source")))
    offset = F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rank = F.col("before") + F.col("within")
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *[F.col(f"_keep_{c}").alias(c) for c in keep if c not in ("doc_id", "source")])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: each document's row, all its columns, as many times as it has copies."""
    names = {options.get(k, k) for k in ("doc_id", "text", "source")}
    whole = docs.select(*names, F.struct(*docs.columns).alias("_row"))
    plan = mix_plan(whole, keep=("_row",), **options).where("copies > 0")
    return plan.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def op5_mixing(spark, sf_dir) -> DataFrame:
    """What the mix takes of each document."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB. Its water level is found the plain way: by asking of each source whether it stops.
OP5_SQL = rf"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), b AS (
  SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 2, 3) AS class, ('0x' || substr(key, 1, 8))::BIGINT % {SPLITS} AS split FROM base
), w AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight FROM base GROUP BY source
), tot AS (SELECT sum(source_size) * 1.5::DOUBLE AS budget, sum(weight) AS all_weight FROM w
), o AS (
  SELECT w.*, 2 * source_size AS cap, budget,
    coalesce(sum(2 * source_size) OVER p, 0) AS cap_before, all_weight - coalesce(sum(weight) OVER p, 0) AS weight_left
  FROM w, tot WINDOW p AS (ORDER BY 2 * source_size / weight::DOUBLE, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s AS (SELECT *, cap * weight_left <= (budget - cap_before) * weight AS stops FROM o
), t AS (
  SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE
    (budget - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0)) * weight / sum(CASE WHEN NOT stops THEN weight END) OVER () END AS target FROM s
), r AS (
  SELECT b.*, source_size, target, row_number() OVER (PARTITION BY b.source ORDER BY class, split, key, doc_id, size) AS rank,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1' || coalesce(':' || b.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (floor(rank * rate + start) - floor((rank - 1) * rate + start))::BIGINT * size AS taken FROM r
"""
