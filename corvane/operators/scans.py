"""Running values over ordered rows of a key that may hold most of a table.

A window over a key puts all its rows into one task. Here a key's rows are cut into blocks of their order (days of a session, lines of a file): each block is summed up
(partially before the shuffle), a window over the blocks, one row each, says what each block starts with and what comes after it, and a window inside each
block does the rest. So a session with a third of all rows is spread over as many tasks as it has blocks, and what is shuffled is the rows once and a row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a file, and seconds of a session, that make a block.
LINES, SECONDS = 1 << 16, 86_400


def line_block(line: str | Column, size: int = LINES) -> Column:
    return F.floor((F.col(line) if isinstance(line, str) else line) / size)


def time_block(ts: str, size: int = SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / (size * 1_000_000))


def scan(df: DataFrame, key: list[str], order: list[str], block: Column, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, afters: dict[str, Column] | None = None) -> DataFrame:
    """df with running values by key in order. block: a column that rises with the order (never falls), so that rows of a block are neighbours.

    sums: up to and with the row (nulls count as nothing; null before the first value). lasts: the last value that isn't null up to and with the row. nexts: the value of the next row, null behind the last.
    afters: the first value that isn't null behind the row. A null in the key is a key.
    """
    sums, lasts, nexts, afters = (x or {} for x in (sums, lasts, nexts, afters))
    told = {n: c for group in (sums, lasts, nexts, afters) for n, c in group.items()}
    rows = df.withColumns({"_block": block} | {f"_v_{n}": c for n, c in told.items()})
    v = lambda n: F.col(f"_v_{n}")
    at = F.struct(*order)
    when = lambda n: F.when(v(n).isNotNull(), at)
    parts = rows.groupBy(*key, "_block").agg(
        *[F.sum(v(n)).alias(f"_c_{n}") for n in sums], *[F.max_by(v(n), when(n)).alias(f"_c_{n}") for n in lasts],
        *[F.min_by(F.struct(v(n).alias("x")), at).alias(f"_c_{n}") for n in nexts], *[F.min_by(v(n), when(n)).alias(f"_c_{n}") for n in afters],
    )
    blocks = Window.partitionBy(*key).orderBy("_block")
    before, behind = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
    c = lambda n: F.col(f"_c_{n}")
    carried = [F.sum(c(n)).over(before).alias(f"_c_{n}") for n in sums] + [F.last(c(n), True).over(before).alias(f"_c_{n}") for n in lasts] + [F.lead(c(n)).over(blocks).alias(f"_c_{n}") for n in nexts] + [F.first(c(n), True).over(behind).alias(f"_c_{n}") for n in afters]
    carry = parts.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_block").alias("_b"), *carried)
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = rows.join(carry, same)
    inside = Window.partitionBy(*key, "_block").orderBy(*order)
    upto, rest = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(1, Window.unboundedFollowing)
    made = {n: F.when(c(n).isNull(), F.sum(v(n)).over(upto)).otherwise(c(n) + F.coalesce(F.sum(v(n)).over(upto), F.lit(0))) for n in sums}
    made |= {n: F.coalesce(F.last(v(n), True).over(upto), c(n)) for n in lasts}
    made |= {n: F.coalesce(F.lead(F.struct(v(n).alias("x"))).over(inside), c(n))["x"] for n in nexts}
    made |= {n: F.coalesce(F.first(v(n), True).over(rest), c(n)) for n in afters}
    kept = [x for x in df.columns if x not in told]
    return both.select(*kept, *[x.alias(n) for n, x in made.items()])
