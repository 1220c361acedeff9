"""Brackets in code, matched by a running depth over pieces of text, at any depth and length.

A text is cut into pieces that end with a bracket or a comma, by one pattern that never goes back and never recurses; a fold over the pieces
carries the depth. Brackets and commas in string and character literals don't count. All are built-in expressions, in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals. A quote that closes nothing stands for itself.
STRING = r'"(?:[^"\\\n]++|\\.)*+"'
CHARACTER = r"'(?:\\.|[^'\\\n])'"


def _pieces(text: Column, stops: str) -> Column:
    """The text cut after each of the stops; what follows the last stop is the last piece."""
    inner = rf"""(?:[^"'{stops}]++|{STRING}|{CHARACTER}|["'])"""
    return F.regexp_extract_all(text, F.lit(rf"(?s){inner}*+[{stops}]|{inner}++"), 0)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _step(piece: Column) -> Column:
    return F.when(F.endswith(piece, F.lit("(")), 1).when(F.endswith(piece, F.lit(")")), -1).otherwise(0)


def closing(text: Column) -> Column:
    """How many characters the text has up to and with the parenthesis that closes its first one; 0 if none does."""

    def step(acc: Column, piece: Column) -> Column:
        depth, at = acc["depth"] + _step(piece), acc["at"] + F.length(piece)
        return F.when(acc["end"] > 0, acc).otherwise(F.struct(depth.alias("depth"), at.alias("at"), F.when((depth == 0) & F.endswith(piece, F.lit(")")), at).otherwise(0).alias("end")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    return F.aggregate(_pieces(text, "()"), start, step, lambda acc: acc["end"])


def inside(text: Column) -> Column:
    """What lies in the parentheses that a text begins with, null if they aren't closed."""
    return _let(closing(text), lambda end: F.when(end > 0, F.substring(text, F.lit(2), end - 2)))


def behind(text: Column) -> Column:
    """What follows the parentheses that a text begins with, null if they aren't closed."""
    return _let(closing(text), lambda end: F.when(end > 0, F.substring(text, end + 1, F.length(text))))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n\f\x0b"))


def items(text: Column, angles: bool = False) -> Column:
    """A list cut at its own commas: those outside of parentheses and, with angles, outside of the angle brackets of templates. Items are trimmed, empty ones left out."""
    stops = "(),<>" if angles else "(),"
    size = lambda acc: acc["n"] + 1

    def step(acc: Column, piece: Column) -> Column:
        ends = lambda c: F.endswith(piece, F.lit(c))
        depth = acc["depth"] + _step(piece)
        angle = acc["angle"]
        if angles:  # an arrow closes nothing
            closes = ends(">") & ~ends("->") & (angle > 0)
            angle = F.when(acc["depth"] > 0, angle).when(ends("<"), angle + 1).when(closes, angle - 1).otherwise(angle)
        cut = ends(",") & (acc["depth"] == 0) & (acc["angle"] == 0)
        return F.struct(depth.alias("depth"), angle.alias("angle"), size(acc).alias("n"), F.when(cut, F.concat(acc["cuts"], F.array(size(acc)))).otherwise(acc["cuts"]).alias("cuts"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("angle"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("cuts"))

    def cut(pieces: Column) -> Column:
        ends = F.concat(F.aggregate(pieces, start, step, lambda acc: acc["cuts"]), F.array(F.size(pieces) + 1))
        return _let(ends, lambda e: F.transform(e, lambda to, i: item(pieces, F.when(i == 0, 0).otherwise(F.get(e, i - 1)), to, to > F.size(pieces))))

    def item(pieces: Column, low: Column, to: Column, last: Column) -> Column:
        joined = F.array_join(F.slice(pieces, low + 1, to - low), "")
        return trimmed(F.when(last, joined).otherwise(F.left(joined, F.length(joined) - 1)))

    return F.filter(_let(_pieces(text, stops), cut), lambda x: x != "")


def after_calls(text: Column, names: list[str]) -> Column:
    """The text without the calls of the given macros that it begins with, however many."""
    head = rf"^\s*(?:{'|'.join(names)})\s*\($"

    def step(acc: Column, piece: Column) -> Column:
        opens = (acc["depth"] > 0) | piece.rlike(head)
        depth, at = acc["depth"] + _step(piece), acc["at"] + F.length(piece)
        moved = F.struct(depth.alias("depth"), at.alias("at"), F.when(depth == 0, at).otherwise(acc["end"]).alias("end"), F.lit(False).alias("done"))
        return F.when(acc["done"], acc).when(opens, moved).otherwise(F.struct(acc["depth"].alias("depth"), acc["at"].alias("at"), acc["end"].alias("end"), F.lit(True).alias("done")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(False).alias("done"))
    end = F.aggregate(_pieces(text, "()"), start, step, lambda acc: acc["end"])
    return F.when(text.rlike(rf"^\s*(?:{'|'.join(names)})\s*\("), trimmed(F.substring(text, end + 1, F.length(text)))).otherwise(text)
