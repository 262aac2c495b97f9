"""Ordered work on hot keys: a key's rows are cut into ranges of a value, and what the ranges before one hold is carried into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 64


def cut_points(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges - 1`` ascending values that cut the rows into even ranges; a value that fills several ranges is there several times."""
    return sorted(df.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.001)) if ranges > 1 else []


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts are below the value: a tree of comparisons."""

    def tree(least: int, most: int) -> Column:
        if least == most:
            return F.lit(least)
        mid = (least + most) // 2
        return F.when(value <= cuts[mid], tree(least, mid)).otherwise(tree(mid + 1, most))

    return tree(0, len(cuts))


def ranges_at(value: Column, cuts: list[float]) -> Column:
    """How many ranges from ``range_of`` on the rows at just this value may be dealt over: one, but for values that are cuts several times."""
    many = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1}
    return F.coalesce(*[F.when(value == c, F.lit(n)) for c, n in sorted(many.items())], F.lit(1))
