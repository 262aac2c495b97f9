"""How much of a text its spans cover, and how deep they lie on one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grainmill.functions.ranges import RANGES, cut_points, range_of
from grainmill.functions.store import settled


def coverage(spans: DataFrame, keys: tuple[str, ...], start: str = "start", stop: str = "stop", ranges: int = RANGES) -> DataFrame:
    """(keys, n, covered, depth): spans of a key, the places in their union, and the most spans over one place.

    Spans are half open. A span that ends where it starts, or before, counts in ``n`` and
    covers nothing; one with a null end counts nowhere. Null keys are keys like others.

    A sweep over the ends: ends at one place are added up first, then each key's places are
    swept in ranges, every range starting at the depth that the ones before leave. So one
    key may have any number of spans.
    """
    real = (F.col(stop) > F.col(start)).cast("long")
    one = lambda at, d, n: F.struct(F.col(at).cast("long").alias("at"), d.alias("d"), F.lit(n).cast("long").alias("n"))
    keyed, names = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], [f"_k{i}" for i in range(len(keys))]
    ends = spans.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(*keyed, F.inline(F.array(one(start, real, 1), one(stop, -real, 0))))
    ends = settled(ends.groupBy(*names, "at").agg(F.sum("d").alias("d"), F.sum("n").alias("n")))
    placed = ends.withColumn("part", range_of(F.col("at"), cut_points(ends.select("at"), "at", ranges)))

    in_order = W.partitionBy(*names).orderBy("part")
    parts = placed.groupBy(*names, "part").agg(F.sum("d").alias("d"), F.min("at").alias("first"))
    carried = parts.select(*names, "part", F.coalesce(F.sum("d").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("d"), F.lead("first").over(in_order).alias("after"))
    swept = placed.unionByName(carried, allowMissingColumns=True)
    inside = W.partitionBy(*names, "part").orderBy(F.col("at").asc_nulls_first())
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    swept = swept.select(*names, "at", "n", F.sum("d").over(so_far).alias("depth"), F.coalesce(F.lead("at").over(inside), F.first("after").over(so_far)).alias("next")).where(F.col("at").isNotNull())
    covered = F.sum(F.when(F.col("depth") > 0, F.col("next") - F.col("at")).otherwise(0))
    found = swept.groupBy(*names).agg(F.sum("n").alias("n"), covered.alias("covered"), F.max("depth").alias("depth"))
    return found.select(*[F.col(a).alias(c) for a, c in zip(names, keys)], "n", "covered", "depth")
