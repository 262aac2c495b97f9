"""Rows joined to what was in force at their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grainmill.functions.ranges import RANGES, cut_points, range_of, ranges_at


def asof_join(left: DataFrame, right: DataFrame, on: tuple[str, ...], left_at: str, right_at: str, values: tuple[str, ...], ties: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the last row of ``right`` with its key that is not later.

    ``on`` are columns of both sides and may be none (one history for all rows);
    the times are timestamps. Of right rows with one key and time the greatest by
    ``ties`` counts, then by ``values``. A left row with a null key or time, or without a row so early,
    has nulls; right rows with a null key or time are never met. Values are null where the
    row in force has nulls. Columns of ``left`` named as values are replaced.

    Both sides are united and exchanged once, by key and range of time, so that a hot key is
    many tasks; the last right row of each range is carried into the later ones. Left rows at
    one instant that would fill several ranges are dealt over those by their content, so only
    wholly equal rows stay together.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    keyed = [F.col(c).alias(k) for c, k in zip(on, keys)]
    kept = [c for c in left.columns if c not in values]
    value = F.struct(*[F.col(c).alias(c) for c in values])
    whole = F.col(right_at).isNotNull()
    for c in on:
        whole = whole & F.col(c).isNotNull()
    rows = right.where(whole).select(*keyed, F.unix_micros(F.col(right_at).cast("timestamp")).alias("_at"), value.alias("_v"), F.struct(*[F.col(c) for c in ties], value).alias("_t"))
    last = rows.groupBy(*keys, "_at").agg(F.max_by("_v", "_t").alias("_v"))
    mine = left.select(*keyed, F.unix_micros(F.col(left_at).cast("timestamp")).alias("_at"), F.struct(*[F.col(c).alias(c) for c in kept]).alias("_row"))
    known = F.col("_at").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    v_type = last.schema["_v"].dataType

    ok = mine.where(known)
    cuts = cut_points(ok.select("_at"), "_at", ranges)
    at = F.col("_at")
    places = ok.withColumn("_range", range_of(at, cuts) + F.pmod(F.xxhash64("_row"), ranges_at(at, cuts)).cast("int")).withColumn("_v", F.lit(None).cast(v_type)).withColumn("_side", F.lit(1))
    given = last.withColumn("_range", range_of(at, cuts)).withColumn("_row", F.lit(None).cast(mine.schema["_row"].dataType)).withColumn("_side", F.lit(0))
    both = places.unionByName(given)
    # the last right row of each range, or none, then of all ranges before
    ends = both.groupBy(*keys, "_range").agg(F.max_by("_v", F.when(F.col("_side") == 0, at)).alias("_v"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_range", F.last("_v", True).over(before).alias("_v")).where(F.col("_v").isNotNull())
    both = both.unionByName(carried.withColumn("_side", F.lit(-1)), allowMissingColumns=True)
    upto = W.partitionBy(*keys, "_range").orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_v", F.last("_v", True).over(upto)).where("_side = 1").select("_row", "_v")
    alone = mine.where(~known).select("_row", F.lit(None).cast(v_type).alias("_v"))
    return met.unionByName(alone).select("_row.*", *[F.col("_v")[c].alias(c) for c in values])
