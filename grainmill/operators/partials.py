"""Metrics that can be merged: states of any slice of the analyses, kept as a table and folded over any span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.metrics import PERCENTS

#: Size of a sketch of durations: ranks are off by less than a hundredth.
SKETCH = 600
SUMS = ("n", "injections", "sum_ms", "sum_ms2", "positive_sum", "negative_sum", "confidences", "confidence_sum", "confidence_sum2", "positives", "negatives")


def states(a: DataFrame, by: dict[str, Column], duration: str = "duration_ms", confidence: str = "confidence", injection: str = "injection_detected", sketch: int = SKETCH) -> DataFrame:
    """A state for each value of ``by`` (name to column): counts, moments, extremes and a sketch of the durations.

    Rows with an error count nowhere; null durations and confidences count in ``n`` alone. Also of
    a stream, with a watermark and a window of its event time in ``by``.
    """
    ok = a.where(F.col("error").isNull()) if "error" in a.columns else a
    ms, c, hit = F.col(duration).cast("long"), F.col(confidence).cast("double"), F.coalesce(F.col(injection), F.lit(False))
    zero = lambda x, kind="double": F.coalesce(x, F.lit(0)).cast(kind)
    whole = ms.cast("decimal(19,0)")
    return ok.groupBy(*[x.alias(k) for k, x in by.items()]).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("injections"), zero(F.sum(whole), "decimal(38,0)").alias("sum_ms"), zero(F.sum(whole * whole), "decimal(38,0)").alias("sum_ms2"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.count(ms).alias("timed"),
        zero(F.sum(F.when(hit, c))).alias("positive_sum"), zero(F.sum(F.when(~hit, c))).alias("negative_sum"), F.count(F.when(hit, c)).alias("positives"), F.count(F.when(~hit, c)).alias("negatives"),
        F.count(c).alias("confidences"), zero(F.sum(c)).alias("confidence_sum"), zero(F.sum(c * c)).alias("confidence_sum2"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
        F.kll_sketch_agg_bigint(ms, F.lit(sketch)).alias("sketch"),
    )


def fold(s: DataFrame, by: dict[str, Column]) -> DataFrame:
    """States of coarser slices from states; folding in steps gives what one fold does. Without rows and ``by`` one state of nothing."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast(s.schema[c].dataType).alias(c) for c in (*SUMS, "timed")]
    least, most = [F.min(c).alias(c) for c in ("min_ms", "min_confidence")], [F.max(c).alias(c) for c in ("max_ms", "max_confidence")]
    return s.groupBy(*[x.alias(k) for k, x in by.items()]).agg(*sums, *least, *most, F.kll_merge_agg_bigint("sketch").alias("sketch"))


def figures(s: DataFrame, keys: tuple[str, ...] = (), percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """The metrics of each state: exact but for the percentiles ``pNN``, which are ranks of the sketch. Zeros without rows."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    ratio = lambda a, b: zero(F.try_divide(F.col(a).cast("double"), F.col(b)))
    variance = lambda n, total, square: F.greatest(F.lit(0.0), zero(F.try_divide(F.col(square).cast("double"), F.col(n)) - F.pow(F.try_divide(F.col(total).cast("double"), F.col(n)), 2)))
    # in whole numbers, so that nothing cancels out
    spread_ms = F.col("timed").cast("decimal(19,0)") * F.col("sum_ms2").cast("decimal(38,0)") - F.col("sum_ms").cast("decimal(19,0)") * F.col("sum_ms").cast("decimal(19,0)")
    rank = lambda p: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 100.0)))
    return s.select(
        *keys, F.col("n").alias("total_analyzed"), F.col("injections").alias("injections_detected"), F.col("sum_ms").cast("long").alias("total_ms"), F.coalesce("min_ms", F.lit(0)).alias("min_ms"), F.coalesce("max_ms", F.lit(0)).alias("max_ms"),
        ratio("sum_ms", "timed").alias("avg_ms"), zero(F.sqrt(spread_ms.cast("double")) / F.when(F.col("timed") > 0, F.col("timed"))).alias("std_ms"), ratio("injections", "n").alias("detection_rate"),
        ratio("positive_sum", "positives").alias("avg_positive"), ratio("negative_sum", "negatives").alias("avg_negative"), zero(F.col("min_confidence")).alias("min_confidence"), zero(F.col("max_confidence")).alias("max_confidence"),
        F.sqrt(variance("confidences", "confidence_sum", "confidence_sum2")).alias("std_dev"), *[F.coalesce(rank(p), F.lit(0)).cast("long").alias(f"p{p}") for p in percents],
    )
