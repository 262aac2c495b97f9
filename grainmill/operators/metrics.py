"""Aggregates over analyses. Rows with an error are no analyses and count nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.levels import RISKS, SEVERITY
from grainmill.functions.text import at_places

PERCENTS = (50, 90, 95, 99)
#: How many samples, and how old, the percentile and confidence figures may rest on.
SAMPLES, SAMPLE_AGE = 10_000, "1 hour"


def totals(a: DataFrame, duration: str = "duration_ms", injection: str = "injection_detected") -> DataFrame:
    """One row; zeros without rows."""
    n, hit = F.count("*"), F.coalesce(F.count_if(F.col(injection)), F.lit(0))
    return a.agg(
        n.alias("total_analyzed"), hit.alias("injections_detected"), F.coalesce(F.sum(duration), F.lit(0)).alias("total_ms"),
        F.coalesce(F.min(duration), F.lit(0)).alias("min_ms"), F.coalesce(F.max(duration), F.lit(0)).alias("max_ms"), F.coalesce(F.avg(duration), F.lit(0.0)).alias("avg_ms"),
        F.coalesce(F.try_divide(hit, n), F.lit(0.0)).alias("detection_rate"),
    )


def detection_rate_percent(t: DataFrame) -> DataFrame:
    return t.select((F.col("detection_rate") * 100).alias("detection_rate_percent"))


def by_risk(a: DataFrame, label: str = "risk_label") -> DataFrame:
    return a.groupBy(label).agg(F.count("*").alias("n"))


def by_threat(a: DataFrame, signals: str = "signals") -> DataFrame:
    """Signals, not prompts; all custom names are one kind."""
    return a.select(F.explode(signals).alias("s")).groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"))


def confidence_stats(a: DataFrame, confidence: str = "confidence", injection: str = "injection_detected") -> DataFrame:
    c = F.col(confidence).cast("double")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return a.agg(
        zero(F.avg(F.when(F.col(injection), c))).alias("avg_positive"), zero(F.avg(F.when(~F.col(injection), c))).alias("avg_negative"),
        zero(F.min(c)).alias("min_confidence"), zero(F.max(c)).alias("max_confidence"), zero(F.stddev_pop(c)).alias("std_dev"),
    )


def percentiles(a: DataFrame, value: str = "duration_ms", percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """One row, ``pNN`` each: the value at place floor(n * p / 100) in ascending order, from 0; 0 without rows."""
    return at_places(a, value, lambda n: {f"p{p}": min(n * p // 100, n - 1) for p in percents}, F.lit(0))


def snapshot(
    a: DataFrame, duration: str = "duration_ms", at: str = "recorded_at", seq: str = "seq", samples: int = SAMPLES, age: str = SAMPLE_AGE, now: Column | None = None
) -> DataFrame:
    """One row of everything: the totals, ``risk_levels`` and ``threat_types`` (arrays of name and n, those that occur, by name), and, over the retained samples, ``confidence_stats`` and ``percentiles``.

    ``a``: analyses with their duration, time and number. Counts are one pass without an
    exchange of rows; samples are bounded. Rows with an error count nowhere. Without
    analyses all figures are zero and the arrays empty.
    """
    ok = a.where(F.col("error").isNull()) if "error" in a.columns else a
    t = totals(ok, duration)
    tally = lambda names, count: F.filter(F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(count(k), F.lit(0)).cast("long").alias("n")) for k in sorted(names)]), lambda x: x["n"] > 0)
    counts = ok.agg(
        tally(RISKS, lambda k: F.count_if(F.col("risk_label") == k)).alias("risk_levels"), tally(SEVERITY, lambda k: F.sum(F.size(F.filter("signals", lambda s: s["kind"] == k)))).alias("threat_types")
    )
    kept = retained(ok, at, seq, now, samples, age)
    stats, ranks = confidence_stats(kept), percentiles(kept, duration)
    parts = [x.select(F.struct("*").alias(name)) for name, x in (("totals", t), ("counts", counts), ("confidence_stats", stats), ("percentiles", ranks))]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    one = rows.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in ("totals", "counts", "confidence_stats", "percentiles")])
    return one.select("totals.*", "counts.*", "confidence_stats", "percentiles")


def retained(a: DataFrame, at: str = "recorded_at", seq: str = "seq", now: Column | None = None, samples: int = SAMPLES, age: str = SAMPLE_AGE) -> DataFrame:
    """The newest ``samples`` rows that are at most ``age`` old, as of ``now`` (the newest row's time by default)."""
    last = a.agg(F.max(at)).first()[0] if now is None else None
    since = (F.lit(last).cast(a.schema[at].dataType) if now is None else now) - F.expr(f"INTERVAL {age}")
    return a.where(F.col(at) >= since).orderBy(F.desc(at), F.desc(seq)).limit(samples)


def reset(a: DataFrame) -> DataFrame:
    return a.limit(0)


def label_evaluation(a: DataFrame, labels: DataFrame, key: str, safe: str = "expected_safe") -> DataFrame:
    """Hits and misses against labels, and their rates."""
    j = a.join(labels, key)
    flagged, unsafe = F.col("injection_detected"), ~F.col(safe)
    n = lambda c: F.count_if(c)
    return j.agg(
        F.count("*").alias("n"), n(flagged & unsafe).alias("true_positives"), n(flagged & ~unsafe).alias("false_positives"), n(~flagged & unsafe).alias("false_negatives"),
        n(~flagged & ~unsafe).alias("true_negatives"), F.try_divide(n(flagged & ~unsafe), n(~unsafe)).alias("false_positive_rate"), F.try_divide(n(~flagged & unsafe), n(unsafe)).alias("false_negative_rate"),
    )


def false_positive_rate(a: DataFrame) -> DataFrame:
    """Unknown without labels."""
    return a.agg(F.lit(None).cast("double").alias("false_positive_rate"))
