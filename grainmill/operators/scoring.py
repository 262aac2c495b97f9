"""From signals to a risk level and a confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.base import f32, let
from grainmill.functions.levels import RISKS, SEVERITY, SecurityLevel

from .combine import type_name


def severity(kind: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), f32(v))]), kind)


def adjusted(s: Column, level: SecurityLevel) -> Column:
    """A signal's confidence, lowered for categories that often fire on legitimate text."""
    keep = lambda share, least: f32(level.kept(share, least))
    c = (
        F.when(s["category"].isin("authority_manipulation_advanced", "urgency_manipulation_advanced"), s["confidence"] * keep(0.3, 0.2))
        .when(s["category"].isin("context_confusion", "context_hijacking_advanced"), s["confidence"] * keep(0.2, 0.3))
        .otherwise(s["confidence"])
    )
    return F.when(s["category"].isNotNull(), F.least(F.greatest(c, f32(0.0)), f32(1.0))).otherwise(s["confidence"])


def score(signals: Column, level: SecurityLevel) -> Column:
    """struct(score, confidence): the weighted mean with its bonus for variety and its penalty for benign signals, and the highest adjusted confidence."""
    weight = f32(level.pattern_weight)
    rated = F.transform(signals, lambda s: F.struct(adjusted(s, level).alias("c"), (severity(s["kind"]) * weight).alias("w")))
    high, low = f32(level.surely_bad), f32(level.surely_good)
    kinds = F.size(F.array_distinct(F.transform(signals, type_name)))
    multiplier = f32(level.combination_multiplier)

    def total(rs: Column) -> Column:
        start = F.struct(f32(0.0).alias("t"), f32(0.0).alias("w"), f32(0.0).alias("m"), F.lit(0).alias("bad"), F.lit(0).alias("good"))
        return F.aggregate(
            rs, start,
            lambda a, r: F.struct(
                (a["t"] + r["c"] * r["w"]).cast("float").alias("t"), (a["w"] + r["w"]).cast("float").alias("w"), F.greatest(a["m"], r["c"]).alias("m"),
                (a["bad"] + (r["c"] > high).cast("int")).alias("bad"), (a["good"] + (r["c"] < low).cast("int")).alias("good"),
            ),
        )

    def result(a: Column) -> Column:
        mean = F.when(a["w"] > 0, (a["t"] / a["w"]).cast("float")).otherwise(f32(0.0))
        variety = F.when(kinds > 2, f32(0.08) * multiplier).when(kinds > 1, f32(0.05) * multiplier).otherwise(f32(0.0))
        share = (a["good"].cast("float") / F.size(signals).cast("float")).cast("float")
        penalty = F.when(a["good"] > a["bad"], -f32(level.benign_factor) * share).otherwise(f32(0.0))
        s = F.least(F.greatest((mean + variety + penalty).cast("float"), f32(0.0)), f32(1.0))
        return F.struct(s.alias("score"), a["m"].alias("confidence"))

    empty = F.struct(f32(0.0).alias("score"), f32(1.0).alias("confidence"))
    return F.when(F.size(signals) == 0, empty).otherwise(let(let(rated, total), result))


def risk_of(s: Column, level: SecurityLevel) -> Column:
    """0 (none) to 4 (critical), descending thresholds; below the level's floor it is 0."""
    critical, high, medium, low = level.thresholds
    r = F.when(s >= f32(critical), 4).when(s >= f32(high), 3).when(s >= f32(medium), 2).when(s >= f32(low), 1).otherwise(0)
    return let(r, lambda x: F.when(x < level.risk_floor, 0).otherwise(x)).cast("byte")


def risk_label(risk: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in RISKS]), (risk + 1).cast("int"))


def assess(signals: Column, level: SecurityLevel) -> Column:
    """struct(risk_level, confidence, score)."""

    def made(x: Column) -> Column:
        risk = F.when(F.size(signals) == 0, F.lit(0).cast("byte")).otherwise(risk_of(x["score"], level))
        return F.struct(risk.alias("risk_level"), x["confidence"].alias("confidence"), x["score"].alias("score"))

    return let(score(signals, level), made)


def is_injection(risk: Column) -> Column:
    return risk >= 2


def top_signal(signals: Column) -> Column:
    """The surest signal; the last of equals."""
    return F.aggregate(signals, F.get(signals, 0), lambda a, s: F.when(s["confidence"] >= a["confidence"], s).otherwise(a))
