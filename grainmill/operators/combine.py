"""Signals from combinations of signals, and the filter by kind of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.base import cap, contains_any, f32, let, n_bytes

from .signals import present, signal, with_fields

# Names, conditions and confidences of the combinations, and the phrases they look for.
PAIRS = (
    ("c_triple", ("EncodingBypass", "InstructionOverride", "SocialEngineering"), "Triple-Vector Attack", 0.85, 0.05),
    ("c_multi", ("EncodingBypass", "InstructionOverride"), "Multi-Vector Attack", 0.8, 0.03),
    ("c_socjail", ("SocialEngineering", "Jailbreak"), "Social Engineering Jailbreak", 0.85, 0.05),
    ("c_ctxrole", ("ContextConfusion", "RolePlaying"), "Context Role Manipulation", 0.8, 0.05),
    ("c_socdata", ("DataExtraction", "SocialEngineering"), "Social Data Extraction", 0.85, 0.05),
)
CLAIMS = ("i am your", "this is your", "developer", "admin")
URGENCY = ("urgent", "emergency", "immediately", "asap")


def type_name(s: Column) -> Column:
    """Kinds, with each custom name a kind of its own."""
    return F.when(s["kind"] == "Custom", F.concat(F.lit("Custom:"), s["custom_name"])).otherwise(s["kind"])


def mean_confidence(signals: Column) -> Column:
    total = F.aggregate(signals, f32(0.0), lambda a, s: (a + s["confidence"]).cast("float"))
    return F.when(F.size(signals) > 0, (total / F.size(signals).cast("float")).cast("float")).otherwise(f32(0.0))


def pressing(text: Column) -> Column:
    """Whether a text both claims authority and urges."""
    return let(F.lower(text), lambda low: contains_any(low, CLAIMS) & contains_any(low, URGENCY))


def combinations(signals: Column, text: Column) -> dict[str, Column]:
    """Each combination's signal, null where its condition fails."""
    return combined(signals, pressing(text), n_bytes(text))


def combined(signals: Column, pressed: Column, size: Column) -> dict[str, Column]:
    """``combinations`` for a text of which so much is known."""
    has = lambda kind: F.exists(signals, lambda s: s["kind"] == kind)
    made = lambda name, base, share: let(mean_confidence(signals), lambda m: signal("combination", "Custom", cap(f32(base) + m * f32(share)), custom_name=name))
    out = {}
    for key, kinds, name, base, share in PAIRS:
        met = F.lit(True)
        for k in kinds:
            met = met & has(k)
        out[key] = F.when(met, made(name, base, share))
    out["c_authurg"] = F.when(has("SocialEngineering") & pressed, made("Authority Urgency Manipulation", 0.8, 0.1))
    out["c_escal"] = F.when((size > 200) & (F.size(signals) > 2), made("Gradual Escalation Attack", 0.75, 0.05))
    out["c_multistage"] = F.when(F.size(F.array_distinct(F.transform(signals, type_name))) >= 4, made("Sophisticated Multi-Stage Attack", 0.9, 0.1))
    return out


def combination_signals(signals: Column, text: Column) -> Column:
    return present(*combinations(signals, text).values())


def halve_in_questions(signals: Column, question: Column) -> Column:
    """Social signals count half in questions."""
    return F.transform(signals, lambda s: with_fields(s, confidence=F.when(question & (s["kind"] == "SocialEngineering"), s["confidence"] * f32(0.5)).otherwise(s["confidence"])))


def lower_in_lessons(signals: Column, educational: Column) -> Column:
    """Signals of authority or urgency count less in educational texts."""
    pressed = lambda s: F.coalesce(s["category"].contains("authority") | s["category"].contains("urgency"), F.lit(False))
    return F.transform(signals, lambda s: with_fields(s, confidence=F.when(educational & pressed(s), s["confidence"] * f32(0.4)).otherwise(s["confidence"])))


def drop_faint(signals: Column, either: Column) -> Column:
    """Signals under 0.15 go from questions and educational texts."""
    return F.filter(signals, lambda s: ~((s["confidence"] < f32(0.15)) & either))


def filter_by_context(signals: Column, question: Column, educational: Column) -> Column:
    flags = F.struct(question.alias("q"), educational.alias("e"))
    left = lambda f: drop_faint(lower_in_lessons(halve_in_questions(signals, f["q"]), f["e"]), f["q"] | f["e"])
    return F.when(F.size(signals) == 0, signals).otherwise(let(flags, left))
