"""Keyword and structure checks over the first bytes of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.base import cap, count_contained, f32, let, truncate_bytes, weighted

from .signals import present, signal

# The phrases and their factors.
CONFUSION = (
    ("contradiction", ("but actually", "however in reality"), 1.2),
    ("misdirection", ("what I really mean", "to clarify"), 1.1),
    ("ambiguity", ("or rather", "I mean to say"), 1.0),
)
EMOTIONAL = ("please help", "desperately need", "urgent", "critical", "emergency")
AUTHORITY = ("boss", "manager", "supervisor", "administrator", "security")
SWITCHES = ("now let's talk about", "switching topics", "changing the subject", "on a different note", "by the way", "oh and also")


def confusion(text: Column, threshold: float) -> list[Column]:
    """Case-sensitive."""
    long = F.least((F.length(text).cast("float") / f32(100.0)).cast("float"), f32(1.5))
    out = []
    for name, (a, b), factor in CONFUSION:
        made = let(cap(f32(0.6) * long * f32(factor)), lambda c, name=name: F.when(c >= f32(threshold), signal("keyword", "ContextConfusion", c, heuristic="confusion", detail=name)))
        out.append(F.when(text.contains(a) | text.contains(b), made))
    return out


def intent_score(text: Column) -> Column:
    weights = tuple((w, 0.2) for w in EMOTIONAL) + tuple((w, 0.15) for w in AUTHORITY)
    return let(F.lower(text), lambda low: weighted(low, weights))


def intent(text: Column, threshold: float) -> Column:
    def made(s: Column) -> Column:
        c = cap(s) * f32(0.8)
        return F.when((s >= f32(0.3)) & (c >= f32(threshold)), signal("keyword", "SocialEngineering", c, heuristic="manipulation"))

    return let(intent_score(text), made)


def switches(text: Column, threshold: float) -> Column:
    def made(n: Column) -> Column:
        c = cap(n.cast("float") * f32(0.3))
        return F.when((n >= 2) & (c >= f32(threshold)), signal("keyword", "ContextConfusion", c, heuristic="context_switching", detail=n.cast("string")))

    return let(count_contained(F.lower(text), SWITCHES), made)


def keyword_signals(text: Column, threshold: float, max_bytes: int) -> Column:
    return let(truncate_bytes(text, max_bytes), lambda t: present(*confusion(t, threshold), intent(t, threshold), switches(t, threshold)))
