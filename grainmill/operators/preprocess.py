"""What a prompt goes through before it is analysed, and what kind of text it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions import codec
from grainmill.functions.base import contains_any, each_of, let, n_bytes, truncate_bytes, words

# Openers of questions, words of educational texts, and weights of benign ones.
OPENERS = ("how ", "what ", "why ", "when ", "where ", "can you ", "could you ", "would you ")
EDUCATIONAL = (
    "explain", "teach", "learn", "understand", "study", "research", "mathematics", "science", "programming", "algorithm", "calculate", "analyze", "theory", "concept", "definition", "example",
)
BENIGN = (
    (r"^(how|what|why|when|where|which|who)\s+", 0.8),
    (r"\b(can you|could you|would you|will you)\s+(help|explain|tell|show)\b", 0.7),
    (r"\b(please\s+)?(help|explain|describe|calculate|translate|write)\b", 0.6),
    (r"\b(learn|study|understand|research|knowledge|information)\b", 0.5),
    (r"\b(mathematics|science|history|literature|programming|code)\b", 0.6),
    (r"\b(thank you|thanks|please|appreciate|grateful)\b", 0.4),
    (r"\b(recipe|story|poem|joke|summary|analysis)\b", 0.5),
)


@dataclass(frozen=True)
class Preprocessing:
    normalize_unicode: bool = True
    decode_encodings: bool = True
    max_length: int = 10_000
    preserve_formatting: bool = False


def too_long(text: Column, p: Preprocessing) -> Column:
    return n_bytes(text) > p.max_length


def drop_controls(text: Column) -> Column:
    """Control characters but line feeds and tabs go."""
    return F.regexp_replace(text, each_of("".join(chr(i) for i in (*range(32), *range(127, 160)) if chr(i) not in "\n\t")) + "+", "")


def base64_whole(text: Column) -> Column:
    """The decoded text, where the whole is base64 that ends in padding; else the text."""
    shaped = (n_bytes(text) > 20) & text.rlike(r"^[A-Za-z0-9+/=]+\z") & text.endswith("=")
    return F.when(shaped, F.coalesce(codec.utf8(codec.base64_bytes(text)), text)).otherwise(text)


def preprocess(text: Column, p: Preprocessing = Preprocessing()) -> Column:
    out = drop_controls(text) if p.normalize_unicode else text
    if p.decode_encodings:
        out = let(let(out, codec.percent_decode), base64_whole)
    return let(out, lambda t: truncate_bytes(t, p.max_length))


def is_question(text: Column) -> Column:
    def opened(low: Column) -> Column:
        out = text.rlike(r"(?U)\?\s*\z")
        for o in OPENERS:
            out = out | low.startswith(o)
        return out

    return let(F.lower(F.substring(text, 1, max(map(len, OPENERS)))), opened)


def is_educational(text: Column) -> Column:
    return contains_any(F.lower(text), EDUCATIONAL)


def looks_benign(text: Column) -> Column:
    """Diagnostic only: no score depends on it."""
    low, score = F.lower(text), F.lit(0.0)
    for rx, w in BENIGN:
        score = score + F.when(low.rlike("(?U)" + rx), w).otherwise(0.0)
    n = F.size(words(text))
    average = F.regexp_count(text, F.lit(r"\p{IsAlphabetic}")) / F.greatest(n, F.lit(1))
    score = score + F.when((n > 0) & (average >= 3.0) & (average <= 8.0), 0.2).otherwise(0.0)
    return score + F.when(text.rlike(r"[.?!]\z"), 0.1).otherwise(0.0) > 0.8
