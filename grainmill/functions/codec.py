"""Strict decoders that give null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROTATED = "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"


def utf8(data: Column) -> Column:
    """The string, or null where the bytes are no UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def base64_bytes(text: Column) -> Column:
    """Standard alphabet, canonical padding, zero trailing bits; else null."""
    shaped = text.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.octet_length(text) % 4 == 0)
    data = F.try_to_binary(F.when(shaped, text), F.lit("base64"))
    return F.when(F.regexp_replace(F.base64(data), "[\r\n]", "") == text, data)


def hex_bytes(text: Column) -> Column:
    return F.unhex(F.when(text.rlike(r"^([0-9A-Fa-f]{2})*\z"), text))


def percent_decode(text: Column) -> Column:
    """``%XX`` decoded, ``+`` and stray ``%`` kept; the text itself where the bytes are no UTF-8."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(safe)
    odd = "\N{REPLACEMENT CHARACTER}"
    bad = decoded.contains(odd) & ~text.contains(odd) & ~F.lower(text).contains("%ef%bf%bd")
    return F.when(~text.contains("%"), text).otherwise(F.when(bad | decoded.isNull(), text).otherwise(decoded))


def rot13(text: Column) -> Column:
    return F.translate(text, LETTERS, ROTATED)
