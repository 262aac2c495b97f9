"""Other readings of a text: what it decodes to, for a second scan by the dictionary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions import codec
from grainmill.functions.base import DIGITS, LETTERS, cap, each_of, f32, let, n_bytes

from .preprocess import drop_controls
from .signals import with_fields


def _kept(v: Column, text: Column) -> Column:
    return let(v, lambda x: F.when((x != text) & (n_bytes(x) > 5), x))


def url_variant(text: Column) -> Column:
    return let(codec.percent_decode(text), lambda v: F.when(v != text, v))


def base64_variant(text: Column) -> Column:
    pad = n_bytes(text) - n_bytes(F.regexp_replace(text, r"=+\z", ""))
    shaped = (n_bytes(text) >= 16) & text.rlike(r"^[A-Za-z0-9+/=]+\z") & (pad <= 2) & ((n_bytes(text) % 4 == 0) | (pad == 0))
    return F.when(shaped, _kept(codec.utf8(codec.base64_bytes(text)), text))


def base64_fragments(text: Column) -> Column:
    c = each_of(LETTERS + DIGITS + "+/")
    found = F.regexp_extract_all(text, F.lit(f"(?<!{c}){c}{{16,}}={{0,2}}"), 0)
    return F.array_compact(F.transform(found, lambda c: _kept(codec.utf8(codec.base64_bytes(c)), text)))


def hex_variant(text: Column) -> Column:
    shaped = lambda bare: (n_bytes(bare) >= 20) & (n_bytes(bare) % 2 == 0)
    read = let(F.regexp_replace(text, "^0x", ""), lambda bare: F.when(shaped(bare), _kept(codec.utf8(codec.hex_bytes(bare)), text)))
    return F.when(F.substring(text, 1, 20).rlike(r"^(0x)?[0-9a-fA-F]*\z"), read)


def rot13_variant(text: Column) -> Column:
    return _kept(codec.rot13(text), text)


def control_variant(text: Column) -> Column:
    return _kept(drop_controls(text), text)


def decoded_variants(text: Column) -> Column:
    """Distinct readings in order that differ from the text and are longer than 5 bytes."""
    single = F.array(url_variant(text), base64_variant(text), hex_variant(text), rot13_variant(text), control_variant(text))
    every = F.concat(F.array_compact(single), base64_fragments(text))
    return F.array_sort(F.array_distinct(F.filter(every, lambda v: (v != text) & (n_bytes(v) > 5))))


def decoded_signals(signals: Column) -> Column:
    """Signals of a variant: no span holds in the prompt's coordinates, and they count slightly more."""
    return F.transform(
        signals,
        lambda s: with_fields(s, stage=F.lit("variant"), span=F.lit(None), span_omitted=F.lit("decoded_variant_coordinates"), confidence=cap(s["confidence"] * f32(1.05))),
    )
