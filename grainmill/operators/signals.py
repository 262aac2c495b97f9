"""The shape of a signal, and how one is made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One detected threat. ``stage`` says what found it; fields that do not apply are null.
SIGNAL = (
    "struct<stage:string,kind:string,custom_name:string,confidence:float,"
    "span:struct<start:int,end:int,content:string>,category:string,pattern_index:int,heuristic:string,detail:string,span_omitted:string>"
)
FIELDS = ("stage", "kind", "custom_name", "confidence", "span", "category", "pattern_index", "heuristic", "detail", "span_omitted")


def signal(stage: str, kind: Column | str, confidence: Column, **fields: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    given = {"stage": as_column(stage), "kind": as_column(kind), "confidence": confidence} | {k: as_column(v) for k, v in fields.items()}
    return F.struct(*[given.get(f, F.lit(None)).alias(f) for f in FIELDS]).cast(SIGNAL)


def with_fields(s: Column, **fields: Column) -> Column:
    return F.struct(*[fields.get(f, s[f]).alias(f) for f in FIELDS]).cast(SIGNAL)


def none() -> Column:
    return F.array().cast(f"array<{SIGNAL}>")


def present(*maybe: Column) -> Column:
    """Those signals that are not null."""
    return F.array_compact(F.array(*maybe)) if maybe else none()
