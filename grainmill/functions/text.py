"""Scalar helpers over text, and small ones over numbers and collections."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import f32, java, let, n_bytes, words
from .repeats import has_square

# The named patterns.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL = r"https?://(?:[-\w.])+(?:\:[0-9]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?"
IP_ADDRESS = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
BASE64 = r"^[A-Za-z0-9+/]*={0,2}$"
HEX = r"^[0-9a-fA-F]+$"
#: How many different characters are counted one after the other.
IN_TURN = 80
NAMED = {"email": EMAIL, "url": URL, "ip_address": IP_ADDRESS, "base64": BASE64, "hex": HEX}


def normalize(text: Column) -> Column:
    """Control characters dropped, white space collapsed, ends trimmed."""
    bare = F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ | $", "")


def distance(a: Column, b: Column) -> Column:
    """Edit distance in code points."""
    return F.levenshtein(a, b)


def similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1.0 - distance(a, b) / F.greatest(most, F.lit(1)))


def extract_words(text: Column, least: int) -> Column:
    bare = F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}]", "")))
    return F.filter(bare, lambda w: (n_bytes(w) >= least) & (w != "") if least == 0 else n_bytes(w) >= least)


def entropy(text: Column) -> Column:
    """Shannon bits a character, 0 for empty text. A character's count is what the text loses without it.

    Each character in turn is taken out of what the ones before it left, which soon is little;
    beyond ``IN_TURN`` different ones, the rest are looked up in a list.
    """

    def bits(n: Column) -> Column:
        def less(h: Column, size: Column, c: Column) -> Column:
            share = size / n_bytes(c) / n
            return h - share * F.log2(share)

        def more(h: Column, c: Column) -> Column:
            return less(h, n_bytes(text) - n_bytes(F.replace(text, c, F.lit(""))), c)

        def step(a: Column, _: Column) -> Column:
            def taken(x: Column) -> Column:
                return F.struct(less(a["h"], n_bytes(a["rest"]) - n_bytes(x["left"]), x["c"]).alias("h"), x["left"].alias("rest"))

            first = F.substring(a["rest"], 1, 1)
            return F.when(a["rest"] == "", a).otherwise(let(F.struct(first.alias("c"), F.replace(a["rest"], first, F.lit("")).alias("left")), taken))

        start = F.struct(F.lit(0.0).alias("h"), text.alias("rest"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(IN_TURN)), start, step, lambda a: F.when(a["rest"] == "", a["h"]).otherwise(F.aggregate(F.array_distinct(F.split(a["rest"], "")), a["h"], more)))

    return F.when(text == "", 0.0).otherwise(let(F.length(text), bits))


def has_repeat(text: Column, least: int) -> Column:
    """Whether a run of at least ``least`` characters is followed by itself; null for null. Python in Arrow batches: a regular expression would be quadratic."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else has_square(t, least))

    return found(text) if least > 0 else F.lit(False)


def is_base64(text: Column) -> Column:
    return (n_bytes(text) >= 4) & (n_bytes(text) % 4 == 0) & text.rlike(java(BASE64, False))


def is_hex(text: Column) -> Column:
    return (n_bytes(text) >= 8) & (n_bytes(text) % 2 == 0) & text.rlike(java(HEX, False))


def url_decode_latin(text: Column) -> Column:
    """``+`` to a space, ``%XX`` to that code point, bad escapes kept; a percent sign needs two characters after it."""
    parts = F.regexp_extract_all(text, F.lit("(?s)(%..|.)"), 1)

    def one(p: Column) -> Column:
        code = F.conv(F.substring(p, 2, 2), 16, 10).cast("int")
        return F.when(p == "+", " ").when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.decode(F.unhex(F.lpad(F.hex(code), 2, "0")), "ISO-8859-1")).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def detect_encodings(text: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(is_base64(text), "base64"), F.when(is_hex(text), "hex"), F.when(text.contains("%"), "url"), F.when(text.contains("\\u"), "unicode"), F.when(text.contains("&#"), "html_entity")
        )
    )


def valid_confidence(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)


def valid_length(text: Column, least: int, most: int) -> Column:
    return n_bytes(text).between(least, most)


def safe_characters(text: Column) -> Column:
    return ~text.rlike(r"[\p{Cc}&&[^\n\t]]")


def valid_email(text: Column) -> Column:
    return text.rlike(java(EMAIL, False))


def valid_url(text: Column) -> Column:
    return text.rlike(java(URL, False))


def format_duration(ms: Column) -> Column:
    """ms, s, m or h, with one decimal from a second on."""
    scaled = lambda by, unit: F.format_string(f"%.1f{unit}", F.round(ms / by, 1))
    return F.when(ms < 1000, F.format_string("%dms", ms)).when(ms < 60_000, scaled(1000.0, "s")).when(ms < 3_600_000, scaled(60_000.0, "m")).otherwise(scaled(3_600_000.0, "h"))


def severity_bucket(confidence: Column) -> Column:
    return F.when(confidence >= f32(0.9), "Critical").when(confidence >= f32(0.7), "High").when(confidence >= f32(0.5), "Medium").when(confidence >= f32(0.3), "Low").otherwise("Very Low")


def group_and_count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, key: str) -> DataFrame:
    """The commonest value; the smallest on ties."""
    n = group_and_count(df, key)
    return n.agg(F.min_by(key, F.struct((-F.col("n")).alias("n"), F.col(key).alias("k"))).alias(key), F.max("n").alias("n"))


def running_counts(df: DataFrame, value: str, ranges: int = 64) -> tuple[DataFrame, int]:
    """(value, upto) of each distinct value that is not null, upto the rows that are not above it; and how many rows there are.

    Values are counted, then summed up inside ranges of values, which are windows of their
    own; what lies below a range is a sum that the driver adds, one for each range.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    cuts = sorted(set(counted.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.001)))
    which = F.lit(0)
    for c in cuts:
        which = which + (F.col(value) > c).cast("int")
    placed = counted.withColumn("range", which)
    sums = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    below = [sum(n for k, n in sums.items() if k < j) for j in range(len(cuts) + 1)]
    upto = F.get(F.array(*[F.lit(b) for b in below]), F.col("range")) + F.sum("n").over(W.partitionBy("range").orderBy(value))
    return placed.select(value, upto.alias("upto")), sum(sums.values())


def at_places(df: DataFrame, value: str, places: Callable[[int], dict[str, int]], empty: Column) -> DataFrame:
    """One row: for each name the value at that place, from 0, in ascending order; ``empty`` without rows."""
    spread, n = running_counts(df, value)
    return spread.agg(*[F.coalesce(F.min(F.when(F.col("upto") > at, F.col(value))), empty).alias(k) for k, at in places(n).items()])


def rank_percentiles(df: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """One row, ``pNN`` each: the value at round(p / 100 * (n - 1)) in ascending order, halves up. No rows, nulls."""
    return at_places(df, value, lambda n: {f"p{p}": math.floor(p / 100.0 * (n - 1) + 0.5) for p in percents}, F.lit(None))
