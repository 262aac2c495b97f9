"""Every security level over the same prompts for little more than one: the dictionary and the checks run once, confidences and scores follow a level."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.base import cap, constant, f32, let
from grainmill.functions.levels import CATEGORIES, SecurityLevel
from grainmill.operators import combine, heuristics, keywords, preprocess, scoring, variants
from grainmill.operators.patterns import Matcher, confidence
from grainmill.operators.signals import none, present, signal, with_fields

from .config import DetectorConfig

ALL = range(11)


@dataclass(frozen=True)
class LevelColumn:
    """What SecurityLevel gives, for the level in a column: constants by level, looked up a row."""

    value: Column

    def __getattr__(self, name: str):
        each = [getattr(SecurityLevel(v), name) for v in ALL]
        if callable(each[0]):
            return lambda *a, **b: self._pick([x(*a, **b) for x in each])
        return tuple(map(self._pick, zip(*each))) if isinstance(each[0], tuple) else self._pick(each)

    def _pick(self, values: Sequence[float | int]) -> Column:
        if isinstance(values[0], float):
            table = constant([repr(float(np.float32(x))) for x in values], "array<string>").cast("array<float>")
        else:
            table = constant(list(values), "array<int>")
        return F.get(table, self.value)


def _hits(matcher: Matcher, texts: Column) -> Column:
    """(code, content, decoded) of the rules that match the text and its other readings, in that order."""

    def of(t: Column, i: Column) -> Column:
        rx = constant([r[2] for r in matcher.rules], "array<string>")
        return F.transform(matcher.codes(t), lambda k: F.struct(k.alias("code"), F.regexp_substr(t, F.get(rx, k)).alias("content"), (i > 0).alias("decoded")))

    return F.flatten(F.transform(texts, of))


def calibrate(df: DataFrame, config: DetectorConfig = DetectorConfig(), text: str = "text", levels: Sequence[int] = ALL) -> DataFrame:
    """``df`` with a row for each level: level, error, score, confidence, risk_level and injection_detected, as an analysis at that level gives them.

    All but the level is taken from ``config``. A null text and one beyond the length limit
    have an error at every level, and no figures; an empty text is safe at every level. Columns of these
    names are replaced. Narrow: no row meets another, so it runs on streams too.
    """
    cfg = replace(config.validate(), security_level=SecurityLevel(10), severity_level=None)
    matcher, named = cfg.matcher(), cfg.patterns.categories is not None
    made = ("level", "error", "score", "confidence", "risk_level", "injection_detected")
    keep = [c for c in df.columns if c not in made]
    raw = F.col(text)
    error = F.when(raw.isNull(), "null_prompt").when(preprocess.too_long(raw, cfg.preprocessing), "prompt_too_long")
    a = df.select(*keep, error.alias("error"))
    a = a.withColumn("_t", F.when(F.col("error").isNull() & (raw != ""), preprocess.preprocess(raw, cfg.preprocessing)))
    t = F.col("_t")
    kw = keywords.keyword_signals(t, cfg.keywords.similarity_threshold, cfg.keywords.max_context_length) if cfg.keywords.enabled else none()
    once = F.struct(
        (let(F.concat(F.array(t), variants.decoded_variants(t)), lambda ts: _hits(matcher, ts)) if matcher.rules else F.array().cast("array<struct<code:int,content:string,decoded:boolean>>")).alias("hits"),
        present(*heuristics.checks(t, cfg.level).values()).alias("checks"), heuristics.benign_score(t).alias("benign"), kw.alias("keywords"),
        preprocess.is_question(t).alias("q"), preprocess.is_educational(t).alias("e"),
    )
    a = a.withColumn("_once", F.when(t.isNotNull(), once)).withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    level = LevelColumn(F.col("level"))
    known = lambda values, kind: constant(values, f"array<{kind}>")
    first = known([0 if named or c == "custom" or c not in CATEGORIES else CATEGORIES[c][2] for c, _, _ in matcher.rules], "int")
    names, places, kinds = known([c for c, _, _ in matcher.rules], "string"), known([i for _, i, _ in matcher.rules], "int"), known([matcher.kind(c) for c, _, _ in matcher.rules], "string")
    by_level = [c in CATEGORIES and CATEGORIES[c][1] is None for c, _, _ in matcher.rules]
    bases = known([None if b else repr(matcher.base(c)) for (c, _, _), b in zip(matcher.rules, by_level)], "string").cast("array<float>")

    def scanned(decoded: bool) -> Column:
        def one(h: Column) -> Column:
            k, category = h["code"], F.get(names, h["code"])
            c = confidence(category, F.coalesce(F.get(bases, k), level.encoding_base), h["content"])
            return signal(
                "variant" if decoded else "pattern", F.get(kinds, k), cap(c * f32(1.05)) if decoded else c, custom_name=F.when(category == "custom", F.lit("Custom Pattern")), category=category, pattern_index=F.get(places, k)
            )

        return F.transform(F.filter("_once.hits", lambda h: (h["decoded"] == decoded) & (F.get(first, h["code"]) <= F.col("level"))), one)

    def rated(s: Column) -> Column:
        """The decoding checks' confidences are the level's."""
        name = s["heuristic"]
        c = F.when(name == "base64_like_enhanced", heuristics.base64_confidence(t, level)).when(name == "hex_like_enhanced", heuristics.hex_confidence(t, level)).when(name == "rot13_pattern", heuristics.rot13_confidence(t, level))
        return with_fields(s, confidence=F.coalesce(c, s["confidence"]))

    felt = heuristics.damp(F.transform("_once.checks", rated), F.col("_once.benign"))
    every = F.concat(scanned(False), felt, F.col("_once.keywords"), scanned(True))
    combined = let(every, lambda s: F.concat(s, combine.combination_signals(s, t)))
    signals = F.when(F.col("_once").isNull(), none()).otherwise(combine.filter_by_context(combined, F.col("_once.q"), F.col("_once.e")))
    ok = F.col("error").isNull()
    a = a.withColumn("_a", F.when(ok, let(signals, lambda s: scoring.assess(s, level))))
    return a.select(*keep, "level", "error", F.col("_a.score").alias("score"), F.col("_a.confidence").alias("confidence"), F.col("_a.risk_level").alias("risk_level"), scoring.is_injection(F.col("_a.risk_level")).alias("injection_detected"))
