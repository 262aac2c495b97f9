"""What several configurations need of a text, found once: the hits of all their rules, the checks, the kind of text. Levels, rules in force and scores are decided from that."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.base import constant, let, n_bytes
from grainmill.functions.levels import SecurityLevel
from grainmill.operators import combine, heuristics, keywords, preprocess, variants
from grainmill.operators.patterns import Matcher
from grainmill.operators.signals import none, present, with_fields

from .calibrate import ALL, LevelColumn
from .config import ConfigError, DetectorConfig, Keywords

#: The column of evidence; its metadata say what was looked for.
EVIDENCE = "_evidence"
#: Checks whose confidence is the level's, and the field of the rates that has it.
RATED = {"base64_like_enhanced": "base64", "hex_like_enhanced": "hex", "rot13_pattern": "rot13"}


def _way(c: DetectorConfig) -> list[bool]:
    return [c.preprocessing.normalize_unicode, c.preprocessing.decode_encodings]


def _asked(k: Keywords) -> list[float | int]:
    return [k.similarity_threshold, k.max_context_length]


def examine(df: DataFrame, configs: Sequence[DetectorConfig], text: str = "text") -> DataFrame:
    """``df`` with the evidence from which ``Detector.analyze``, by any of ``configs``, gives what it gives from the text, for far less.

    A text is scanned once, by the rules of all; where ways to preprocess it differ in their result,
    each result is. Texts that are null, empty or beyond all limits have none. Patterns must ignore case. Narrow.
    """
    configs = [c.validate() for c in configs]
    if any(c.patterns.case_sensitive for c in configs):
        raise ConfigError("patterns that heed case are not examined together")
    matchers = [c.matcher() for c in configs]
    custom: list[str] = []
    for m in matchers:
        custom += [p for p in dict.fromkeys(m.custom) for _ in range(m.custom.count(p) - custom.count(p))]
    matcher = Matcher(categories=tuple({c for m in matchers for c in m.names()} - {"custom"}), custom=tuple(custom), max_patterns=sum(len(m.rules) for m in matchers) or 1)
    ways = sorted(map(list, {tuple(_way(c)) for c in configs}))
    asked = sorted(map(list, {tuple(_asked(c.keywords)) for c in configs if c.keywords.enabled}))
    longest = max(c.preprocessing.max_length for c in configs)
    raw = F.col(text)

    def of(t: Column) -> Column:
        def hits(x: Column, i: Column) -> Column:
            return F.transform(matcher.located(x, matcher.codes(x)), lambda h: F.struct(h["code"].alias("code"), h["content"].alias("content"), h["start"].alias("start"), (i > 0).alias("decoded")))

        scanned = let(F.concat(F.array(t), variants.decoded_variants(t)), lambda ts: F.flatten(F.transform(ts, hits)))
        scanned = scanned if matcher.rules else F.array().cast("array<struct<code:int,content:string,start:int,decoded:boolean>>")
        said = F.array(*[keywords.keyword_signals(t, *k) for k in asked] or [none()])
        return let(F.struct(scanned.alias("hits"), present(*heuristics.checks(t, SecurityLevel()).values()).alias("checks"), said.alias("keywords")), lambda b: whole(t, b))

    def whole(t: Column, b: Column) -> Column:
        some = (F.size(b["hits"]) > 0) | (F.size(b["checks"]) > 0) | F.exists(b["keywords"], lambda k: F.size(k) > 0)
        rates = lambda v: F.struct(heuristics.base64_confidence(t, v).alias("base64"), heuristics.hex_confidence(t, v).alias("hex"), heuristics.rot13_confidence(t, v).alias("rot13"))
        return F.struct(
            b["hits"].alias("hits"), b["checks"].alias("checks"), b["keywords"].alias("keywords"), F.when(F.size(b["checks"]) > 0, heuristics.benign_score(t)).alias("benign"),
            F.when(F.exists(b["checks"], lambda s: s["heuristic"].isin(*RATED)), F.transform(constant(list(ALL), "array<int>"), lambda v: rates(LevelColumn(v)))).alias("rates"),
            F.when(some, preprocess.is_question(t)).alias("question"), F.when(some, preprocess.is_educational(t)).alias("educational"), F.when(some, combine.pressing(t)).alias("pressed"), n_bytes(t).alias("size"),
        )

    texts = F.array(*[preprocess.preprocess(raw, preprocess.Preprocessing(*w, longest)) for w in ways])
    each = lambda ts: let(F.array_distinct(ts), lambda ds: F.struct(F.transform(ts, lambda t: (F.array_position(ds, t) - 1).cast("int")).alias("places"), F.transform(ds, of).alias("found")))
    open_ = (raw != "") & (n_bytes(raw) <= longest)
    known = {"rules": matcher.keys(), "ways": ways, "keywords": asked, "longest": longest, "text": text}
    return df.withColumn(EVIDENCE, F.when(open_, let(texts, each)).alias(EVIDENCE, metadata={"known": json.dumps(known)}))


def signals_of(df: DataFrame, config: DetectorConfig, text: str) -> Column | None:
    """What ``Detector.signals`` gives for the preprocessed text, from the evidence in ``df``; null where there is none, and None where ``df`` holds none."""
    if EVIDENCE not in df.columns:
        return None
    known, matcher, asked = json.loads(df.schema[EVIDENCE].metadata.get("known", "{}")), config.matcher(), _asked(config.keywords)
    place = {k: i for i, k in enumerate(known.get("rules", ()))}
    lacking = known.get("text") != text or not set(matcher.keys()) <= set(place) or config.patterns.case_sensitive or config.preprocessing.max_length > known["longest"]
    if lacking or _way(config) not in known["ways"] or (config.keywords.enabled and asked not in known["keywords"]):
        raise ConfigError("the evidence was not gathered for this configuration")
    own = {place[k]: i for i, k in enumerate(matcher.keys())}
    codes = constant([own.get(i) for i in range(len(place))], "array<int>")

    def judged(e: Column) -> Column:
        hits = F.filter(F.transform(e["hits"], lambda h: F.struct(F.get(codes, h["code"]).alias("code"), h["content"].alias("content"), h["start"].alias("start"), h["decoded"].alias("decoded"))), lambda h: h["code"].isNotNull())
        rate = F.get(e["rates"], config.level.value)

        def rated(s: Column) -> Column:
            c = F.lit(None).cast("float")
            for name, field in RATED.items():
                c = F.when(s["heuristic"] == name, rate[field]).otherwise(c)
            return with_fields(s, confidence=F.coalesce(c, s["confidence"]))

        felt = let(F.transform(e["checks"], rated), lambda s: F.when(F.size(s) == 0, s).otherwise(heuristics.damp(s, e["benign"])))
        said = [F.get(e["keywords"], known["keywords"].index(asked))] if config.keywords.enabled else []
        every = let(hits, lambda hs: F.concat(matcher.rated(F.filter(hs, lambda h: ~h["decoded"])), felt, *said, variants.decoded_signals(matcher.rated(F.filter(hs, lambda h: h["decoded"])))))
        both = let(every, lambda s: F.concat(s, present(*combine.combined(s, e["pressed"], e["size"]).values())))
        return let(both, lambda s: combine.filter_by_context(s, e["question"], e["educational"]))

    found = F.col(EVIDENCE)
    return let(F.get(found["found"], F.get(found["places"], known["ways"].index(_way(config)))), judged)
