"""What is given back in place of a flagged prompt."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.base import f32, java, let, n_bytes, truncate_bytes
from grainmill.functions.levels import SecurityLevel

from .combine import type_name
from .scoring import risk_label

# The texts that responses and strategies put in.
WARNING_PREFIX = "[WARNING: Potential prompt injection detected] "
BLOCKED = "Request blocked due to security policy. Detected %d potential threat(s) with risk level: %s. Please revise your request and try again."
WARNED = "Security Warning: Potential prompt injection detected. Threat types: %s. Risk level: %s. Please be cautious with your request."
FILTERED = "[FILTERED]"
SOCIAL_PREFIX = "[SOCIAL_ENGINEERING_WARNING] "
ENCODED = (("<", "%3C"), (">", "%3E"), ('"', "%22"), ("'", "%27"), ("&", "%26"), ("{", "%7B"), ("}", "%7D"), ("[", "%5B"), ("]", "%5D"), ("\\", "%5C"))
DECODED = (("%20", " "), ("%22", '"'), ("%27", "'"), ("%3C", "&lt;"), ("%3E", "&gt;"))
URGENCY = ((r"\burgent(ly)?\b", "[TIME_SENSITIVE]"), (r"\bemergency\b", "[PRIORITY]"), (r"\bcritical\b", "[IMPORTANT]"), (r"\basap\b", "[SOON]"))
SOCIAL_MARKERS = ("trust me", "between you and me", "don't tell anyone", "keep this secret", "my boss said", "please help me")


@dataclass(frozen=True)
class Strategy:
    """remove, replace (a), encode, prefix (a), suffix (a), wrap (a, b) or custom (template a with {original})."""

    kind: str
    a: str = ""
    b: str = ""

    @property
    def preserves_content(self) -> bool:
        return self.kind in ("prefix", "suffix", "wrap", "encode")

    @property
    def removes_threat(self) -> bool:
        return self.kind in ("remove", "replace")

    def apply(self, text: Column) -> Column:
        if self.kind == "remove":
            return F.lit("")
        if self.kind == "replace":
            return F.lit(self.a)
        if self.kind == "encode":
            return encode_specials(text)
        if self.kind == "prefix":
            return F.concat(F.lit(self.a), text)
        if self.kind == "suffix":
            return F.concat(text, F.lit(self.a))
        if self.kind == "wrap":
            return F.concat(F.lit(self.a), text, F.lit(self.b))
        return F.replace(F.lit(self.a), F.lit("{original}"), text)


DEFAULTS = {
    "InstructionOverride": Strategy("replace", "[INSTRUCTION_FILTERED]"),
    "RolePlaying": Strategy("replace", "[ROLE_FILTERED]"),
    "ContextConfusion": Strategy("wrap", "[CONTEXT_START]", "[CONTEXT_END]"),
    "EncodingBypass": Strategy("encode"),
    "Jailbreak": Strategy("replace", "[JAILBREAK_ATTEMPT_FILTERED]"),
    "SocialEngineering": Strategy("prefix", SOCIAL_PREFIX),
    "DataExtraction": Strategy("replace", "[DATA_REQUEST_FILTERED]"),
    "SystemPromptLeak": Strategy("replace", "[SYSTEM_QUERY_FILTERED]"),
    "CodeInjection": Strategy("replace", "[CODE_FILTERED]"),
    "Custom": Strategy("replace", "[CUSTOM_THREAT_FILTERED]"),
}
#: The kinds that a selector knows from the start; all others get its default.
SELECTED = ("InstructionOverride", "RolePlaying", "ContextConfusion", "EncodingBypass", "Jailbreak", "SocialEngineering", "DataExtraction")


@dataclass(frozen=True)
class Selector:
    strategies: Mapping[str, Strategy] | None = None
    default: Strategy = Strategy("replace", FILTERED)

    def known(self) -> dict[str, Strategy]:
        return {k: DEFAULTS[k] for k in SELECTED} | dict(self.strategies or {})

    def of(self, kind: str) -> Strategy:
        return self.known().get(kind, self.default)

    def with_strategy(self, kind: str, strategy: Strategy) -> Selector:
        return Selector({**(self.strategies or {}), kind: strategy}, self.default)

    def _choose(self, kind: Column, made) -> Column:
        out = made(self.default)
        for k, s in self.known().items():
            out = F.when(kind == k, made(s)).otherwise(out)
        return out

    def apply(self, kind: Column, text: Column) -> Column:
        return self._choose(kind, lambda s: s.apply(text))

    def removes(self, kind: Column) -> Column:
        return self._choose(kind, lambda s: F.lit(s.removes_threat))

    def preserves(self, kind: Column) -> Column:
        return self._choose(kind, lambda s: F.lit(s.preserves_content))


def encode_specials(text: Column) -> Column:
    """Ten special characters percent-encoded."""
    out = text
    for a, b in ENCODED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def decode_common(text: Column) -> Column:
    out = text
    for a, b in DECODED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sanitize_encodings(text: Column) -> Column:
    tagged = F.regexp_replace(decode_common(text), r"\\u[0-9a-fA-F]{4}", "[UNICODE_FILTERED]")
    long = lambda t: t.rlike("[A-Za-z0-9+/]{50,}={0,2}") & (n_bytes(t) > 100)
    return let(tagged, lambda t: F.when(long(t), F.regexp_replace(t, "[A-Za-z0-9+/]{20,}={0,2}", "[BASE64_FILTERED]")).otherwise(t))


def soften_social(text: Column) -> Column:
    out = text
    for rx, tag in URGENCY:
        out = F.regexp_replace(out, java(rx), tag)

    def marked(t: Column) -> Column:
        hit = F.lit(False)
        for m in SOCIAL_MARKERS:
            hit = hit | F.lower(t).contains(m)
        return F.when(hit, F.concat(F.lit(SOCIAL_PREFIX), t)).otherwise(t)

    return let(out, marked)


def sanitize_general(text: Column, aggressive: bool) -> Column:
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"(?U)\s{3,}", " ")
    if aggressive:
        out = F.regexp_replace(out, "<[^>]*>", "")
    return F.regexp_replace(out, java("<script[^>]*>.*?</script>"), "[SCRIPT_REMOVED]")


def clean_up(text: Column, max_length: int) -> Column:
    """Trimmed, cut to the limit with a tag, without empty brackets."""
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")
    short = let(trimmed, lambda t: F.when(n_bytes(t) > max_length, F.concat(truncate_bytes(t, max_length), F.lit("[TRUNCATED]"))).otherwise(t))
    out = short
    for pair in ("[]", "()", "{}"):
        out = F.replace(out, F.lit(pair), F.lit(""))
    return out


def in_order(signals: Column) -> Column:
    """Signals with spans from the last start back, ties as they came; then those without, as they came."""
    numbered = F.transform(signals, lambda s, i: F.struct(F.when(s["span"].isNull(), 1).otherwise(0).alias("a"), F.coalesce(-s["span"]["start"], F.lit(0)).alias("b"), i.alias("i")))
    return F.transform(F.array_sort(numbered), lambda k: F.get(signals, k["i"]))


def apply_local(text: Column, s: Column, selector: Selector) -> Column:
    """The span's strategy, if the text still has the span's content at its bytes."""
    size = s["span"]["end"] - s["span"]["start"]
    data = text.cast("binary")
    here = F.substring(data, s["span"]["start"] + 1, size)
    fits = (size > 0) & (here == s["span"]["content"].cast("binary"))
    before = F.substring(data, F.lit(1), s["span"]["start"]).cast("string")
    after = F.substring(data, s["span"]["end"] + 1, n_bytes(text) - s["span"]["end"]).cast("string")
    return F.when(fits, F.concat(before, selector.apply(s["kind"], s["span"]["content"]), after)).otherwise(text)


def apply_global(text: Column, s: Column, selector: Selector) -> Column:
    """What a signal without a span does to the whole text; where its span was lost, the text does not survive it."""
    chosen = selector.apply(s["kind"], text)
    lost = F.when(selector.removes(s["kind"]), chosen).otherwise(F.lit(FILTERED))
    other = F.when(selector.preserves(s["kind"]) | (s["confidence"] > f32(0.9)), chosen).otherwise(text)
    return (
        F.when(s["span_omitted"].isNotNull(), lost)
        .when(s["kind"] == "EncodingBypass", sanitize_encodings(text))
        .when(s["kind"] == "SocialEngineering", soften_social(text))
        .when(s["kind"] == "ContextConfusion", chosen)
        .otherwise(other)
    )


def sanitize(text: Column, signals: Column, level: SecurityLevel = SecurityLevel(), max_length: int = 10_000, selector: Selector = Selector()) -> Column:
    """Local, then global strategies in order, then general cleaning."""
    folded = F.aggregate(in_order(signals), text, lambda t, s: F.when(s["span"].isNotNull(), apply_local(t, s, selector)).otherwise(apply_global(t, s, selector)))
    return clean_up(sanitize_general(folded, level.aggressive), max_length)


@dataclass(frozen=True)
class Response:
    """allow, block, sanitize, warn or custom (with its message)."""

    kind: str = "block"
    message: str = ""

    def would_mitigate(self, injection: Column) -> Column:
        return injection & F.lit(self.kind != "allow")


def respond(text: Column, signals: Column, risk: Column, response: Response, level: SecurityLevel, max_length: int, selector: Selector = Selector()) -> Column:
    if response.kind == "allow":
        return F.concat(F.lit(WARNING_PREFIX), text)
    if response.kind == "block":
        return F.format_string(BLOCKED, F.size(signals), risk_label(risk))
    if response.kind == "warn":
        shown = lambda s: F.when(s["kind"] == "Custom", F.concat(F.lit('Custom("'), s["custom_name"], F.lit('")'))).otherwise(type_name(s))
        names = F.array_join(F.array_sort(F.array_distinct(F.transform(signals, shown))), ", ")
        return F.format_string(WARNED, names, risk_label(risk))
    if response.kind == "custom":
        return F.lit(response.message)
    return sanitize(text, signals, level, max_length, selector)
