"""The dictionary scan: which rules match, where first, and how sure that is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.base import cap, constant, contains_any, count_contained, f32, fold_needed, held, java, leading_run, let, looked_up, lowered, n_bytes, occurrences, plainly_folded, rules_by_string
from grainmill.functions.levels import CATEGORIES, SecurityLevel
from grainmill.functions.phrases import RULES, needed

from .signals import SIGNAL, signal

# Words that raise a match's confidence.
RISKY_PAIRS = (
    ("ignore", "instructions"), ("disable", "safety"), ("bypass", "security"), ("override", "system"), ("jailbreak", "mode"),
    ("developer", "mode"), ("reveal", "system"), ("DAN", "mode"), ("AIM", "activated"),
)
URGENT = ("urgent", "emergency", "immediately", "asap", "critical", "lives")
SUSPICIOUS = ("ignore", "override", "bypass", "disable", "jailbreak", "system", "admin", "developer", "urgent", "emergency", "decode", "reveal")
CUSTOM_BASE, OTHER_BASE = 0.7, 0.5


@dataclass(frozen=True)
class Matcher:
    """The rules in force: categories by level or by name, and the caller's own patterns."""

    level: SecurityLevel = SecurityLevel()
    categories: tuple[str, ...] | None = None
    custom: tuple[str, ...] = ()
    case_sensitive: bool = False
    max_patterns: int = 3000
    rules: tuple[tuple[str, int, str], ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        names = self.level.categories if self.categories is None else self.categories
        found = [(c, i, java(r, not self.case_sensitive)) for c in sorted(set(names)) for i, r in enumerate(RULES.get(c, ()))]
        found += [("custom", i, java(p, not self.case_sensitive)) for i, p in enumerate(self.custom)]
        if not self.max_patterns:
            raise ValueError("max_patterns must be above 0")
        if len(found) > self.max_patterns:
            raise ValueError(f"{len(found)} patterns exceed the limit of {self.max_patterns}")
        object.__setattr__(self, "rules", tuple(found))

    def names(self) -> list[str]:
        return list(dict.fromkeys(c for c, _, _ in self.rules))

    def validate(self, spark) -> None:
        """Compile the caller's patterns with the engine that will run them."""
        for p in self.custom:
            try:
                spark._jvm.java.util.regex.Pattern.compile(java(p, not self.case_sensitive))
            except Exception as e:
                raise ValueError(f"pattern does not compile: {p}") from e

    def codes(self, text: Column) -> Column:
        """Places in ``rules`` of those that match, ascending.

        A rule's pattern is tried only where the text has one of the strings without which
        it cannot match; those strings are looked for in one pass over a text, all at once, letters folded as
        widely as the patterns fold them. In ASCII texts a lower-case pattern is tried on the
        lower-case text, which decides the same as folding cases by Unicode's rules and
        costs far less. The tables are constants that the optimizer folds, so the plan
        stays small, whatever the number of rules.
        """
        if not self.rules:
            return F.array().cast("array<int>")
        needs = [fold_needed(n) for n in (needed(r, True) for r in self.raw())]
        strings, rules_of = rules_by_string(needs)

        def chosen(t: Column) -> Column:
            tried = [looked_up(held(t, strings), strings, rules_of)] if strings else []
            # rules without such a string; those that begin with a run take one
            always = [k for k, n in enumerate(needs) if n is None]
            runs = [k for k in always if not self.case_sensitive and leading_run(self.raw()[k])]
            if runs:
                c, least = min((leading_run(self.raw()[k]) for k in runs), key=lambda x: x[1])
                same = [k for k in runs if leading_run(self.raw()[k])[0] == c]
                always = [k for k in always if k not in same]
                tried.append(F.when(~plainly_folded(t) | t.rlike(f"(?<!{c}){c}{{{least}}}"), constant(same, "array<int>")).otherwise(F.array().cast("array<int>")))
            return F.concat(constant(always, "array<int>"), *tried)

        tried = chosen(text)
        rx = constant([r[2] for r in self.rules], "array<string>")
        matching = lambda ks: F.filter(ks, lambda k: F.rlike(text, F.get(rx, k)))
        if not self.case_sensitive:
            plain = constant([lowered(raw) or r[2] for raw, r in zip(self.raw(), self.rules)], "array<string>")
            by_unicode, quick = matching, lambda ks: let(F.lower(text), lambda low: F.filter(ks, lambda k: F.rlike(low, F.get(plain, k))))
            matching = lambda ks: F.when(F.size(ks) == 0, ks).when(n_bytes(text) == F.length(text), quick(ks)).otherwise(by_unicode(ks))
        return F.array_sort(let(tried, matching))

    def raw(self) -> list[str]:
        """The rules' patterns as they were before they were put in Java's dialect."""
        return [self.custom[i] if c == "custom" else RULES[c][i] for c, i, _ in self.rules]

    def signals(self, text: Column, codes: Column) -> Column:
        """A signal for the first match of each rule in ``codes``."""
        return self.rated(self.located(text, codes))

    def located(self, text: Column, codes: Column) -> Column:
        """(code, content, start) of the first match of each rule in ``codes``."""
        rx = constant([r[2] for r in self.rules], "array<string>")
        first = lambda code, r: F.struct(code.alias("code"), F.regexp_substr(text, r).alias("content"), n_bytes(F.get(F.split(text, r, 2), 0)).alias("start"))
        return F.transform(codes, lambda code: let(F.get(rx, code), lambda r: first(code, r)))

    def rated(self, found: Column) -> Column:
        """A signal for each of the matches that ``located`` gives."""
        if not self.rules:
            return F.array().cast(f"array<{SIGNAL}>")
        tables = {
            "category": constant([c for c, _, _ in self.rules], "array<string>"), "i": constant([i for _, i, _ in self.rules], "array<int>"),
            "kind": constant([self.kind(c) for c, _, _ in self.rules], "array<string>"), "base": constant([repr(self.base(c)) for c, _, _ in self.rules], "array<string>").cast("array<float>"),
        }

        def one(m: Column) -> Column:
            def made(r: Column) -> Column:
                content = m["content"]
                span = F.struct(m["start"].cast("int").alias("start"), (m["start"] + n_bytes(content)).cast("int").alias("end"), content.alias("content"))
                custom = F.when(r["category"] == "custom", F.lit("Custom Pattern"))
                return signal("pattern", r["kind"], confidence(r["category"], r["base"], content), custom_name=custom, span=span, category=r["category"], pattern_index=r["i"])

            return let(F.struct(*[F.get(t, m["code"]).alias(name) for name, t in tables.items()]), made)

        return F.transform(found, one)

    def keys(self) -> list[str]:
        """What tells each rule from all others of any matcher; a pattern that the caller gives twice is two rules."""
        own = lambda k, p: f"custom {self.custom[:k].count(p)} {p}"
        return [own(i, self.custom[i]) if c == "custom" else f"{c} {i}" for c, i, _ in self.rules]

    def kind(self, category: str) -> str:
        return CATEGORIES[category][0] if category in CATEGORIES else "Custom"

    def base(self, category: str) -> float:
        if category == "custom":
            return CUSTOM_BASE
        known = CATEGORIES.get(category)
        return OTHER_BASE if known is None else self.level.encoding_base if known[1] is None else known[1]


def confidence(category: Column, base: Column, content: Column) -> Column:
    """The base raised or lowered by length, word pairs, urgency, claims of authority, encoding marks and piled-up words; each step capped at 1."""
    low = F.lower(content)
    size = n_bytes(content)
    by_length = lambda c: F.when(size > 50, cap(c * f32(1.15))).when(size > 20, cap(c * f32(1.1))).when(size < 5, F.greatest(c * f32(0.8), f32(0.1))).otherwise(c)

    def paired(c: Column) -> Column:
        pair = F.exists(constant([list(p) for p in RISKY_PAIRS], "array<array<string>>"), lambda p: low.contains(F.get(p, 0)) & low.contains(F.get(p, 1)))
        return F.when(pair, cap(c * f32(1.25))).otherwise(c)

    def urgent(c: Column) -> Column:
        asks = low.contains("?") | low.startswith("how ") | low.startswith("what ") | low.contains("can you help") | low.contains("please help")
        hit = category.contains("social_engineering") & contains_any(low, URGENT)
        return F.when(hit & asks, cap(c * f32(0.8))).when(hit, cap(c * f32(1.15))).otherwise(c)

    def claimed(c: Column) -> Column:
        return F.when(low.contains("i am your") | low.contains("this is your"), cap(c * f32(1.3))).otherwise(c)

    def encoded(c: Column) -> Column:
        strong = (occurrences(content, "=") > 1) | (occurrences(content, "%") > 5) | (occurrences(content, "\\u") > 3)
        return F.when(category.contains("encoding") & strong, cap(c * f32(1.2))).otherwise(c)

    def piled(c: Column) -> Column:
        return F.when(count_contained(low, SUSPICIOUS) >= 3, cap(c * f32(1.15))).otherwise(c)

    out = base
    for step in (by_length, paired, urgent, claimed, encoded, piled):
        out = let(out, step)
    return F.greatest(out, f32(0.1))
