"""Signals from a text's statistics, structure, words and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions import codec
from grainmill.functions.base import DIGITS, LETTERS, WHITE, all_but, cap, contains_any, count_contained, count_left, each_of, f32, let, n_bytes, occurrences, weighted, words
from grainmill.functions.levels import SecurityLevel
from grainmill.functions.text import entropy

from .signals import present, signal, with_fields

# Marks and words that the checks look for, and weights of benign phrases.
FORMAT_MARKS = ("```", "###", "[INST]", "<|", "|>", "{{", "}}")
PLAIN_WORDS = ("the", "and", "you", "hello", "how", "are", "today")
DECODED_WORDS = ("ignore", "override", "disable", "bypass", "jailbreak")
ROTATED_WORDS = ("ignore", "override", "disable", "bypass", "jailbreak", "dan", "system")
ZERO_WIDTH = "[​‌‍﻿⁠]"
DELIMITERS = r"(?U)[\s:;,\"'()\[\]{}]"
BENIGN = (
    ("how do i", 0.8), ("can you help", 0.7), ("please explain", 0.8), ("what is", 0.6), ("why does", 0.6), ("could you tell", 0.7), ("would you mind", 0.8),
    ("learn about", 0.7), ("understand", 0.5), ("research", 0.5), ("study", 0.4), ("mathematics", 0.8), ("science", 0.6), ("programming", 0.7), ("algorithm", 0.6),
    ("thank you", 0.8), ("please", 0.4), ("appreciate", 0.6), ("grateful", 0.7),
    ("write a story", 0.8), ("create a poem", 0.8), ("help me write", 0.7), ("generate a", 0.6),
    ("information about", 0.7), ("details on", 0.6), ("facts about", 0.7), ("summarize", 0.6),
)


def marks(text: Column) -> Column:
    """What is left without ASCII's letters, digits and white space: little, and all that is counted of other characters."""
    return F.regexp_replace(text, each_of(LETTERS + DIGITS + WHITE) + "+", "")


def special_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise(count_left(marks(text), r"(?U)[\p{IsAlphabetic}\p{N}\s]+") / F.greatest(n, F.lit(1)))


def repetition_score(text: Column, least: float = 0.0) -> Column:
    """The commonest word's share of all words, if above 0.3, else 0; a share of at most ``least`` may be given as 0."""
    def score(ws: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

        def step(a: Column, w: Column) -> Column:  # over sorted words
            run = F.when(a["last"].eqNullSafe(w), a["run"] + 1).otherwise(1)
            return F.struct(w.alias("last"), run.alias("run"), F.greatest(a["top"], run).alias("top"))

        def ratio(low: Column) -> Column:
            top = F.aggregate(F.array_sort(low), start, step, lambda a: a["top"])
            return let(top / F.greatest(F.size(low), F.lit(1)), lambda r: F.when(r > 0.3, r).otherwise(0.0))

        def some(low: Column) -> Column:
            # more different words than that, and none of them is that frequent
            return F.when(F.size(F.array_distinct(low)) - 1 >= F.size(low) * (1 - least), 0.0).otherwise(ratio(low))

        low = F.filter(F.transform(ws, F.lower), lambda w: w.isNotNull())
        return F.when(F.size(ws) < 3, 0.0).otherwise(let(low, some if least else ratio))

    return F.when(n_bytes(text) < 10, 0.0).otherwise(let(words(text), score))


def punctuation_score(text: Column) -> Column:
    lined = text.contains("!!") | text.contains("??") | text.contains("...")

    def score(m: Column) -> Column:
        ratio = count_left(m, r"[^!-/:-@\[-`{-~]+") / F.greatest(F.length(text), F.lit(1))
        more = F.when(occurrences(m, "!") > 3, 0.2).otherwise(0.0)
        asked = F.when(occurrences(m, "?") > 3, 0.2).otherwise(0.0)
        return ratio + more + asked + F.when(lined, 0.3).otherwise(0.0)

    return F.when(text == "", 0.0).otherwise(let(marks(text), score))


def one_character(text: Column) -> Column:
    """At least three bytes, all characters the same."""
    return (n_bytes(text) >= 3) & text.rlike(r"(?s)^(.)\1*\z")


def suspicious_format(text: Column) -> Column:
    return count_contained(text, FORMAT_MARKS) >= 2


def word_pattern_score(text: Column, both: bool = False) -> Column:
    """0.3 for odd word lengths and 0.4 for capitals that come and go, added in single precision; with ``both``, one alone may be given as 0."""

    def score(ws: Column) -> Column:
        average = n_bytes(F.array_join(ws, "")) / F.greatest(F.size(ws), F.lit(1))
        caps = lambda w: w.rlike(r"\p{Lu}")
        flips = F.exists(
            F.sequence(F.lit(1), F.greatest(F.size(ws) - 1, F.lit(1))),
            lambda i: (caps(F.get(ws, i)) != caps(F.get(ws, i - 1))) & (n_bytes(F.get(ws, i)) > 1),
        )
        total = lambda odd: F.least((odd + F.when(flips, f32(0.4)).otherwise(f32(0.0))).cast("double"), F.lit(1.0))
        alone = F.lit(0.0) if both else total(f32(0.0))
        return F.when(F.size(ws) < 5, 0.0).otherwise(let(average, lambda a: F.when((a < 2.0) | (a > 10.0), total(f32(0.3))).otherwise(alone)))

    return let(words(text), score)


def caps_ratio(text: Column) -> Column:
    def share(t: Column) -> Column:
        letters = F.when(n_bytes(t) == F.length(t), F.length(t)).otherwise(count_left(t, r"\P{IsAlphabetic}+"))
        upper = count_left(F.regexp_replace(t, each_of(LETTERS[:26]) + "+", ""), r"\P{IsUppercase}+")
        return let(letters, lambda n: F.when(n == 0, 0.0).otherwise(upper / F.greatest(n, F.lit(1))))

    # without ASCII's other characters
    return let(F.regexp_replace(text, all_but(LETTERS) + "+", ""), share)


def base64_shape(t: Column) -> Column:
    n = n_bytes(t)
    pad = n - n_bytes(F.regexp_replace(t, r"=+\z", ""))
    signs = (
        (t.rlike("[a-z]") & t.rlike("[A-Z]")).cast("int") + t.rlike("[0-9]").cast("int") + (t.contains("+") | t.contains("/")).cast("int") + t.contains("=").cast("int") + (n > 20).cast("int")
    )
    return (n >= 8) & t.rlike(r"^[A-Za-z0-9+/=_-]+\z") & (pad <= 2) & ((n % 4 == 0) | ((pad > 0) & ((n + pad) % 4 == 0))) & (signs >= 2)


def hex_shape(t: Column) -> Column:
    bare = F.regexp_replace(t, "^0[xX]", "")
    n = n_bytes(bare)
    return (n > 20) & (n % 2 == 0) & bare.rlike(r"^[0-9a-fA-F]+\z") & (F.size(F.array_distinct(F.split(bare, ""))) > 3)


def has_base64(text: Column) -> Column:
    c, plain = each_of(LETTERS + DIGITS + "+/=_-"), each_of(LETTERS + "_-")
    # two signs take a digit, a mark or more than twenty characters
    likely = text.rlike(f"(?<!{c})(?={c}{{8}})(?:{c}{{21}}|{plain}*+{each_of(DIGITS + '+/=')})")
    return F.when(likely, F.exists(F.split(text, DELIMITERS), base64_shape)).otherwise(likely)


def has_hex(text: Column) -> Column:
    likely = text.rlike(each_of(DIGITS + "abcdefABCDEF") + "{21}")
    return F.when(likely, F.exists(F.split(text, DELIMITERS), hex_shape)).otherwise(likely)


def looks_rot13(text: Column) -> Column:
    # no letter beyond ASCII has one of these in lower case
    letters, frequent = count_left(text, "[^A-Za-z]+"), count_left(text, "[^noretNORET]+")
    plain = text.rlike("(?i)" + "|".join(PLAIN_WORDS))
    return (n_bytes(text) >= 30) & ~plain & (letters >= F.floor(F.length(text) * 3 / 4)) & (frequent > F.floor(n_bytes(text) / 6))


def percent_ratio(text: Column) -> Column:
    return F.when(text == "", 0.0).otherwise(occurrences(text, "%") / F.greatest(n_bytes(text), F.lit(1)))


def unicode_marks(text: Column) -> Column:
    return occurrences(text, "\\u") + occurrences(text, "&#")


def zero_width_count(text: Column) -> Column:
    return F.when(n_bytes(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit(ZERO_WIDTH)))


def multi_layer(text: Column) -> Column:
    inner = codec.utf8(codec.base64_bytes(text))
    nested = (n_bytes(text) > 20) & base64_shape(text) & F.coalesce(percent_ratio(inner) > 0.1, F.lit(False))
    wrapped = (percent_ratio(text) > 0.1) & base64_shape(codec.percent_decode(text))
    marks = (
        (occurrences(text, "%") > 5).cast("int") + (occurrences(text, "\\u") > 3).cast("int") + (occurrences(text, "&#") > 3).cast("int") + base64_shape(text).cast("int") + hex_shape(text).cast("int")
    )
    # any of them takes an escape, or a text that is one word of those characters
    likely = text.contains("%") | text.contains("\\u") | text.contains("&#") | text.rlike(r"^[A-Za-z0-9+/=_-]+\z")
    return F.when(likely, nested | wrapped | (marks >= 2)).otherwise(likely)


def _decoder_confidence(data: Column, level: SecurityLevel) -> Column:
    """Base of the level, raised where the whole text decodes, to UTF-8, to a suspicious word."""
    base, bonus = f32(level.decoder_base()), f32(level.decoder_bonus)

    def raised(d: Column) -> Column:
        s = codec.utf8(d)
        word = contains_any(F.lower(s), DECODED_WORDS)
        one = base + f32(0.1) * bonus
        two = one + f32(0.05) * bonus
        return cap(F.when(d.isNull(), base).when(s.isNull(), one).when(word, two + f32(0.2) * bonus).otherwise(two))

    return let(data, raised)


def base64_confidence(text: Column, level: SecurityLevel) -> Column:
    return _decoder_confidence(codec.base64_bytes(text), level)


def hex_confidence(text: Column, level: SecurityLevel) -> Column:
    return _decoder_confidence(codec.hex_bytes(F.regexp_replace(text, "^0[xX]", "")), level)


def rot13_confidence(text: Column, level: SecurityLevel) -> Column:
    base, bonus = f32(level.decoder_base(rot13=True)), f32(level.decoder_bonus)
    n = count_contained(F.lower(codec.rot13(text)), ROTATED_WORDS)
    return cap(F.when(n > 0, base + (f32(0.2) + n.cast("float") * f32(0.05)) * bonus).otherwise(base))


def benign_score(text: Column) -> Column:
    score = let(F.lower(text), lambda low: weighted(low, BENIGN))
    score = score + F.when(text.endswith("?"), f32(0.5)).otherwise(f32(0.0))
    score = score + F.when(F.size(words(text)) > 5, f32(0.2)).otherwise(f32(0.0))
    return cap(score + F.when(text.rlike("[.!?]"), f32(0.3)).otherwise(f32(0.0)), 2.0)


def damp(signals: Column, score: Column) -> Column:
    """Signals weakened by benign content; those at or under 0.15 go."""

    def one(s: Column) -> Column:
        keep = F.when(s["kind"] == "SocialEngineering", f32(0.3)).when(s["kind"] == "ContextConfusion", f32(0.5)).when(s["kind"] == "EncodingBypass", f32(0.7)).otherwise(f32(0.8))
        factor = cap(score / f32(2.0)).cast("float")
        return with_fields(s, confidence=s["confidence"] * (f32(1.0) - factor * (f32(1.0) - keep)))

    weaker = F.filter(F.transform(signals, one), lambda s: s["confidence"] > f32(0.15))
    return F.when(score < f32(0.5), signals).otherwise(weaker)


def checks(text: Column, level: SecurityLevel) -> dict[str, Column]:
    """Each check's signal, null where it does not fire."""
    size = n_bytes(text)

    def scaled(ratio: Column) -> Column:
        c = F.least(ratio * 2.0, F.lit(1.0)).cast("float")
        return F.when(one_character(text), F.least(c * f32(0.6), f32(0.8))).otherwise(c)

    def plain(ratio: Column) -> Column:
        c = cap(ratio.cast("float"))
        return F.when(one_character(text), F.least(c * f32(0.6), f32(0.8))).otherwise(c)

    made = lambda name, kind, c: signal("heuristic", kind, c, heuristic=name)
    when = lambda value, test, name, kind, conf: let(value, lambda v: F.when(test(v), made(name, kind, conf(v))))
    return {
        "h_entropy": when(entropy(text), lambda v: (v > 4.5) & (size > 20), "high_entropy", "EncodingBypass", lambda v: F.least((v - 4.5) / 2.0, F.lit(1.0)).cast("float")),
        "h_special": when(special_ratio(text), lambda v: (v > 0.3) & (size > 5), "unusual_chars", "EncodingBypass", scaled),
        "h_repeat": when(repetition_score(text, 0.7), lambda v: v > 0.7, "excessive_repetition", "ContextConfusion", lambda v: cap(v.cast("float"))),
        "h_punct": when(punctuation_score(text), lambda v: (v > 0.6) & (size > 5), "punctuation_anomaly", "ContextConfusion", plain),
        "h_format": F.when(suspicious_format(text), made("suspicious_formatting", "ContextConfusion", f32(0.7))),
        "h_words": when(word_pattern_score(text, True), lambda v: v > F.lit(0.7).cast("double"), "unusual_word_patterns", "ContextConfusion", lambda v: v.cast("float")),
        "h_caps": when(caps_ratio(text), lambda v: (v > 0.5) & (size > 20), "excessive_caps", "SocialEngineering", lambda v: (v - F.lit(0.3).cast("double")).cast("float")),
        "h_b64": F.when(has_base64(text), made("base64_like_enhanced", "EncodingBypass", base64_confidence(text, level))),
        "h_hex": F.when(has_hex(text), made("hex_like_enhanced", "EncodingBypass", hex_confidence(text, level))),
        "h_rot13": F.when(looks_rot13(text), made("rot13_pattern", "EncodingBypass", rot13_confidence(text, level))),
        "h_url": when(percent_ratio(text), lambda v: (v > 0.15) & (size > 5), "url_encoding", "EncodingBypass", scaled),
        "h_unicode": when(unicode_marks(text), lambda v: v > 2, "unicode_encoding", "EncodingBypass", lambda v: cap((v.cast("float") / f32(10.0)).cast("float"))),
        "h_zw": when(zero_width_count(text), lambda v: v > 0, "zero_width_chars", "EncodingBypass", lambda v: F.least(F.greatest((v.cast("float") / f32(10.0)).cast("float"), f32(0.6)), f32(0.9))),
        "h_multi": F.when(multi_layer(text), made("multi_layer_encoding", "EncodingBypass", f32(0.85))),
    }


def heuristic_signals(text: Column, level: SecurityLevel) -> Column:
    found = present(*checks(text, level).values())
    return let(found, lambda s: F.when(F.size(s) == 0, s).otherwise(let(benign_score(text), lambda b: damp(s, b))))
