"""Single-precision literals, the dialect of patterns, and lengths."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space and letters of ASCII.
WHITE = "\t\n\x0b\f\r "
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
#: All white space, as patterns see it.
SPACES = r"[\x09\x0a\x0b\x0c\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Of a necessary string, so many characters are looked for.
LOOKED_FOR = 40


def f32(x: float | Column) -> Column:
    """A FLOAT literal: confidences are single precision, and thresholds are sensitive to that. A column of them stays as it is."""
    return x if isinstance(x, Column) else F.lit(float(np.float32(x))).cast("float")


def cap(c: Column, most: float = 1.0) -> Column:
    return F.least(c, f32(most))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def java(pattern: str, ignore_case: bool = True) -> str:
    """A pattern for Java's engine with Unicode classes, ``.`` stopping at line feeds only, and ``$`` at the very end."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append("\\z" if c == "$" and not in_class else c)
        i += 1
    return f"(?{'i' if ignore_case else ''}dU)" + "".join(out)


def lowered(pattern: str) -> str | None:
    """A case-sensitive pattern that decides on a lower-case ASCII text as ``pattern`` does, cases ignored, on the text; null where that is not plain to see."""
    if not pattern.isascii() or re.search(r"\\[^nrtswdbz.*+?()\[\]{}|/\\^$-]|\(\?[^:]|\[\^|[A-Z]-[^A-Z]|[^A-Z]-[A-Z]", pattern):
        return None
    low = pattern.lower()
    return java(low, ignore_case=False).replace("(?dU)", "(?d)", 1)


def leading_run(pattern: str) -> tuple[str, int] | None:
    """The class of characters, in either case, and the number of them, for a pattern that begins with at least so many of one class; a text has a match's run where one of its own begins."""
    run = re.match(r"\[((?:[a-z]-[a-z]|[0-9]-[0-9]|[a-z0-9+/=])+)\]\{(\d+),\}", pattern.lower())
    if not run or "|" in pattern:
        return None
    spans = [(p[0], p[-1]) for p in re.findall(r"\w-\w|.", run[1])]
    chars = {chr(i) for a, b in spans for i in range(ord(a), ord(b) + 1)}
    return each_of("".join(sorted(chars | {c.upper() for c in chars}))), int(run[2])


def folded(text: Column) -> Column:
    """The text as patterns that ignore case see it: every letter in the lower case of its upper case. (One after the other alone, the optimizer would drop the upper case.)"""
    low = F.translate(F.lower(F.translate(F.upper(text), "\u0130", "i")), "\u03c2", "\u03c3")
    return F.when(n_bytes(text) == F.length(text), F.lower(text)).otherwise(low)


def plainly_folded(text: Column) -> Column:
    """Whether only ASCII's letters fold to ASCII's letters in this text."""
    odd = [text.contains(c) for c in "\u017f\u212a\u0130\u0131"]
    return (n_bytes(text) == F.length(text)) | ~(odd[0] | odd[1] | odd[2] | odd[3])


def fold(string: str) -> str:
    """What ``folded`` makes of a constant."""
    return string.upper().replace("\u0130", "i").lower().replace("\u03c2", "\u03c3")


def fold_needed(needs: tuple[str, ...] | None, most: int = LOOKED_FOR) -> tuple[str, ...] | None:
    """Necessary strings as they are looked for in ``folded`` texts."""
    return needs and tuple(dict.fromkeys(fold(s)[:most] for s in needs))


def n_bytes(text: Column) -> Column:
    return F.octet_length(text)


def constant(values: list, kind: str) -> Column:
    """A constant array from one literal: the plan stays small, and building it quick, whatever the number of values."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return let(text, lambda t: F.exists(constant(list(words), "array<string>"), lambda w: t.contains(w)))


def count_contained(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur."""
    return let(text, lambda t: F.size(F.filter(constant(list(words), "array<string>"), lambda w: t.contains(w))))


def each_of(chars: str) -> str:
    """A class of characters below 256, each named: Java looks those up in one table, but tries ranges one after the other."""
    return "[" + "".join(f"\\x{ord(c):02x}" for c in chars) + "]"


def all_but(chars: str) -> str:
    """The class of the ASCII characters that are not among ``chars``."""
    return each_of("".join(chr(i) for i in range(128) if chr(i) not in chars))


def prefixes(strings: list[str]) -> str:
    """A pattern that tries all of the strings at a place at once, letter by letter, and takes the longest."""
    tree: dict = {}
    for s in strings:
        node = tree
        for c in s:
            node = node.setdefault(c, {})
        node[""] = {}

    def form(node: dict) -> str:
        below = sorted(c for c in node if c)
        if not below:
            return ""
        parts = [(f"{SPACES}+" if c == " " else re.escape(c)) + form(node[c]) for c in below]
        if len(parts) > 5:
            # in groups, so that a place is ruled out by few tests
            groups = [(below[i : i + 5], parts[i : i + 5]) for i in range(0, len(parts), 5)]
            parts = [f"(?={any_of(cs)})(?:{'|'.join(ps)})" for cs, ps in groups]
        elif len(parts) > 1:
            parts = [f"(?={any_of(below)})(?:{'|'.join(parts)})"]
        if "" in node:
            return "(?:" + "|".join(parts) + ")?"
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    any_of = lambda cs: "[" + "".join(SPACES if c == " " else re.escape(c) for c in cs) + "]"
    return "(?:" + form(tree) + ")"


def held(text: Column, strings: list[str]) -> Column:
    """Those of ``strings``, letters folded, that the text holds at some place where it holds no longer one: all others are prefixes of these. A space stands for any run of white space; none comes first."""

    def of(t: Column, flags: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(f"{flags}(?=({prefixes(strings)}))"), 1))
        return F.array_distinct(F.transform(found, lambda s: F.lower(F.regexp_replace(s, f"{SPACES}+", " "))))

    plain = plainly_folded(text) if all(s.isascii() for s in strings) else n_bytes(text) == F.length(text)
    found = F.when(plain, of(text, "(?i)")).otherwise(let(folded(text), lambda t: of(t, "")))
    return F.coalesce(found, F.array().cast("array<string>"))


def looked_up(found: Column, strings: list[str], values: list[list[int]]) -> Column:
    """The values of those of ``strings`` that are in ``found``, each once."""
    table, of = constant(strings, "array<string>"), constant(values, "array<array<int>>")
    return F.array_distinct(F.flatten(F.transform(found, lambda s: F.get(of, (F.array_position(table, s) - 1).cast("int")))))


def rules_by_string(needs: list[tuple[str, ...] | None]) -> tuple[list[str], list[list[int]]]:
    """The strings that ``held`` is to look for, and the places of the rules that each calls for: a text that holds a string holds its prefixes."""
    of: dict[str, set[int]] = {}
    for k, n in enumerate(needs):
        for s in n or ():
            of.setdefault(s, set()).add(k)
    strings = sorted(of)
    heads = lambda s: (of[s[:i]] for i in range(1, len(s) + 1) if s[:i] in of)
    return strings, [sorted(set().union(*heads(s))) for s in strings]


def weighted(text: Column, weights: tuple[tuple[str, float], ...]) -> Column:
    """Sum of the weights of the phrases that occur, in single precision and in order."""
    phrases, w = constant([p for p, _ in weights], "array<string>"), constant([repr(x) for _, x in weights], "array<string>").cast("array<float>")
    step = lambda a, i: (a + F.when(text.contains(F.get(phrases, i)), F.get(w, i)).otherwise(f32(0.0))).cast("float")
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(weights) - 1)), f32(0.0), step)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    n = ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")
    return F.when(text.contains(part), n).otherwise(F.when(text.isNotNull(), 0))


def count_left(text: Column, others: str) -> Column:
    """How many characters are left when runs of ``others`` go: quicker than a match for each of them."""
    return F.length(F.regexp_replace(text, others, ""))


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    plain = F.split(text, each_of(WHITE) + "+")
    return F.array_remove(F.when(n_bytes(text) == F.length(text), plain).otherwise(F.split(text, r"(?U)\s+")), "")


def truncate_bytes(text: Column, most: int) -> Column:
    """At most ``most`` bytes, back to a character's edge."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    # a replacement character that the text itself has at that place stays
    clean = F.when(text.startswith(cut), cut).otherwise(F.regexp_replace(cut, "\N{REPLACEMENT CHARACTER}+$", ""))
    return F.when(n_bytes(text) <= most, text).otherwise(clean)
