"""The same queries in DuckDB's SQL, written from the same rules and phrases."""

from __future__ import annotations

from grainmill.functions.levels import CATEGORIES, RISKS, SEVERITY, SecurityLevel
from grainmill.functions.phrases import RULES
from grainmill.functions.text import NAMED
from grainmill.operators import combine, heuristics, keywords, mitigate, patterns, preprocess
from grainmill.sources.prompts import PHRASES

#: The kinds and categories of the fixed signals, in order.
KINDS = ("InstructionOverride", "RolePlaying", "ContextConfusion", "EncodingBypass", "Jailbreak", "SocialEngineering", "DataExtraction", "CodeInjection")
SIGNAL_CATEGORIES = ("instruction_override", "role_playing", "context_confusion", "encoding_bypass", "jailbreak", "urgency_manipulation_advanced", "data_extraction", "custom")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def count_of(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, {q(w)})::INT" for w in words) + ")"


def times(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, {q(part)}, ''))) // {len(part)})"


def f(x: float) -> str:
    return f"CAST({x!r} AS FLOAT)"


WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
PROMPTS = (
    "phrases(i, phrase) AS (VALUES " + ", ".join(f"({i}, {q(p)})" for i, p in enumerate(PHRASES)) + "), prompts AS (SELECT doc_id AS prompt_id, text, source FROM documents "
    "UNION ALL SELECT -1 - i, phrase, 'phrases' FROM phrases "
    f"UNION ALL SELECT -1001 - a.i, a.phrase || ' ' || b.phrase, 'phrases' FROM phrases a JOIN phrases b ON b.i = (a.i * 7 + 3) % {len(PHRASES)})"
)
SIGNALS = (
    "signals AS (SELECT prompt_id, text, list_filter([" + ", ".join(
        f"{{'kind': {q(k)}, 'category': {q(c)}, 'confidence': (CAST((abs(prompt_id) * 7 + {i * 13}) % 100 AS FLOAT) / {f(100.0)})::FLOAT, 'b': (abs(prompt_id) // {2**i}) % 2}}"
        for i, (k, c) in enumerate(zip(KINDS, SIGNAL_CATEGORIES))
    ) + "], lambda s: s.b = 1) AS signals FROM prompts)"
)


def over(table: str, expr: str, *ctes: str) -> str:
    return f"WITH {', '.join((PROMPTS, *ctes))} SELECT prompt_id, {expr} AS out FROM {table}"


def rule(category: str, i: int) -> str:
    return q("(?i)" + RULES[category][i])


def confidence_sql(source: str, level: int = 5) -> str:
    """``source``: a query with category and content, the first match of a rule. Adds ``confidence``, a step a level."""
    v = SecurityLevel(level)
    base = "CASE category " + " ".join(f"WHEN {q(c)} THEN {f(v.encoding_base if known is None else known)}" for c, (_, known, _) in CATEGORIES.items()) + f" WHEN 'custom' THEN {f(0.7)} ELSE {f(0.5)} END"
    up = lambda c, by: f"least(({c} * {f(by)})::FLOAT, {f(1.0)})"
    pair = " OR ".join(f"(contains(low, {q(a)}) AND contains(low, {q(b)}))" for a, b in patterns.RISKY_PAIRS)
    pressed = f"(contains(category, 'social_engineering') AND {any_of('low', patterns.URGENT)})"
    asks = "(contains(low, '?') OR prefix(low, 'how ') OR prefix(low, 'what ') OR contains(low, 'can you help') OR contains(low, 'please help'))"
    marks = f"({times('content', '=')} > 1 OR {times('content', '%')} > 5 OR {times('content', chr(92) + 'u')} > 3)"
    steps = (
        f"CASE WHEN strlen(content) > 50 THEN {up('c0', 1.15)} WHEN strlen(content) > 20 THEN {up('c0', 1.1)} WHEN strlen(content) < 5 THEN greatest((c0 * {f(0.8)})::FLOAT, {f(0.1)}) ELSE c0 END",
        f"CASE WHEN {pair} THEN {up('c1', 1.25)} ELSE c1 END",
        f"CASE WHEN {pressed} AND {asks} THEN {up('c2', 0.8)} WHEN {pressed} THEN {up('c2', 1.15)} ELSE c2 END",
        f"CASE WHEN contains(low, 'i am your') OR contains(low, 'this is your') THEN {up('c3', 1.3)} ELSE c3 END",
        f"CASE WHEN contains(category, 'encoding') AND {marks} THEN {up('c4', 1.2)} ELSE c4 END",
        f"CASE WHEN {count_of('low', patterns.SUSPICIOUS)} >= 3 THEN {up('c5', 1.15)} ELSE c5 END",
    )
    sql = f"SELECT *, lower(content) AS low, {base} AS c0 FROM ({source})"
    for k, s in enumerate(steps, 1):
        sql = f"SELECT *, {s} AS c{k} FROM ({sql})"
    return f"SELECT * EXCLUDE (low, c0, c1, c2, c3, c4, c5, c6), greatest(c6, {f(0.1)}) AS confidence FROM ({sql})"


def pattern_sql(category: str) -> str:
    found = matches(5, (category,))
    return f"WITH {PROMPTS}, {found} SELECT prompt_id, pattern_index, content, round(confidence::DOUBLE, 4) AS confidence FROM ({confidence_sql('SELECT prompt_id, h.category AS category, h.i AS pattern_index, h.m AS content FROM found')})"


def matches(level: int, categories: tuple[str, ...] | None = None, table: str = "prompts", keep: str = "prompt_id, text", custom: tuple[str, ...] = ()) -> str:
    """A CTE ``found``: one row a match of the level's rules, or of the categories'; ``h`` says which, and what."""
    rules = [(c, i, rule(c, i), CATEGORIES[c][0]) for c in sorted(SecurityLevel(level).categories if categories is None else categories) for i in range(len(RULES[c]))]
    rules += [("custom", i, q("(?i)" + p), "Custom") for i, p in enumerate(custom)]
    each = ", ".join(f"CASE WHEN regexp_matches(text, {rx}) THEN {{'n': {n}, 'category': {q(c)}, 'i': {i}, 'kind': {q(kind)}, 'm': regexp_extract(text, {rx})}} END" for n, (c, i, rx, kind) in enumerate(rules))
    return f"found AS (SELECT {keep}, unnest(list_filter([{each}], lambda x: x IS NOT NULL)) AS h FROM {table})"


def percent_share(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0.0::DOUBLE ELSE {times(text, '%')} / strlen({text})::DOUBLE END"


def shape64(p: str) -> str:
    pad = f"(strlen({p}) - strlen(rtrim({p}, '=')))"
    signs = f"((regexp_matches({p}, '[a-z]') AND regexp_matches({p}, '[A-Z]'))::INT + regexp_matches({p}, '[0-9]')::INT + (contains({p}, '+') OR contains({p}, '/'))::INT + contains({p}, '=')::INT + (strlen({p}) > 20)::INT)"
    return f"(strlen({p}) >= 8 AND regexp_full_match({p}, '[A-Za-z0-9+/=_-]+') AND {pad} <= 2 AND (strlen({p}) % 4 = 0 OR ({pad} > 0 AND (strlen({p}) + {pad}) % 4 = 0)) AND {signs} >= 2)"


def shapehex(p: str) -> str:
    bare = f"regexp_replace({p}, '^0[xX]', '')"
    return f"(strlen({bare}) > 20 AND strlen({bare}) % 2 = 0 AND regexp_full_match({bare}, '[0-9a-fA-F]+') AND len(list_distinct(string_split({bare}, ''))) > 3)"


def decoded64(t: str) -> str:
    """The bytes of canonical base64, else null."""
    return f"(CASE WHEN regexp_full_match({t}, '[A-Za-z0-9+/]*={{0,2}}') AND strlen({t}) % 4 = 0 AND to_base64(TRY(from_base64({t}))) = {t} THEN TRY(from_base64({t})) END)"


def percent_decoded(t: str) -> str:
    return f"COALESCE(TRY(url_decode({t})), {t})"


def bare_controls(t: str) -> str:
    return f"regexp_replace({t}, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g')"


def rotated(t: str) -> str:
    return f"translate({t}, {q('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ')}, {q('nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')})"


def whole64(t: str) -> str:
    return f"CASE WHEN strlen({t}) > 20 AND regexp_full_match({t}, '[A-Za-z0-9+/=]+') AND suffix({t}, '=') THEN COALESCE(TRY(decode({decoded64(t)})), {t}) ELSE {t} END"


def first_bytes(t: str, n: int) -> str:
    """At most n bytes, back to the edge of a character, which has at most four."""
    tries = ", ".join(f"TRY(decode(encode({t})[1:{n - k}]))" for k in range(4))
    return f"(CASE WHEN strlen({t}) <= {n} THEN {t} ELSE COALESCE({tries}) END)"


def kept(v: str) -> str:
    return f"CASE WHEN {v} <> text AND strlen({v}) > 5 THEN {v} END"


URL_READING = f"CASE WHEN {percent_decoded('text')} <> text THEN {percent_decoded('text')} END"
BASE64_READING = f"CASE WHEN strlen(text) >= 16 AND regexp_full_match(text, '[A-Za-z0-9+/]+={{0,2}}') AND strlen(text) % 4 = 0 THEN {kept('TRY(decode(from_base64(text)))')} END"
_HEX = "TRY(decode(unhex(regexp_replace(text, '^0x', ''))))"
HEX_READING = f"CASE WHEN regexp_full_match(text, '(0x)?([0-9A-Fa-f]{{2}}){{10,}}') THEN {kept(_HEX)} END"
ROT13_READING = kept(rotated("text"))
CONTROL_READING = kept(bare_controls("text"))
FRAGMENTS = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9+/]{{16,}}={{0,2}}'), lambda c: TRY(decode({decoded64('c')}))), lambda d: d IS NOT NULL AND d <> text AND strlen(d) > 5)"
READINGS = (
    f"list_sort(list_distinct(list_filter(list_concat([{URL_READING}, {BASE64_READING}, {HEX_READING}, {ROT13_READING}, {CONTROL_READING}], {FRAGMENTS}), lambda r: r IS NOT NULL AND r <> text AND strlen(r) > 5)))"
)
LETTERS = "len(regexp_extract_all(text, '\\p{L}'))"
PARTS = "string_split_regex(text, '[\\s:;,\"''()\\[\\]{}]')"
ONE = "(size >= 3 AND text = repeat(substr(text, 1, 1), length(text)))"


def tamed(c: str) -> str:
    return f"CASE WHEN {ONE} THEN least(({c} * {f(0.6)})::FLOAT, {f(0.8)}) ELSE {c} END"


def decoder_sql(data: str, level: int) -> str:
    """Confidence of an encoding, by whether the whole text decodes, to text, and to a suspicious word."""
    v = SecurityLevel(level)
    base, bonus = f(v.decoder_base()), f(v.decoder_bonus)
    one = f"({base} + ({f(0.1)} * {bonus})::FLOAT)::FLOAT"
    two = f"({one} + ({f(0.05)} * {bonus})::FLOAT)::FLOAT"
    word = any_of(f"lower(TRY(decode({data})))", heuristics.DECODED_WORDS)
    return f"least(CASE WHEN {data} IS NULL THEN {base} WHEN TRY(decode({data})) IS NULL THEN {one} WHEN {word} THEN ({two} + ({f(0.2)} * {bonus})::FLOAT)::FLOAT ELSE {two} END, {f(1.0)})"


def check_sql(level: int) -> dict[str, tuple[str, str, str, str]]:
    """Each heuristic check: a value v of the text, the test, the confidence and the kind, in order."""
    v = SecurityLevel(level)
    low = f"list_transform({WORDS}, lambda w: lower(w))"
    share = f"list_max(map_values(list_histogram({low}))) / len({WORDS})::DOUBLE"
    lined = "CASE WHEN contains(text, '!!') OR contains(text, '??') OR contains(text, '...') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"
    more = lambda c: f"CASE WHEN {times('text', c)} > 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
    odd = f"(list_sum(list_transform({WORDS}, lambda w: strlen(w))) / len({WORDS})::DOUBLE) NOT BETWEEN 2.0 AND 10.0"
    caps = lambda w: f"regexp_matches({w}, '\\p{{Lu}}')"
    flips = f"len(list_filter(list_zip({WORDS}, {WORDS}[2:]), lambda p: {caps('p[2]')} <> {caps('p[1]')} AND strlen(p[2]) > 1)) > 0"
    twice = "least(v * 2.0::DOUBLE, 1.0::DOUBLE)::FLOAT"
    n_rot = count_of(f"lower({rotated('text')})", heuristics.ROTATED_WORDS)
    base, bonus = f(v.decoder_base(rot13=True)), f(v.decoder_bonus)
    rot = f"least(CASE WHEN {n_rot} > 0 THEN ({base} + (({f(0.2)} + ({n_rot}::FLOAT * {f(0.05)})::FLOAT)::FLOAT * {bonus})::FLOAT)::FLOAT ELSE {base} END, {f(1.0)})"
    inner = f"TRY(decode({decoded64('text')}))"
    marks = f"({times('text', '%')} > 5)::INT + ({times('text', chr(92) + 'u')} > 3)::INT + ({times('text', '&#')} > 3)::INT + {shape64('text')}::INT + {shapehex('text')}::INT"
    multi = f"(size > 20 AND {shape64('text')} AND COALESCE({percent_share(inner)} > 0.1::DOUBLE, FALSE)) OR ({percent_share('text')} > 0.1::DOUBLE AND {shape64(percent_decoded('text'))}) OR {marks} >= 2"
    bare = "regexp_replace(text, '^0[xX]', '')"
    unhexed = f"(CASE WHEN regexp_full_match({bare}, '([0-9A-Fa-f]{{2}})*') THEN TRY(unhex({bare})) END)"
    letters = "len(regexp_extract_all(text, '[A-Za-z]')) >= length(text) * 3 // 4"
    return {
        "h_entropy": ("CASE WHEN text = '' THEN 0 ELSE list_aggregate(string_split(text, ''), 'entropy') END", "(v > 4.5 AND size > 20)", "least((v - 4.5) / 2.0, 1.0)::FLOAT", "EncodingBypass"),
        "h_special": ("CASE WHEN text = '' THEN 0.0::DOUBLE ELSE len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s]')) / length(text)::DOUBLE END", "(v > 0.3::DOUBLE AND size > 5)", tamed(twice), "EncodingBypass"),
        "h_repeat": (f"CASE WHEN size < 10 OR len({WORDS}) < 3 THEN 0.0::DOUBLE ELSE {share} END", "(v > 0.7::DOUBLE)", "least(v::FLOAT, 1.0::FLOAT)", "ContextConfusion"),
        "h_punct": (
            f"CASE WHEN text = '' THEN 0.0::DOUBLE ELSE len(regexp_extract_all(text, '[!-/:-@\\[-`{{-~]')) / greatest(length(text), 1)::DOUBLE + {more('!')} + {more('?')} + {lined} END",
            "(v > 0.6::DOUBLE AND size > 5)", tamed(f"least(v::FLOAT, {f(1.0)})"), "ContextConfusion",
        ),
        "h_format": (count_of("text", heuristics.FORMAT_MARKS), "(v >= 2)", f(0.7), "ContextConfusion"),
        "h_words": (f"len({WORDS}) >= 5 AND {odd} AND {flips}", "v", f"({f(0.3)} + {f(0.4)})::FLOAT", "ContextConfusion"),
        "h_caps": (f"CASE WHEN {LETTERS} = 0 THEN 0.0::DOUBLE ELSE len(regexp_extract_all(text, '\\p{{Lu}}')) / {LETTERS}::DOUBLE END", "(v > 0.5::DOUBLE AND size > 20)", "(v - 0.3::DOUBLE)::FLOAT", "SocialEngineering"),
        "h_b64": (f"len(list_filter({PARTS}, lambda p: {shape64('p')})) > 0", "v", decoder_sql(decoded64("text"), level), "EncodingBypass"),
        "h_hex": (f"len(list_filter({PARTS}, lambda p: {shapehex('p')})) > 0", "v", decoder_sql(unhexed, level), "EncodingBypass"),
        "h_rot13": (f"(size >= 30 AND {letters} AND NOT {any_of('lower(text)', heuristics.PLAIN_WORDS)} AND len(regexp_extract_all(lower(text), '[noret]')) > size // 6)", "v", rot, "EncodingBypass"),
        "h_url": (percent_share("text"), "(v > 0.15::DOUBLE AND size > 5)", tamed(twice), "EncodingBypass"),
        "h_unicode": (f"{times('text', chr(92) + 'u')} + {times('text', '&#')}", "(v > 2)", f"least((v::FLOAT / {f(10.0)})::FLOAT, {f(1.0)})", "EncodingBypass"),
        "h_zw": ("len(regexp_extract_all(text, '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{2060}]'))", "(v > 0)", f"least(greatest((v::FLOAT / {f(10.0)})::FLOAT, {f(0.6)}), {f(0.9)})", "EncodingBypass"),
        "h_multi": (multi, "v", f(0.85), "EncodingBypass"),
    }


def heuristic_sql(name: str) -> str:
    value, test, confidence, _ = check_sql(5)[name]
    v = f"SELECT *, {value} AS v FROM (SELECT prompt_id, text, strlen(text) AS size FROM prompts)"
    return f"WITH {PROMPTS} SELECT prompt_id, {test} AS fired, CASE WHEN {test} THEN round(({confidence})::DOUBLE, 4) END AS confidence FROM ({v})"


def benign_sql() -> str:
    terms = [f"CASE WHEN contains(lower(text), {q(p)}) THEN {f(w)} ELSE {f(0.0)} END" for p, w in heuristics.BENIGN]
    terms += [f"CASE WHEN suffix(text, '?') THEN {f(0.5)} ELSE {f(0.0)} END", f"CASE WHEN len({WORDS}) > 5 THEN {f(0.2)} ELSE {f(0.0)} END", f"CASE WHEN regexp_matches(text, '[.!?]') THEN {f(0.3)} ELSE {f(0.0)} END"]
    total = f(0.0)
    for t in terms:
        total = f"({total} + {t})::FLOAT"
    return f"least({total}, {f(2.0)})"


def damped_sql(signals: str, b: str, made) -> str:
    """``made``: a signal's SQL from that of its confidence."""
    keep = f"CASE s.kind WHEN 'SocialEngineering' THEN {f(0.3)} WHEN 'ContextConfusion' THEN {f(0.5)} WHEN 'EncodingBypass' THEN {f(0.7)} ELSE {f(0.8)} END"
    weaker = f"(s.confidence * ({f(1.0)} - (least({b} / {f(2.0)}, {f(1.0)})::FLOAT * ({f(1.0)} - {keep})::FLOAT)::FLOAT)::FLOAT)::FLOAT"
    return f"CASE WHEN {b} < {f(0.5)} THEN {signals} ELSE list_filter(list_transform({signals}, lambda s: {made(weaker)}), lambda s: s.confidence > {f(0.15)}) END"


QUESTION = "(suffix(regexp_replace(text, '\\s+$', ''), '?') OR " + " OR ".join(f"prefix(lower(text), {q(o)})" for o in preprocess.OPENERS) + ")"
EDUCATIONAL = any_of("lower(text)", preprocess.EDUCATIONAL)


def keyword_sql(threshold: float) -> tuple[str, list[str], str]:
    """Over the first bytes, t: the score of intent, the confidences of the three kinds of confusion (null: none), and the number of switches."""
    intent = f(0.0)
    for ws, weight in ((keywords.EMOTIONAL, 0.2), (keywords.AUTHORITY, 0.15)):
        for w in ws:
            intent = f"({intent} + CASE WHEN contains(lower(t), {q(w)}) THEN {f(weight)} ELSE {f(0.0)} END)::FLOAT"
    confusion = []
    for _, (a, b), factor in keywords.CONFUSION:
        c = f"least((({f(0.6)} * least((length(t)::FLOAT / {f(100.0)})::FLOAT, {f(1.5)}))::FLOAT * {f(factor)})::FLOAT, {f(1.0)})"
        confusion.append(f"CASE WHEN (contains(t, {q(a)}) OR contains(t, {q(b)})) AND {c} >= {f(threshold)} THEN {c} END")
    return intent, confusion, count_of("lower(t)", keywords.SWITCHES)


def encoded_sql(t: str) -> str:
    for a, b in mitigate.ENCODED:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


def bare_percents_sql(t: str) -> str:
    for a, b in mitigate.DECODED:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return f"regexp_replace({t}, '\\\\u[0-9a-fA-F]{{4}}', '[UNICODE_FILTERED]', 'g')"


def filtered64_sql(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '[A-Za-z0-9+/]{{50,}}={{0,2}}') AND strlen({t}) > 100 THEN regexp_replace({t}, '[A-Za-z0-9+/]{{20,}}={{0,2}}', '[BASE64_FILTERED]', 'g') ELSE {t} END"


def calmed_sql(t: str) -> str:
    for rx, tag in mitigate.URGENCY:
        t = f"regexp_replace({t}, {q('(?i)' + rx)}, {q(tag)}, 'g')"
    return t


def warned_sql(t: str) -> str:
    return f"CASE WHEN {any_of(f'lower({t})', mitigate.SOCIAL_MARKERS)} THEN {q(mitigate.SOCIAL_PREFIX)} || {t} ELSE {t} END"


def general_sql(t: str, aggressive: bool) -> str:
    t = f"regexp_replace(regexp_replace({t}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s{{3,}}', ' ', 'g')"
    if aggressive:
        t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    return f"regexp_replace({t}, '(?i)<script[^>]*>.*?</script>', '[SCRIPT_REMOVED]', 'g')"


def trimmed_sql(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^\\s+', ''), '\\s+$', '')"


def cut_sql(t: str, most: int) -> str:
    return f"replace(replace(replace(CASE WHEN strlen({t}) > {most} THEN {first_bytes(t, most)} || '[TRUNCATED]' ELSE {t} END, '[]', ''), '()', ''), '{{}}', '')"


def mean_sql() -> str:
    return f"CASE WHEN len(signals) > 0 THEN (list_reduce(list_prepend({f(0.0)}, list_transform(signals, lambda s: s.confidence)), lambda a, b: (a + b)::FLOAT) / len(signals)::FLOAT)::FLOAT ELSE {f(0.0)} END"


def combination_sql(name: str) -> str:
    made = lambda base, share: f"round(least(({f(base)} + m * {f(share)})::FLOAT, {f(1.0)})::DOUBLE, 4)"
    has = lambda k: f"list_contains(kinds, {q(k)})"
    pairs = {key: (" AND ".join(has(k) for k in kinds), base, share) for key, kinds, _, base, share in combine.PAIRS}
    pairs["c_authurg"] = (f"{has('SocialEngineering')} AND {any_of('lower(text)', combine.CLAIMS)} AND {any_of('lower(text)', combine.URGENCY)}", 0.8, 0.1)
    pairs["c_escal"] = ("strlen(text) > 200 AND len(signals) > 2", 0.75, 0.05)
    pairs["c_multistage"] = ("len(list_distinct(kinds)) >= 4", 0.9, 0.1)
    met, base, share = pairs[name]
    inner = f"SELECT *, list_transform(signals, lambda s: s.kind) AS kinds, {mean_sql()} AS m FROM signals"
    return f"WITH {PROMPTS}, {SIGNALS} SELECT prompt_id, CASE WHEN {met} THEN {made(base, share)} END AS out FROM ({inner})"


def scored(level: int, signals: str = "signals", k: str = "s.kind") -> str:
    """A query with prompt_id, score (FLOAT), top (FLOAT), n over the fixed signals, as the level scores them."""
    v = SecurityLevel(level)
    import numpy as np

    keep = lambda share, least: repr(float(max(np.float32(1.0) - np.float32(share) * np.float32(v.adjustment), np.float32(least))))
    adj = (
        f"(CASE WHEN s.category IN ('authority_manipulation_advanced', 'urgency_manipulation_advanced') THEN least(greatest((s.confidence * CAST({keep(0.3, 0.2)} AS FLOAT))::FLOAT, {f(0.0)}), {f(1.0)}) "
        f"WHEN s.category IN ('context_confusion', 'context_hijacking_advanced') THEN least(greatest((s.confidence * CAST({keep(0.2, 0.3)} AS FLOAT))::FLOAT, {f(0.0)}), {f(1.0)}) ELSE s.confidence END)"
    )
    weight = "(CASE s.kind " + " ".join(f"WHEN {q(k)} THEN {f(w)}" for k, w in SEVERITY.items()) + f" END * CAST({v.pattern_weight!r} AS FLOAT))::FLOAT"
    high, low = float(np.float32(v.base_threshold) + np.float32(0.2)), float(np.float32(v.base_threshold) - np.float32(0.2))
    total = lambda what: f"list_reduce(list_prepend({f(0.0)}, list_transform(rated, lambda r: {what})), lambda a, b: (a + b)::FLOAT)"
    a = f"SELECT prompt_id, text, signals, list_transform(signals, lambda s: {{'c': {adj}, 'w': {weight}, 'k': {k}}}) AS rated FROM {signals}"
    b = (
        f"SELECT *, len(rated) AS n, {total('(r.c * r.w)::FLOAT')} AS t, {total('r.w')} AS w, list_max(list_transform(rated, lambda r: r.c)) AS top, len(list_filter(rated, lambda r: r.c > CAST({high!r} AS FLOAT))) AS bad, "
        f"len(list_filter(rated, lambda r: r.c < CAST({low!r} AS FLOAT))) AS good, len(list_distinct(list_transform(rated, lambda r: r.k))) AS kinds FROM ({a})"
    )
    multi = f"CAST({v.combination_multiplier!r} AS FLOAT)"
    variety = f"CASE WHEN kinds > 2 THEN ({f(0.08)} * {multi})::FLOAT WHEN kinds > 1 THEN ({f(0.05)} * {multi})::FLOAT ELSE {f(0.0)} END"
    penalty = f"CASE WHEN good > bad THEN (CAST({-v.benign_factor!r} AS FLOAT) * (good::FLOAT / n::FLOAT)::FLOAT)::FLOAT ELSE {f(0.0)} END"
    score = f"CASE WHEN n = 0 THEN {f(0.0)} ELSE least(greatest(((t / w)::FLOAT + {variety} + {penalty})::FLOAT, {f(0.0)}), {f(1.0)}) END"
    return f"SELECT prompt_id, signals, n, {score} AS score, CASE WHEN n = 0 THEN {f(1.0)} ELSE top END AS top, rated FROM ({b})"


def risk_sql(level: int) -> str:
    v = SecurityLevel(level)
    c, h, m, low = (f"CAST({x!r} AS FLOAT)" for x in v.thresholds)
    r = f"CASE WHEN score >= {c} THEN 4 WHEN score >= {h} THEN 3 WHEN score >= {m} THEN 2 WHEN score >= {low} THEN 1 ELSE 0 END"
    return f"CASE WHEN n = 0 OR ({r}) < {v.risk_floor} THEN 0 ELSE ({r}) END"


def with_signals(sql: str) -> str:
    return f"WITH {PROMPTS}, {SIGNALS} {sql}"


EVENTS = (
    "events_in AS (SELECT event_id AS seq, ts AS recorded_at, floor(value)::BIGINT AS duration_ms, ["
    + ", ".join(q(r) for r in RISKS) + "][(event_id % 5) + 1] AS risk_label, event_id % 5 >= 2 AS injection_detected, (event_id % 100) / 100.0::DOUBLE AS confidence, ["
    + ", ".join(q(k) for k in KINDS) + "][(event_id % 8) + 1] AS kind FROM events)"
)


def strategy_sql(s: mitigate.Strategy, t: str) -> str:
    return {
        "remove": "''", "replace": q(s.a), "encode": encoded_sql(t), "prefix": f"{q(s.a)} || {t}", "suffix": f"{t} || {q(s.a)}", "wrap": f"{q(s.a)} || {t} || {q(s.b)}", "custom": f"replace({q(s.a)}, '{{original}}', {t})",
    }[s.kind]


def strategies_sql(pairs: dict[str, mitigate.Strategy], key: str, flags: bool) -> str:
    rows = " UNION ALL ".join(
        f"SELECT prompt_id, {q(k)} AS {key}, {strategy_sql(s, 'text')} AS out" + (f", {s.preserves_content} AS preserves, {s.removes_threat} AS removes" if flags else "") + " FROM prompts"
        for k, s in pairs.items()
    )
    return f"WITH {PROMPTS} {rows}"


def response_sql(expr: str, would: bool) -> str:
    risk = "[" + ", ".join(q(r) for r in RISKS) + "][(abs(prompt_id) % 5) + 1]"
    return with_signals(f"SELECT prompt_id, {expr.replace('RISK', risk)} AS out, {'abs(prompt_id) % 5 >= 2' if would else 'FALSE'} AS would FROM signals")


def sql() -> dict[str, str]:
    total, question, educational = benign_sql(), QUESTION, EDUCATIONAL
    benign_flag = " + ".join(f"CASE WHEN regexp_matches(lower(text), {q(rx)}) THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for rx, w in preprocess.BENIGN)
    intent, confusion, switch = keyword_sql(0.1)
    kw = lambda expr: f"WITH {PROMPTS} SELECT prompt_id, round(({expr})::DOUBLE, 4) AS confidence FROM (SELECT prompt_id, {first_bytes('text', 512)} AS t FROM prompts)"
    warned = mitigate.WARNED.split("%s")
    blocked = mitigate.BLOCKED.replace("%d", "|").replace("%s", "|").split("|")
    names = "array_to_string(list_sort(list_distinct(list_transform(signals, lambda s: s.kind))), ', ')"
    pct = lambda p: f"COALESCE((SELECT duration_ms FROM ordered WHERE k = least(n * {p} // 100, n - 1)), 0) AS p{p}"
    rank = lambda p: f"(SELECT duration_ms FROM ordered WHERE k = floor({p} / 100.0 * (n - 1) + 0.5)) AS p{p}"
    ordered = "ordered AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) - 1 AS k, count(*) OVER () AS n FROM events_in)"
    listed = lambda signals: f"array_to_string(list_transform({signals}, lambda s: printf('%.3f', s.confidence::DOUBLE)), ',')"
    of = lambda c: f"{{'kind': s.kind, 'category': s.category, 'confidence': {c}}}"
    plain = f"list_transform(signals, lambda s: {of('s.confidence')})"
    halved = f"CASE WHEN qn AND s.kind = 'SocialEngineering' THEN (s.confidence * {f(0.5)})::FLOAT ELSE s.confidence END"
    lowered = f"CASE WHEN e AND (contains(s.category, 'authority') OR contains(s.category, 'urgency')) THEN (s.confidence * {f(0.4)})::FLOAT ELSE s.confidence END"
    faint = f"lambda s: NOT (s.confidence < {f(0.15)} AND (qn OR e))"
    both = f"list_transform(list_transform(signals, lambda s: {of(halved)}), lambda s: {of(lowered)})"
    context = lambda signals: f"SELECT prompt_id, {listed(signals)} AS out FROM (SELECT *, {question} AS qn, {educational} AS e FROM signals)"
    rx = {k: q(v) for k, v in NAMED.items()}
    ascii_text, pattern = "regexp_replace(text, '[^\\x00-\\x7F]', chr(1), 'g')", "source || ' instructions'"
    byte = "CASE WHEN p = '+' THEN ' ' WHEN regexp_full_match(p, '%[0-9A-Fa-f]{2}') THEN chr(('0x' || substr(p, 2, 2))::INT) ELSE p END"
    out = {
        "pred_empty": over("prompts", "text = ''"),
        "pred_maxlen": over("prompts", "strlen(text) > 10000"),
        "pre_ctrl": over("prompts", bare_controls("text")),
        "pre_url": over("prompts", percent_decoded("text")),
        "pre_b64": over("prompts", whole64("text")),
        "pre_trunc": over("prompts", first_bytes("text", 101)),
        "q_question": over("prompts", question),
        "q_educational": over("prompts", educational),
        "q_benign_flag": over("prompts", f"({benign_flag} + CASE WHEN len({WORDS}) > 0 AND {LETTERS} / len({WORDS})::DOUBLE BETWEEN 3.0 AND 8.0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(text, '[.?!]$') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) > 0.8::DOUBLE"),
        "pat_scan": f"WITH {PROMPTS}, {matches(5)} SELECT prompt_id, h.category AS category, h.i AS pattern_index, strlen(substr(text, 1, instr(text, h.m) - 1)) AS start, strlen(substr(text, 1, instr(text, h.m) - 1)) + strlen(h.m) AS stop FROM found",
        "pat_scan_join": f"WITH {PROMPTS}, {matches(1)} SELECT h.category AS category, h.i AS i, count(*) AS n FROM found GROUP BY 1, 2",
        "pat_custom": f"WITH {PROMPTS} SELECT prompt_id, i AS pattern_index, regexp_extract(text, rx) AS content, 'Custom Pattern' AS custom_name FROM prompts, (VALUES (0, '(?i)secret\\s+handshake|weather'), (1, '(?i)abc')) r(i, rx) WHERE regexp_matches(text, rx)",
        "pat_type_counts": f"WITH {PROMPTS}, {matches(3)} SELECT h.kind AS kind, count(*) AS n FROM found GROUP BY 1",
        "h_benign": over("prompts", f"round({total}::DOUBLE, 4)"),
        "h_adjust": with_signals(f"SELECT prompt_id, {listed(damped_sql(plain, 'b', of))} AS out FROM (SELECT *, {total} AS b FROM signals)"),
        "s_confusion": kw(f"COALESCE({', '.join(confusion)})"),
        "s_intent": kw(f"CASE WHEN {intent} >= {f(0.3)} THEN (least({intent}, {f(1.0)}) * {f(0.8)})::FLOAT END"),
        "s_switch": kw(f"CASE WHEN {switch} >= 2 THEN least(({switch}::FLOAT * {f(0.3)})::FLOAT, {f(1.0)}) END"),
        "v_url": over("prompts", URL_READING),
        "v_b64": over("prompts", BASE64_READING),
        "v_hex": over("prompts", HEX_READING),
        "v_rot13": over("prompts", ROT13_READING),
        "v_ctrl": over("prompts", CONTROL_READING),
        "f_context": with_signals(context(f"list_filter({both}, {faint})")),
        "f_question": with_signals(context(f"list_transform(signals, lambda s: {of(halved)})")),
        "f_edu": with_signals(context(f"list_transform(signals, lambda s: {of(lowered)})")),
        "f_drop": with_signals(context(f"list_filter(signals, {faint})")),
        "r_level": with_signals(f"SELECT prompt_id, CASE WHEN n > 0 THEN [{', '.join(q(r) for r in RISKS)}][({risk_sql(7)}) + 1] END AS out FROM ({scored(7)})"),
        "r_none": with_signals("SELECT prompt_id, CASE WHEN len(signals) = 0 THEN 1.0::DOUBLE END AS out FROM signals"),
        "r_catadj": with_signals(f"SELECT prompt_id, array_to_string(list_transform(rated, lambda r: printf('%.3f', r.c::DOUBLE)), ',') AS out FROM ({scored(5)})"),
        "r_weighted": with_signals(f"SELECT prompt_id, round(score::DOUBLE, 4) AS out FROM ({scored(5)})"),
        "r_conf": with_signals(f"SELECT prompt_id, round(top::DOUBLE, 4) AS out FROM ({scored(5)})"),
        "r_floor": with_signals(f"SELECT prompt_id, {risk_sql(2)} AS out FROM ({scored(2)})"),
        "r_level_grid": with_signals(" UNION ALL ".join(f"SELECT prompt_id, {v} AS level, {risk_sql(v)} AS risk, round(score::DOUBLE, 4) AS score FROM ({scored(v)})" for v in range(11))),
        "r_top": with_signals("SELECT prompt_id, list_filter(signals, lambda s: s.confidence = list_max(list_transform(signals, lambda x: x.confidence)))[-1].kind AS out FROM signals"),
        "r_diversity": with_signals("SELECT prompt_id, len(list_distinct(list_transform(signals, lambda s: s.kind))) AS out FROM signals"),
        "m_allow": response_sql(f"{q(mitigate.WARNING_PREFIX)} || text", False),
        "m_block": response_sql(f"{q(blocked[0])} || len(signals) || {q(blocked[1])} || RISK || {q(blocked[2])}", True),
        "m_warn": response_sql(f"{q(warned[0])} || {names} || {q(warned[1])} || RISK || {q(warned[2])}", True),
        "m_custom": response_sql("'Please rephrase.'", True),
        "ms_apply": strategies_sql({k: mitigate.Strategy(k, *a) for k, a in {"remove": (), "replace": ("[X]",), "encode": (), "prefix": ("<<",), "suffix": (">>",), "wrap": ("(", ")"), "custom": ("was: {original}",)}.items()}, "strategy", True),
        "ms_encode": over("prompts", encoded_sql("text")),
        "ms_default": strategies_sql(mitigate.DEFAULTS, "kind", False),
        "ms_select": strategies_sql({k: mitigate.Selector().of(k) for k in mitigate.DEFAULTS}, "kind", False),
        "san_dec": over(f"(SELECT prompt_id, {bare_percents_sql('text')} AS t FROM prompts)", filtered64_sql("t")),
        "san_se": over(f"(SELECT prompt_id, {calmed_sql('text')} AS t FROM prompts)", warned_sql("t")),
        "san_general": over("prompts", general_sql("text", True)),
        "san_cleanup": over(f"(SELECT prompt_id, {trimmed_sql('text')} AS t FROM prompts)", cut_sql("t", 200)),
        "a_totals": f"WITH {EVENTS} SELECT count(*) AS total_analyzed, count_if(injection_detected) AS injections_detected, sum(duration_ms)::BIGINT AS total_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round(avg(duration_ms), 4) AS avg_ms, round(count_if(injection_detected) / count(*)::DOUBLE, 6) AS detection_rate FROM events_in",
        "a_rate_pct": f"WITH {EVENTS} SELECT round(count_if(injection_detected) / count(*)::DOUBLE * 100, 4) AS detection_rate_percent FROM events_in",
        "a_risk": f"WITH {EVENTS} SELECT risk_label, count(*) AS n FROM events_in GROUP BY 1",
        "a_threat": f"WITH {EVENTS} SELECT kind, count(*) AS n FROM events_in GROUP BY 1",
        "a_conf": f"WITH {EVENTS} SELECT round(avg(confidence) FILTER (WHERE injection_detected), 6) AS avg_positive, round(avg(confidence) FILTER (WHERE NOT injection_detected), 6) AS avg_negative, min(confidence) AS min_confidence, max(confidence) AS max_confidence, round(stddev_pop(confidence), 6) AS std_dev FROM events_in",
        "a_pct": f"WITH {EVENTS}, {ordered.replace('FROM events_in', 'FROM events_in WHERE duration_ms IS NOT NULL')} SELECT {', '.join(pct(p) for p in (50, 90, 95, 99))} FROM (SELECT max(n) AS n FROM ordered)".replace("WHERE k = least(n *", "WHERE k = least(ordered.n *").replace(", n - 1)", ", ordered.n - 1)"),
        "a_retain": f"WITH {EVENTS} SELECT seq FROM events_in WHERE recorded_at >= (SELECT max(recorded_at) FROM events_in) - INTERVAL 1 HOUR ORDER BY recorded_at DESC, seq DESC LIMIT 10000",
        "a_snapshot": f"WITH {EVENTS}, kept AS (SELECT * FROM events_in WHERE recorded_at >= (SELECT max(recorded_at) FROM events_in) - INTERVAL 1 HOUR ORDER BY recorded_at DESC, seq DESC LIMIT 10000), "
        "ordered AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) - 1 AS k, count(*) OVER () AS n FROM kept WHERE duration_ms IS NOT NULL) "
        "SELECT (SELECT count(*) FROM events_in) AS total_analyzed, (SELECT count_if(injection_detected) FROM events_in) AS injections_detected, (SELECT sum(duration_ms)::BIGINT FROM events_in) AS total_ms, "
        "(SELECT min(duration_ms) FROM events_in) AS min_ms, (SELECT max(duration_ms) FROM events_in) AS max_ms, (SELECT round(avg(duration_ms), 4) FROM events_in) AS avg_ms, "
        "(SELECT round(count_if(injection_detected) / count(*)::DOUBLE, 6) FROM events_in) AS detection_rate, "
        "(SELECT string_agg(risk_label || '=' || n, ',' ORDER BY risk_label) FROM (SELECT risk_label, count(*) AS n FROM events_in GROUP BY 1)) AS risk_levels, "
        "(SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM events_in GROUP BY 1)) AS threat_types, "
        "COALESCE((SELECT round(avg(confidence) FILTER (WHERE injection_detected), 6) FROM kept), 0.0) AS avg_positive, COALESCE((SELECT round(avg(confidence) FILTER (WHERE NOT injection_detected), 6) FROM kept), 0.0) AS avg_negative, "
        "(SELECT min(confidence) FROM kept) AS min_confidence, (SELECT max(confidence) FROM kept) AS max_confidence, (SELECT round(stddev_pop(confidence), 6) FROM kept) AS std_dev, "
        + ", ".join(f"(SELECT duration_ms FROM ordered WHERE k = least(ordered.n * {p} // 100, ordered.n - 1)) AS p{p}" for p in (50, 90, 95, 99)),
        "a_windowed": f"WITH {EVENTS} SELECT strftime(time_bucket(INTERVAL 1 HOUR, recorded_at), '%Y-%m-%d %H:%M') AS window_start, risk_label, count(*) AS n, count_if(injection_detected) AS injections, round(avg(confidence), 6) AS avg_confidence FROM events_in GROUP BY 1, 2",
        "a_label_eval": f"WITH {EVENTS} SELECT count(*) AS n, count_if(injection_detected AND NOT s) AS true_positives, count_if(injection_detected AND s) AS false_positives, count_if(NOT injection_detected AND NOT s) AS false_negatives, count_if(NOT injection_detected AND s) AS true_negatives, round(count_if(injection_detected AND s) / count_if(s)::DOUBLE, 6) AS false_positive_rate, round(count_if(NOT injection_detected AND NOT s) / nullif(count_if(NOT s), 0)::DOUBLE, 6) AS false_negative_rate FROM events_in JOIN (SELECT doc_id AS seq, toxic = 0 AS s FROM labels) USING (seq)",
        "u_norm": over("prompts", f"regexp_replace(regexp_replace({bare_controls('text')}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"),
        "u_lev": over("prompts", f"levenshtein({ascii_text}, {pattern})"),
        "u_sim": over("prompts", f"round(1.0::DOUBLE - levenshtein({ascii_text}, {pattern}) / greatest(length(text), length({pattern}))::DOUBLE, 6)"),
        "u_words": over("prompts", f"array_to_string(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'))), lambda w: strlen(w) >= 4), ' ')"),
        "u_entropy": over("prompts", f"CASE WHEN text = '' THEN 0.0::DOUBLE ELSE round(list_aggregate(string_split(text, ''), 'entropy'), 6) END"),
        "pre_full": over(f"(SELECT prompt_id, {whole64('t')} AS w FROM (SELECT prompt_id, {percent_decoded(bare_controls('text'))} AS t FROM prompts))", first_bytes("w", 10_000)),
        "v_b64frag": over("prompts", f"array_to_string({FRAGMENTS}, '|')"),
        "v_dedup": over("prompts", f"array_to_string({READINGS}, '|')"),
        "u_urldec": over("prompts", f"array_to_string(list_transform(regexp_extract_all(text, '(?s)%..|.'), lambda p: {byte}), '')"),
        "u_valid": over("prompts", f"concat_ws(',', (strlen(text) BETWEEN 1 AND 1000)::VARCHAR, (NOT regexp_matches(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]'))::VARCHAR, regexp_matches(text, {rx['email']})::VARCHAR, regexp_matches(text, {rx['url']})::VARCHAR)"),
        "u_isb64": over("prompts", "strlen(text) >= 4 AND strlen(text) % 4 = 0 AND regexp_full_match(text, '[A-Za-z0-9+/]*={0,2}')"),
        "u_ishex": over("prompts", "strlen(text) >= 8 AND strlen(text) % 2 = 0 AND regexp_full_match(text, '[0-9a-fA-F]+')"),
        "u_detect": over("prompts", "concat_ws(',', CASE WHEN strlen(text) >= 4 AND strlen(text) % 4 = 0 AND regexp_full_match(text, '[A-Za-z0-9+/]*={0,2}') THEN 'base64' END, CASE WHEN strlen(text) >= 8 AND strlen(text) % 2 = 0 AND regexp_full_match(text, '[0-9a-fA-F]+') THEN 'hex' END, CASE WHEN contains(text, '%') THEN 'url' END, CASE WHEN contains(text, '\\u') THEN 'unicode' END, CASE WHEN contains(text, '&#') THEN 'html_entity' END)"),
        "u_rx": f"WITH {PROMPTS} SELECT prompt_id, " + ", ".join(f"regexp_extract(text, {x}) AS {k}" for k, x in rx.items()) + " FROM prompts",
        "u_group": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
        "u_mode": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
        "u_pctl": f"WITH {EVENTS}, {ordered} SELECT {', '.join(rank(p) for p in (50, 90, 95, 99))}".replace("(n - 1)", "(ordered.n - 1)"),
        "u_time": f"WITH {EVENTS} SELECT seq, CASE WHEN d < 1000 THEN d || 'ms' WHEN d < 60000 THEN printf('%.1fs', round(d / 1000.0::DOUBLE, 1)) WHEN d < 3600000 THEN printf('%.1fm', round(d / 60000.0::DOUBLE, 1)) ELSE printf('%.1fh', round(d / 3600000.0::DOUBLE, 1)) END AS out FROM (SELECT seq, duration_ms * 997 AS d FROM events_in)",
        "t_severity": with_signals(f"SELECT prompt_id, array_to_string(list_transform(signals, lambda s: CASE WHEN s.confidence >= {f(0.9)} THEN 'Critical' WHEN s.confidence >= {f(0.7)} THEN 'High' WHEN s.confidence >= {f(0.5)} THEN 'Medium' WHEN s.confidence >= {f(0.3)} THEN 'Low' ELSE 'Very Low' END), ',') AS out FROM signals"),
        "conv_first_flagged": f"WITH {matches(1, table='conversations', keep='conv_id, turn')}" + " SELECT conv_id, min(turn) AS first_turn FROM found GROUP BY 1",
        "source_rollup": f"WITH {PROMPTS} SELECT source, count(*) AS n, count_if({question}) AS questions FROM prompts GROUP BY ROLLUP (source)",
        "no_signal_antijoin": f"WITH {PROMPTS}, {matches(1)} SELECT prompt_id FROM prompts ANTI JOIN found USING (prompt_id)",
    }
    out |= {f"pat_{c}": pattern_sql(c) for c in CATEGORIES}
    out |= {h: heuristic_sql(h) for h in check_sql(5)}
    out |= {c: combination_sql(c) for c in ("c_triple", "c_multi", "c_socjail", "c_ctxrole", "c_socdata", "c_authurg", "c_escal", "c_multistage")}
    return out
