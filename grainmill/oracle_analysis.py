"""The whole analysis, and the sanitizer, in DuckDB's SQL."""

from __future__ import annotations

import re

from grainmill.functions.levels import RISKS, SecurityLevel
from grainmill.operators import combine, mitigate
from grainmill.oracles import (
    EDUCATIONAL, PROMPTS, QUESTION, READINGS, SIGNALS, any_of, bare_controls, bare_percents_sql, benign_sql, calmed_sql, check_sql, confidence_sql, cut_sql, damped_sql, f, filtered64_sql, first_bytes, general_sql, keyword_sql, matches,
    percent_decoded, q, risk_sql, scored, strategy_sql, trimmed_sql, warned_sql, whole64,
)
from grainmill.plans.config import DetectorConfig, Preset

FIELDS = ("kind", "name", "category", "confidence", "spot", "m", "lost")


def signal(kind: str, confidence: str, name: str = "NULL", category: str = "NULL", place: str = "NULL", m: str = "NULL", lost: str = "FALSE") -> str:
    return (
        f"{{'kind': {kind}, 'name': {name}::VARCHAR, 'category': {category}::VARCHAR, 'confidence': ({confidence})::FLOAT, 'spot': ({place})::BIGINT, 'm': ({m})::VARCHAR, 'lost': {lost}}}"
    )


def but(**changed: str) -> str:
    """The signal s with other values for some fields."""
    return "{" + ", ".join(f"'{k}': {changed.get(k, f's.{k}')}" for k in FIELDS) + "}"


def present(signals: list[str]) -> str:
    return f"list_filter([{', '.join(signals)}], lambda x: x IS NOT NULL)"


TYPE = "CASE WHEN s.kind = 'Custom' THEN 'Custom:' || s.name ELSE s.kind END"
MEAN = f"CASE WHEN len(signals) > 0 THEN (list_reduce(list_prepend({f(0.0)}, list_transform(signals, lambda s: s.confidence)), lambda a, b: (a + b)::FLOAT) / len(signals)::FLOAT)::FLOAT ELSE {f(0.0)} END"


def chosen(kind: str, of: str) -> str:
    """What the selector's strategies make of ``of``."""
    known = mitigate.Selector().known()
    return f"CASE {kind} " + " ".join(f"WHEN {q(k)} THEN {strategy_sql(s, of)}" for k, s in known.items()) + f" ELSE {q(mitigate.FILTERED)} END"


def holds(kind: str, what: str) -> str:
    known = [k for k, s in mitigate.Selector().known().items() if getattr(s, what)]
    other = what == "removes_threat"  # the default replaces
    inside = f"{kind} IN ({', '.join(map(q, known))})"
    return f"({inside} OR {kind} NOT IN ({', '.join(map(q, mitigate.Selector().known()))}))" if other else f"({inside})"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is worked out once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def sanitized_sql(source: str, text: str, signals: str, level: int, most: int = 10_000) -> str:
    """The query ``source`` with ``clean``: ``text`` after the strategies of ``signals``, those with a place from the last back, then the others, then general cleaning."""
    numbered = f"list_transform({signals}, lambda s, i: {{'a': (s.spot IS NULL)::INT, 'b': COALESCE(-s.spot, 0), 'i': i, 's': s}})"
    here = "substr(t, x.s.spot, length(x.s.m)) = x.s.m AND x.s.m <> ''"
    local = f"CASE WHEN {here} THEN substr(t, 1, x.s.spot - 1) || ({chosen('x.s.kind', 'x.s.m')}) || substr(t, x.s.spot + length(x.s.m)) ELSE t END"
    everywhere = (
        f"CASE WHEN x.s.lost THEN (CASE WHEN {holds('x.s.kind', 'removes_threat')} THEN ({chosen('x.s.kind', 't')}) ELSE {q(mitigate.FILTERED)} END) "
        f"WHEN x.s.kind = 'EncodingBypass' THEN ({let(bare_percents_sql('t'), 'y', filtered64_sql('y'))}) WHEN x.s.kind = 'SocialEngineering' THEN ({let(calmed_sql('t'), 'y', warned_sql('y'))}) "
        f"WHEN x.s.kind = 'ContextConfusion' OR {holds('x.s.kind', 'preserves_content')} OR x.s.confidence > {f(0.9)} THEN ({chosen('x.s.kind', 't')}) ELSE t END"
    )
    folded = f"list_reduce(list_sort({numbered}), lambda t, x: CASE WHEN x.s.spot IS NOT NULL THEN ({local}) ELSE ({everywhere}) END, {text})"
    steps = f"SELECT *, {general_sql('z0', SecurityLevel(level).aggressive)} AS z1 FROM (SELECT *, {folded} AS z0 FROM ({source}))"
    return f"SELECT * EXCLUDE (z0, z1, z2), {cut_sql('z2', most)} AS clean FROM (SELECT *, {trimmed_sql('z1')} AS z2 FROM ({steps}))"


def analysis_ctes(config: DetectorConfig) -> str:
    """CTEs down to ``judged``: prompt_id, raw, error, text, signals, n, score, top, risk."""
    level, p = config.level.value, config.preprocessing
    text = bare_controls("raw") if p.normalize_unicode else "raw"
    if p.decode_encodings:
        text = whole64("t1").join(("(SELECT *, ", f" AS t2 FROM (SELECT *, {percent_decoded('t0')} AS t1 FROM (SELECT *, {text} AS t0 FROM a0)))"))
    else:
        text = f"(SELECT *, {text} AS t2 FROM a0)"
    checks = check_sql(level)
    valued = "SELECT *, " + ", ".join(f"{value} AS v_{k}" for k, (value, *_) in checks.items()) + f", {benign_sql()} AS b FROM (SELECT *, strlen(text) AS size FROM opened)"
    of = lambda sql, k: re.sub(r"\bv\b", f"v_{k}", sql)
    fired = [f"CASE WHEN {of(test, k)} THEN {signal(q(kind), of(confidence, k))} END" for k, (_, test, confidence, kind) in checks.items()]
    kw = "[]"
    if config.keywords.enabled:
        least = f(config.keywords.similarity_threshold)
        intent, confusion, switch = keyword_sql(config.keywords.similarity_threshold)
        strong, many = f"(least({intent}, {f(1.0)}) * {f(0.8)})::FLOAT", f"least(({switch}::FLOAT * {f(0.3)})::FLOAT, {f(1.0)})"
        made = [f"CASE WHEN ({c}) IS NOT NULL THEN {signal(q('ContextConfusion'), c)} END" for c in confusion]
        made.append(f"CASE WHEN {intent} >= {f(0.3)} AND {strong} >= {least} THEN {signal(q('SocialEngineering'), strong)} END")
        made.append(f"CASE WHEN {switch} >= 2 AND {many} >= {least} THEN {signal(q('ContextConfusion'), many)} END")
        kw = f"(SELECT {present(made)} FROM (SELECT {first_bytes('text', config.keywords.max_context_length)} AS t))"
    own = signal("kind", "confidence", "CASE WHEN category = 'custom' THEN 'Custom Pattern' END", "category", "place", "content")
    read = signal("kind", f"least((confidence * {f(1.05)})::FLOAT, {f(1.0)})", "CASE WHEN category = 'custom' THEN 'Custom Pattern' END", "category", lost="TRUE")
    none = "[]::STRUCT(kind VARCHAR, name VARCHAR, category VARCHAR, confidence FLOAT, spot BIGINT, m VARCHAR, lost BOOLEAN)[]"
    has = lambda k: f"list_contains(kinds, {q(k)})"
    joint = lambda met, name, base, share: f"CASE WHEN {met} THEN {signal(q('Custom'), f'least(({f(base)} + (m * {f(share)})::FLOAT)::FLOAT, {f(1.0)})', q(name))} END"
    combos = [joint(" AND ".join(has(k) for k in kinds), name, base, share) for _, kinds, name, base, share in combine.PAIRS]
    combos.append(joint(f"{has('SocialEngineering')} AND {any_of('lower(text)', combine.CLAIMS)} AND {any_of('lower(text)', combine.URGENCY)}", "Authority Urgency Manipulation", 0.8, 0.1))
    combos.append(joint("strlen(text) > 200 AND len(signals) > 2", "Gradual Escalation Attack", 0.75, 0.05))
    combos.append(joint("len(list_distinct(types)) >= 4", "Sophisticated Multi-Stage Attack", 0.9, 0.1))
    halved = but(confidence=f"(CASE WHEN qn AND s.kind = 'SocialEngineering' THEN s.confidence * {f(0.5)} ELSE s.confidence END)::FLOAT")
    pressed = "COALESCE(contains(s.category, 'authority') OR contains(s.category, 'urgency'), FALSE)"
    lowered = but(confidence=f"(CASE WHEN e AND {pressed} THEN s.confidence * {f(0.4)} ELSE s.confidence END)::FLOAT")
    context = f"list_filter(list_transform(list_transform(signals, lambda s: {halved}), lambda s: {lowered}), lambda s: NOT (s.confidence < {f(0.15)} AND (qn OR e)))"
    custom = config.patterns.custom
    moved = f"CASE WHEN text <> raw THEN list_transform(signals, lambda s: {but(spot='NULL::BIGINT', lost='s.lost OR s.spot IS NOT NULL')}) ELSE signals END"
    return f"""{PROMPTS},
a0 AS (SELECT prompt_id, text AS raw, CASE WHEN text IS NULL THEN 'null_prompt' WHEN strlen(text) > {p.max_length} THEN 'prompt_too_long' END AS error FROM prompts),
a1 AS (SELECT prompt_id, raw, error, CASE WHEN error IS NULL AND raw <> '' THEN {first_bytes('t2', p.max_length)} END AS text FROM {text}),
opened AS (SELECT prompt_id, raw, text FROM a1 WHERE text IS NOT NULL),
readings AS (SELECT prompt_id, 0::BIGINT AS k, text FROM opened UNION ALL SELECT prompt_id, unnest(range(1, len(vs) + 1)) AS k, unnest(vs) AS text FROM (SELECT prompt_id, {READINGS} AS vs FROM opened)),
{matches(level, config.patterns.categories, 'readings', 'prompt_id, k, text', custom)},
hits AS ({confidence_sql('SELECT prompt_id, k, h.n AS n, h.category AS category, h.kind AS kind, h.m AS content, instr(text, h.m) AS place FROM found', level)}),
scan AS (SELECT prompt_id, array_agg({own} ORDER BY n) FILTER (k = 0) AS own, array_agg({read} ORDER BY k, n) FILTER (k > 0) AS read FROM hits GROUP BY prompt_id),
felt AS (SELECT prompt_id, raw, text, {damped_sql('found', 'b', lambda c: but(confidence=c))} AS felt, {kw} AS said FROM (SELECT *, {present(fired)} AS found FROM ({valued}))),
every AS (SELECT prompt_id, raw, text, list_concat(COALESCE(own, {none}), felt, said, COALESCE(read, {none})) AS signals FROM felt LEFT JOIN scan USING (prompt_id)),
combined AS (SELECT prompt_id, raw, text, list_concat(signals, {present(combos)}) AS signals, {QUESTION} AS qn, {EDUCATIONAL} AS e FROM (SELECT *, {MEAN} AS m, list_transform(signals, lambda s: s.kind) AS kinds, list_transform(signals, lambda s: {TYPE}) AS types FROM every)),
filtered AS (SELECT prompt_id, raw, text, {context} AS signals FROM combined),
analysed AS (SELECT a1.prompt_id AS prompt_id, a1.raw AS raw, a1.error AS error, a1.text AS text, COALESCE(CASE WHEN filtered.text IS NOT NULL THEN filtered.signals END, {none}) AS signals FROM a1 LEFT JOIN filtered USING (prompt_id)),
risks AS (SELECT prompt_id, n, score, top, {risk_sql(level)} AS risk FROM ({scored(level, 'analysed', TYPE)})),
judged AS (SELECT analysed.* EXCLUDE (signals), {moved} AS signals, n, score, top, risk FROM analysed JOIN risks USING (prompt_id))"""


def label(risk: str) -> str:
    return f"[{', '.join(q(r) for r in RISKS)}][({risk}) + 1]"


def analysis_sql(config: DetectorConfig) -> str:
    kinds = f"array_to_string(list_sort(list_distinct(list_transform(signals, lambda s: {TYPE}))), ',')"
    ok = lambda sql: f"CASE WHEN error IS NULL THEN {sql} END"
    flagged = sanitized_sql("SELECT * FROM judged WHERE error IS NULL AND risk >= 2", "raw", "signals", config.level.value, config.preprocessing.max_length)
    return f"""WITH {analysis_ctes(config)},
cleaned AS ({flagged})
SELECT judged.prompt_id AS prompt_id, judged.error AS error, {ok(label('judged.risk')).replace('error IS', 'judged.error IS')} AS risk_label, CASE WHEN judged.error IS NULL THEN round(judged.top::DOUBLE, 4) END AS confidence,
  CASE WHEN judged.error IS NULL THEN judged.risk >= 2 END AS injection_detected, CASE WHEN judged.error IS NULL THEN len(judged.signals)::INT END AS n_signals,
  CASE WHEN judged.error IS NULL THEN {kinds.replace('(signals', '(judged.signals')} END AS kinds, cleaned.clean AS mitigated_prompt
FROM judged LEFT JOIN cleaned USING (prompt_id)"""


def preset_sql() -> str:
    """Labels of every preset, each in a query of its own."""
    each = [f"SELECT * FROM (WITH {analysis_ctes(p.config())} SELECT {q(p.value)} AS preset, CASE WHEN error IS NULL THEN {label('risk')} END AS risk_label, count(*) AS n FROM judged GROUP BY 2)" for p in Preset]
    return " UNION ALL ".join(each)


def calibration_sql(of) -> str:
    """An analysis of its own for each level."""
    ok = lambda sql: f"CASE WHEN error IS NULL THEN {sql} END"
    each = [f"SELECT * FROM (WITH {analysis_ctes(of(v))} SELECT prompt_id, {v} AS level, {ok('round(score::DOUBLE, 4)')} AS score, {ok('risk >= 2')} AS flagged FROM judged)" for v in range(11)]
    return " UNION ALL ".join(each)


#: Texts that hold the first three words of a benchmark item, white space between them.
RULE_TABLE = f"""WITH {PROMPTS}, rules AS (SELECT item_id AS rule_id, '(?i)' || array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:3], '\\s+') AS rx FROM benchmark WHERE len(regexp_extract_all(text, '[A-Za-z]+')) > 0)
SELECT prompt_id, rule_id, regexp_extract(text, rx, 0) AS content FROM prompts JOIN rules ON regexp_matches(text, rx)"""


def fixed_sanitized_sql(level: int = 5) -> str:
    """The sanitizing response to the signals that follow from the id."""
    signals = f"list_transform(signals, lambda s: {signal('s.kind', 's.confidence', category='s.category')})"
    return f"WITH {PROMPTS}, {SIGNALS} SELECT prompt_id, clean AS out, abs(prompt_id) % 5 >= 2 AS would FROM ({sanitized_sql('SELECT * FROM signals', 'text', signals, level)})"


def scanned_sanitized_sql(level: int = 5) -> str:
    """Strategies of the dictionary's signals."""
    own = signal("kind", "confidence", category="category", place="place", m="content")
    hits = confidence_sql("SELECT prompt_id, text, h.n AS n, h.category AS category, h.kind AS kind, h.m AS content, instr(text, h.m) AS place FROM found", level)
    return f"WITH {PROMPTS}, {matches(level)}, hits AS ({hits}), s AS (SELECT prompt_id, any_value(text) AS text, array_agg({own} ORDER BY n) AS signals FROM hits GROUP BY prompt_id) SELECT prompt_id, clean AS out FROM ({sanitized_sql('SELECT * FROM s', 'text', 'signals', level)})"


def span_sql(config: DetectorConfig) -> str:
    """Signals with a place, those moved by preprocessing, and those of decoded readings."""
    count = lambda met: f"len(list_filter(signals, lambda s: {met}))::INT"
    # before places are lost to preprocessing, a decoded reading's signal is the one that has lost its own
    return f"""WITH {analysis_ctes(config)}
SELECT prompt_id, {count("s.spot IS NOT NULL")} AS placed, CASE WHEN analysed.text <> raw THEN (SELECT {count("s.spot IS NOT NULL").replace("signals", "analysed.signals")}) ELSE 0 END AS moved,
  (SELECT {count("s.lost").replace("signals", "analysed.signals")}) AS decoded
FROM judged JOIN (SELECT prompt_id, text, signals FROM analysed) analysed USING (prompt_id) WHERE error IS NULL""".replace("SELECT prompt_id, len(list_filter(signals,", "SELECT prompt_id, len(list_filter(judged.signals,")


def sql() -> dict[str, str]:
    from grainmill.plans.config import ConfigBuilder

    of = lambda level: ConfigBuilder().with_security_level(level).with_response("sanitize").build()
    return {"src_prompt": analysis_sql(of(5)), "analyze_full": analysis_sql(of(10)), "preset_grid": preset_sql(), "level_calibration": calibration_sql(of), "pat_rule_table": RULE_TABLE, "m_sanitize": fixed_sanitized_sql(), "san_pipeline": scanned_sanitized_sql(),
        "span_null": span_sql(of(5)), 
    }
