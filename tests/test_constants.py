"""Categories, levels and presets against tables that are written out here."""

import duckdb

from grainmill.functions.levels import SecurityLevel
from grainmill.operators.patterns import Matcher
from grainmill.plans.config import Preset

#: Written out here, not taken from the engine: category, kind, rules, first level, base confidence (null: by level).
CATEGORY_ROWS = """
  ('advanced_instruction_override', 'InstructionOverride', 8, 7, 0.95), ('authority_manipulation_advanced', 'SocialEngineering', 10, 3, 0.85), ('compliance_testing_disguised', 'SocialEngineering', 10, 9, 0.7),
  ('context_breaking_advanced', 'ContextConfusion', 10, 9, 0.6), ('context_confusion', 'ContextConfusion', 20, 5, 0.85), ('context_hijacking_advanced', 'ContextConfusion', 10, 5, 0.85),
  ('dan_variations_comprehensive', 'Jailbreak', 10, 7, 0.98), ('data_extraction', 'DataExtraction', 20, 5, 0.9), ('encoding_bypass', 'EncodingBypass', 13, 5, NULL), ('encoding_bypass_comprehensive', 'EncodingBypass', 17, 5, NULL),
  ('evasion_techniques_advanced', 'ContextConfusion', 13, 7, 0.65), ('fake_system_messages_advanced', 'ContextConfusion', 10, 5, 0.85), ('gradual_escalation_patterns', 'SocialEngineering', 10, 7, 0.6),
  ('hypothetical_scenarios_advanced', 'ContextConfusion', 10, 5, 0.65), ('instruction_override', 'InstructionOverride', 22, 1, 0.95), ('jailbreak', 'Jailbreak', 25, 1, 0.98), ('jailbreak_comprehensive', 'Jailbreak', 9, 10, 0.98),
  ('memory_data_extraction_advanced', 'DataExtraction', 10, 7, 0.9), ('role_playing', 'RolePlaying', 20, 5, 0.8), ('role_playing_comprehensive', 'RolePlaying', 7, 5, 0.8), ('social_engineering', 'SocialEngineering', 22, 3, 0.7),
  ('social_engineering_comprehensive', 'SocialEngineering', 12, 3, 0.7), ('trust_manipulation_advanced', 'SocialEngineering', 10, 7, 0.7), ('urgency_manipulation_advanced', 'SocialEngineering', 10, 7, 0.75)"""
CATEGORY_TABLE = f"c(category, kind, rules, first, base) AS (VALUES {CATEGORY_ROWS})"
LEVEL_TABLE = """
SELECT v AS level, round(least(greatest(0.95 - v * 0.08, 0.15), 0.95)::DOUBLE, 5) AS base_threshold, round((1 + v * 0.15)::DOUBLE, 5) AS pattern_weight, round((1 + v * 0.2)::DOUBLE, 5) AS multiplier, round(((11 - v) / 100)::DOUBLE, 5) AS benign,
  round(greatest(0.98 - v * 0.06, 0.35)::DOUBLE, 5) AS critical, round(greatest(0.90 - v * 0.05, 0.30)::DOUBLE, 5) AS high, round(greatest(0.80 - v * 0.04, 0.25)::DOUBLE, 5) AS medium, round(greatest(0.70 - v * 0.035, 0.20)::DOUBLE, 5) AS low,
  CASE WHEN v <= 2 THEN 3 WHEN v <= 5 THEN 2 WHEN v <= 8 THEN 1 ELSE 0 END AS floor, v >= 5 AS aggressive
FROM (SELECT range::INT AS v FROM range(11))"""
PRESET_TABLE = """
SELECT * FROM (VALUES
  ('ChatBot', 5, 'sanitize', 5000, FALSE, TRUE, 2, 2000, FALSE, 0.8::DOUBLE, 512, 200, 5::DOUBLE, 256, 1000), ('CodeAssistant', 4, 'warn', 20000, TRUE, TRUE, 2, 1500, FALSE, 0.85, 1024, 50, 15, 512, 500),
  ('CustomerService', 6, 'block', 3000, FALSE, TRUE, 2, 2500, FALSE, 0.75, 512, 100, 3, 256, 800), ('Educational', 3, 'sanitize', 10000, TRUE, TRUE, 2, 1000, FALSE, 0.8, 512, 150, 8, 384, 600),
  ('Financial', 9, 'block', 5000, TRUE, TRUE, 4, 5000, TRUE, 0.7, 1024, 25, 30, 1024, 2000), ('Healthcare', 8, 'block', 8000, TRUE, TRUE, 5, 4000, TRUE, 0.75, 1024, 50, 20, 768, 1500),
  ('Development', 2, 'allow', 50000, TRUE, FALSE, 2, 500, FALSE, 0.9, 256, 10, 2, 128, 200), ('Custom', 5, 'block', 10000, FALSE, TRUE, 0, 3000, FALSE, 0.8, 512, 100, 10, 512, 1000)
) p(preset, level, response, max_length, preserves, decodes, patterns, max_patterns, keywords, similarity, context, at_once, seconds, megabytes, kept)"""


def test_categories_of_every_level():
    want = duckdb.sql(f"WITH {CATEGORY_TABLE} SELECT range::INT AS level, category FROM range(11) JOIN c ON range >= first").fetchall()
    assert sorted(want) == sorted((v, c) for v in range(11) for c in SecurityLevel(v).categories)


def test_rules_kinds_and_bases():
    m = Matcher(SecurityLevel(10))
    want = duckdb.sql(f"WITH {CATEGORY_TABLE} SELECT category, kind, rules, COALESCE(base, 0.75)::DOUBLE FROM c").fetchall()
    assert sorted(want) == sorted((c, m.kind(c), sum(x == c for x, _, _ in m.rules), round(m.base(c), 4)) for c in m.names())


def test_what_levels_set():
    rows = [(x.value, *[round(v, 5) for v in (x.base_threshold, x.pattern_weight, x.combination_multiplier, x.benign_factor, *x.thresholds)], x.risk_floor, x.aggressive) for x in map(SecurityLevel, range(11))]
    assert sorted(duckdb.sql(LEVEL_TABLE).fetchall()) == rows


def test_what_presets_set():
    rows = []
    for p in Preset:
        c = p.config()
        rows.append((
            p.value, c.level.value, c.response.kind, c.preprocessing.max_length, c.preprocessing.preserve_formatting, c.preprocessing.decode_encodings, len(c.patterns.custom), c.patterns.max_patterns,
            c.keywords.enabled, c.keywords.similarity_threshold, c.keywords.max_context_length, c.resources.max_concurrent_analyses, float(c.resources.analysis_timeout_s), c.resources.max_memory_mb, c.resources.pattern_cache_size,
        ))
    assert sorted(tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in duckdb.sql(PRESET_TABLE).fetchall()) == sorted(rows)
