"""DuckDB's SQL of the queries over time, spans and thresholds: each says the result another way than the operator does."""

from __future__ import annotations

from grainmill.oracles import EVENTS

ASOF = """WITH history AS (SELECT user_id, ts AS since, max(event_id) AS policy_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts)
SELECT e.event_id, h.policy_id, h.policy_id % 11 AS level FROM events e ASOF LEFT JOIN history h ON e.user_id = h.user_id AND e.ts >= h.since"""

PARTIALS = f"""WITH {EVENTS} SELECT strftime(recorded_at, '%Y-%m-%d') AS day, count(*) AS total_analyzed, count_if(injection_detected) AS injections_detected, sum(duration_ms)::BIGINT AS total_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
  round(avg(duration_ms), 9) AS avg_ms, round(stddev_pop(duration_ms), 9) AS std_ms, round(count_if(injection_detected) / count(*)::DOUBLE, 9) AS detection_rate,
  coalesce(round(avg(confidence) FILTER (WHERE injection_detected), 9), 0.0::DOUBLE) AS avg_positive, coalesce(round(avg(confidence) FILTER (WHERE NOT injection_detected), 9), 0.0::DOUBLE) AS avg_negative, round(stddev_pop(confidence), 9) AS std_dev
FROM events_in GROUP BY 1"""


SLIDING = f"""WITH {EVENTS}, placed AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, recorded_at) - to_minutes(15 * unnest([0, 1, 2, 3])) AS began FROM events_in)
SELECT strftime(began, '%Y-%m-%d %H:%M') AS window_start, risk_label, count(*) AS n, count_if(injection_detected) AS injections, round(avg(confidence), 6) AS avg_confidence FROM placed GROUP BY 1, 2"""

SESSIONS = f"""WITH {EVENTS}, marked AS (SELECT *, coalesce(recorded_at - lag(recorded_at) OVER (PARTITION BY kind ORDER BY recorded_at, seq) >= INTERVAL 1 HOUR, TRUE) AS new FROM events_in),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY kind ORDER BY recorded_at, seq ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT kind, strftime(min(recorded_at), '%Y-%m-%d %H:%M:%S') AS began, strftime(max(recorded_at) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n, count_if(injection_detected) AS injections, max(confidence) AS most_confidence FROM runs GROUP BY kind, run"""


def escalation_sql() -> str:
    """Turn by turn; a text that no rule matches has no row in ``found``."""
    from grainmill.oracles import QUESTION, matches

    return f"""WITH RECURSIVE {matches(1, table='conversations', keep='conv_id, turn')}, hits AS (SELECT conv_id, turn, count(*) AS n FROM found GROUP BY 1, 2),
risks AS (SELECT conv_id, turn, max(coalesce(CASE WHEN {QUESTION} THEN 0.25 ELSE 0.0 END, 0.0) + least(0.5, 0.25 * coalesce(n, 0)))::DOUBLE AS risk FROM conversations LEFT JOIN hits USING (conv_id, turn) WHERE turn IS NOT NULL GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM risks),
told AS (SELECT conv_id, turn, k, risk, least(1.0::DOUBLE, greatest(0.0::DOUBLE, risk)) AS running FROM placed WHERE k = 1
  UNION ALL SELECT p.conv_id, p.turn, p.k, p.risk, least(1.0::DOUBLE, greatest(0.0::DOUBLE, t.running * 0.5 + p.risk)) FROM told t JOIN placed p ON p.conv_id = t.conv_id AND p.k = t.k + 1)
SELECT conv_id, turn, round(risk, 6) AS risk, round(running, 6) AS running, running >= 0.4::DOUBLE AS escalated FROM told"""


def coverage_sql(hits: str) -> str:
    """Unions as islands, and depths by counting at each start."""
    return f"""WITH hits AS ({hits}), spans AS (SELECT prompt_id, unnest([category, '*']) AS category, start, stop FROM hits),
once AS (SELECT DISTINCT * FROM spans), marked AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY prompt_id, category ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS new FROM once),
islands AS (SELECT *, sum(new::INT) OVER (PARTITION BY prompt_id, category ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM marked),
unions AS (SELECT prompt_id, category, sum(wide)::BIGINT AS covered FROM (SELECT prompt_id, category, island, max(stop) - min(start) AS wide FROM islands GROUP BY ALL) GROUP BY 1, 2),
counts AS (SELECT prompt_id, category, count(*) AS n FROM spans GROUP BY 1, 2),
depths AS (SELECT a.prompt_id, a.category, a.start, count(*) AS depth FROM (SELECT DISTINCT prompt_id, category, start FROM spans WHERE stop > start) a JOIN spans b ON a.prompt_id = b.prompt_id AND a.category = b.category AND b.start <= a.start AND a.start < b.stop GROUP BY ALL)
SELECT prompt_id, category, n, covered, coalesce(max(depth), 0) AS depth FROM unions JOIN counts USING (prompt_id, category) LEFT JOIN depths USING (prompt_id, category) GROUP BY ALL"""


def _curve(scored: str, by: str) -> str:
    """Every threshold against all rows."""
    return f"""scored AS ({scored}), steps AS (SELECT DISTINCT {by}, score AS threshold FROM scored WHERE score IS NOT NULL),
curve AS (SELECT {by}, threshold, count_if(positive AND score >= threshold) AS tp, count_if(NOT positive AND score >= threshold) AS fp, count_if(positive AND score < threshold) AS fn, count_if(NOT positive AND score < threshold) AS tn FROM steps JOIN scored USING ({by}) GROUP BY ALL)"""


def thresholds_sql() -> str:
    scored = "SELECT kind, confidence AS score, toxic = 1 AS positive FROM events_in JOIN labels ON seq = doc_id"
    return f"""WITH {EVENTS}, {_curve(scored, 'kind')} SELECT kind, threshold, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
round(tp / (tp + fp)::DOUBLE, 6) AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) END AS f1 FROM curve"""


def label_thresholds_sql(analysed: str) -> str:
    """``analysed``: (prompt_id, source, score) of prompts without an error. The rank statistic is a mean over pairs."""
    scored = f"SELECT a.source, a.score, l.toxic = 1 AS positive FROM ({analysed}) a JOIN labels l ON a.prompt_id = l.doc_id"
    return f"""WITH {_curve(scored, 'source')}, pairs AS (SELECT p.source, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc FROM scored p JOIN scored n ON p.source = n.source AND p.positive AND NOT n.positive GROUP BY 1),
best AS (SELECT source, arg_max(threshold, (f1, threshold)) AS best_threshold, max(f1) AS best_f1 FROM (SELECT source, threshold, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM curve WHERE tp + fn > 0) GROUP BY 1)
SELECT s.source, positives, negatives, round(auc, 6) AS auc, round(best_threshold, 6) AS best_threshold, round(best_f1, 6) AS best_f1
FROM (SELECT source, count_if(positive) AS positives, count_if(NOT positive) AS negatives FROM scored GROUP BY 1) s LEFT JOIN pairs USING (source) LEFT JOIN best USING (source)"""


def sql() -> dict[str, str]:
    from grainmill.oracle_analysis import analysis_ctes, analysis_sql
    from grainmill.oracles import sql as plain
    from grainmill.plans.config import ConfigBuilder

    five = ConfigBuilder().with_security_level(5).with_response("sanitize").build()
    # a run of everything by the later policy
    updated = analysis_sql(ConfigBuilder().with_security_level(1).with_response("sanitize").with_custom_patterns("secret", "weather").build())
    analysed = f"WITH {analysis_ctes(five)} SELECT judged.prompt_id, documents.source, round(judged.score::DOUBLE, 4) AS score FROM judged JOIN documents ON judged.prompt_id = documents.doc_id WHERE judged.error IS NULL"
    return {
        "a_sliding": SLIDING, "a_sessions": SESSIONS, "conv_escalation": escalation_sql(),
        "policy_update": f"SELECT * EXCLUDE (kinds) FROM ({updated})",
        "policy_asof": ASOF, "a_partials": PARTIALS, "span_coverage": coverage_sql(plain()["pat_scan"]), "a_thresholds": thresholds_sql(), "label_thresholds": label_thresholds_sql(analysed),
    }
