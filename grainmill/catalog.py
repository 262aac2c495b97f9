"""Every query of the engine: an operator each over all documents and the fixed phrases, or over the tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill import oracle_analysis, oracle_ordered, oracles
from grainmill.functions import codec, text as tx
from grainmill.functions.base import f32, java, let, truncate_bytes
from grainmill.functions.levels import CATEGORIES, SecurityLevel
from grainmill.functions.store import settled
from grainmill.operators import combine, heuristics, keywords, metrics, mitigate, partials, preprocess, scoring, variants
from grainmill.operators.asof import asof_join
from grainmill.operators.curves import curve_summary, threshold_curve
from grainmill.operators.patterns import Matcher
from grainmill.operators.rule_tables import match_rules
from grainmill.operators.signals import signal
from grainmill.operators.spans import coverage
from grainmill.plans.calibrate import calibrate
from grainmill.plans.config import ConfigBuilder, Preset
from grainmill.plans.detector import Detector, spread
from grainmill.plans.evidence import examine
from grainmill.plans.incremental import of_prompts, update, with_rules
from grainmill.plans.policy import Policy
from grainmill.sources.prompts import mixed_prompts
from grainmill.streaming.analyze import session_metrics, windowed_metrics
from grainmill.streaming.conversations import Escalation, escalate

Query = Callable[[SparkSession, str], DataFrame]
#: The rules that the query ``policy_update`` adds.
UPDATED_RULES = ("secret", "weather")


def num(c: Column) -> Column:
    return F.round(c.cast("double"), 4)


def scalar(make: Callable[[Column], Column]) -> Query:
    """(prompt_id, out) over the mixed prompts."""
    return lambda spark, d: mixed_prompts(spark, d).select("prompt_id", make(F.col("text")).alias("out"))


def fixed_signals(spark: SparkSession, d: str) -> DataFrame:
    """(prompt_id, text, signals): signals that follow from the id alone, so that any engine can make them."""
    key = F.abs("prompt_id")
    kinds = F.array(*[F.lit(k) for k in oracles.KINDS])
    conf = lambda i: (F.pmod(key * 7 + i * 13, F.lit(100)).cast("float") / f32(100.0)).cast("float")
    one = lambda k, i: signal("pattern", k, conf(i), category=F.get(F.array(*[F.lit(c) for c in oracles.SIGNAL_CATEGORIES]), i))
    chosen = F.filter(F.transform(kinds, lambda k, i: F.struct(one(k, i).alias("s"), F.floor(key / F.pow(F.lit(2), i)).cast("long").alias("b"))), lambda x: x["b"] % 2 == 1)
    return mixed_prompts(spark, d).select("prompt_id", "text", F.transform(chosen, lambda x: x["s"]).alias("signals"))


def over_signals(make: Callable[[Column, Column], Column]) -> Query:
    return lambda spark, d: fixed_signals(spark, d).select("prompt_id", make(F.col("signals"), F.col("text")).alias("out"))


def pattern_hits(category: str) -> Query:
    """The category's rules that match, a row each, with the first match and its confidence."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        m = Matcher(SecurityLevel(5), (category,))
        s = spread(mixed_prompts(spark, d)).select("prompt_id", F.explode(m.signals(F.col("text"), m.codes(F.col("text")))).alias("s"))
        return s.select("prompt_id", F.col("s.pattern_index").alias("pattern_index"), F.col("s.span.content").alias("content"), num(F.col("s.confidence")).alias("confidence"))

    return run


def pat_scan(spark: SparkSession, d: str) -> DataFrame:
    """All rules of level 5, exploded to one row a match."""
    m = Matcher(SecurityLevel(5))
    p = spread(mixed_prompts(spark, d))
    s = p.select("prompt_id", F.explode(m.signals(F.col("text"), m.codes(F.col("text")))).alias("s"))
    return s.select("prompt_id", F.col("s.category").alias("category"), F.col("s.pattern_index").alias("pattern_index"), F.col("s.span.start").alias("start"), F.col("s.span.end").alias("stop"))


def pat_scan_join(spark: SparkSession, d: str) -> DataFrame:
    """The relational form: prompts meet a table of rules by what the rules cannot do without."""
    m = Matcher(SecurityLevel(1))
    rules = spark.createDataFrame([(k, raw) for k, raw in enumerate(m.raw())], "rule_id int, pattern string")
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("rule_id"))
    found = match_rules(spread(mixed_prompts(spark, d)), rules).select(of([c for c, _, _ in m.rules]).alias("category"), of([i for _, i, _ in m.rules]).alias("i"))
    return found.groupBy("category", "i").agg(F.count("*").alias("n"))


def pat_rule_table(spark: SparkSession, d: str) -> DataFrame:
    """Rules made of the benchmark's items: the first three words of each, any white space between them."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    first = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), 1, 3)
    rules = items.select("item_id", F.array_join(first, r"\s+").alias("pattern")).where("pattern <> ''")
    return match_rules(spread(mixed_prompts(spark, d)), rules, rule_id="item_id").select("prompt_id", "rule_id", "content")


def pat_custom(spark: SparkSession, d: str) -> DataFrame:
    m = Matcher(SecurityLevel(0), custom=("secret\\s+handshake|weather", "abc"))
    p = mixed_prompts(spark, d)
    s = p.select("prompt_id", F.explode(m.signals(F.col("text"), m.codes(F.col("text")))).alias("s"))
    return s.select("prompt_id", F.col("s.pattern_index").alias("pattern_index"), F.col("s.span.content").alias("content"), F.col("s.custom_name").alias("custom_name"))


def pat_type_counts(spark: SparkSession, d: str) -> DataFrame:
    m = Matcher(SecurityLevel(3))
    p = spread(mixed_prompts(spark, d))
    return p.select(F.explode(m.signals(F.col("text"), m.codes(F.col("text")))).alias("s")).groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"))


def heuristic(name: str) -> Query:
    return lambda spark, d: (
        spread(mixed_prompts(spark, d))
        .select("prompt_id", heuristics.checks(F.col("text"), SecurityLevel(5))[name].alias("s"))
        .select("prompt_id", F.col("s").isNotNull().alias("fired"), num(F.col("s.confidence")).alias("confidence"))
    )


def keyword(make: Callable[[Column], Column]) -> Query:
    return lambda spark, d: mixed_prompts(spark, d).select("prompt_id", let(truncate_bytes(F.col("text"), 512), make).alias("s")).select("prompt_id", num(F.col("s.confidence")).alias("confidence"))


def listed(signals: Column) -> Column:
    return F.array_join(F.transform(signals, lambda s: F.format_string("%.3f", s["confidence"].cast("double"))), ",")


def combination(name: str) -> Query:
    return over_signals(lambda s, t: num(combine.combinations(s, t)[name]["confidence"]))


def level_grid(spark: SparkSession, d: str) -> DataFrame:
    """The fixed signals assessed at every level."""
    s = fixed_signals(spark, d)
    grid = F.array(*[F.struct(F.lit(v).alias("level"), scoring.assess(F.col("signals"), SecurityLevel(v)).alias("a")) for v in range(11)])
    return s.select("prompt_id", F.explode(grid).alias("g")).select("prompt_id", F.col("g.level").alias("level"), F.col("g.a.risk_level").cast("int").alias("risk"), num(F.col("g.a.score")).alias("score"))


def part_of_score(make: Callable[[Column, SecurityLevel], Column], level: int = 5) -> Query:
    return over_signals(lambda s, t: make(s, SecurityLevel(level)))


def analyses(spark: SparkSession, d: str, level: int = 5) -> DataFrame:
    return Detector(ConfigBuilder().with_security_level(level).with_response("sanitize").build()).analyze(spread(mixed_prompts(spark, d)))


def analyze_full(level: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        a = analyses(spark, d, level)
        kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("signals", combine.type_name))), ",")
        return a.select("prompt_id", "error", "risk_label", num(F.col("confidence")).alias("confidence"), "injection_detected", F.size("signals").alias("n_signals"), kinds.alias("kinds"), "mitigated_prompt")

    return run


def level_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Score and verdict of every prompt at every level; the texts are scanned once."""
    c = calibrate(spread(mixed_prompts(spark, d)).select("prompt_id", "text"))
    return c.select("prompt_id", "level", num(F.col("score")).alias("score"), F.col("injection_detected").alias("flagged"))


def preset_grid(spark: SparkSession, d: str) -> DataFrame:
    """Risk labels by preset, of every preset over every prompt; prompts that get an error have no label. The texts are scanned once, for all presets."""
    p = settled(examine(spread(mixed_prompts(spark, d)).select("prompt_id", "text"), [preset.config() for preset in Preset]))
    out = None
    for preset in Preset:
        a = Detector(preset.config()).analyze(p).groupBy("risk_label").agg(F.count("*").alias("n")).withColumn("preset", F.lit(preset.value))
        out = a if out is None else out.unionByName(a)
    return out


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events as analyses: value is the duration, the kind of event sets risk and detection."""
    e = spark.read.parquet(f"{d}/events.parquet")
    risk = (F.col("event_id") % 5).cast("int")
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").alias("recorded_at"), F.floor("value").cast("long").alias("duration_ms"), scoring.risk_label(risk).alias("risk_label"), (risk >= 2).alias("injection_detected"),
        ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.get(F.array(*[F.lit(k) for k in oracles.KINDS]), (F.col("event_id") % 8).cast("int")).alias("kind"),
    )


def a_totals(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.totals(events(spark, d))
    return t.select("total_analyzed", "injections_detected", "total_ms", "min_ms", "max_ms", F.round("avg_ms", 4).alias("avg_ms"), F.round("detection_rate", 6).alias("detection_rate"))


def a_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The row of all figures, with its nested ones as text and columns."""
    e = events(spark, d).withColumn("signals", F.array(signal("pattern", F.col("kind"), f32(0.5))))
    s = metrics.snapshot(e)
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string"))), ",").alias(c)
    stats = [F.round(F.col("confidence_stats")[c], 6).alias(c) for c in ("avg_positive", "avg_negative", "min_confidence", "max_confidence", "std_dev")]
    return s.select("total_analyzed", "injections_detected", "total_ms", "min_ms", "max_ms", F.round("avg_ms", 4).alias("avg_ms"), F.round("detection_rate", 6).alias("detection_rate"), shown("risk_levels"), shown("threat_types"), *stats, "percentiles.*")


def a_threat(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_threat(events(spark, d).withColumn("signals", F.array(signal("pattern", F.col("kind"), f32(0.5)))))


def a_conf(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.confidence_stats(events(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def a_label_eval(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("seq"), (F.col("toxic") == 0).alias("expected_safe"))
    e = metrics.label_evaluation(events(spark, d), labels, "seq")
    return e.select("n", "true_positives", "false_positives", "false_negatives", "true_negatives", *[F.round(c, 6).alias(c) for c in ("false_positive_rate", "false_negative_rate")])


def helper_pair(make: Callable[[Column, Column], Column]) -> Query:
    """Over each prompt and its document's source name."""
    return lambda spark, d: mixed_prompts(spark, d).select("prompt_id", make(F.col("text"), F.concat(F.col("source"), F.lit(" instructions"))).alias("out"))


def named_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The first match of each named pattern; empty without one."""
    p = mixed_prompts(spark, d)
    return p.select("prompt_id", *[F.regexp_extract("text", java(rx, False), 0).alias(k) for k, rx in tx.NAMED.items()])


def events_by_type(spark: SparkSession, d: str) -> DataFrame:
    return tx.group_and_count(spark.read.parquet(f"{d}/events.parquet"), "event_type")


def conv_first_flagged(spark: SparkSession, d: str) -> DataFrame:
    """The first turn of each conversation that a rule of level 1 matches."""
    m = Matcher(SecurityLevel(1))
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.where(F.size(m.codes(F.col("text"))) > 0).groupBy("conv_id").agg(F.min("turn").alias("first_turn"))


def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and questions by source, with a total."""
    p = mixed_prompts(spark, d).withColumn("q", preprocess.is_question(F.col("text")))
    return p.rollup("source").agg(F.count("*").alias("n"), F.count_if("q").alias("questions"))


def no_signal_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that no rule of level 1 matches."""
    m = Matcher(SecurityLevel(1))
    p = mixed_prompts(spark, d)
    hit = p.where(F.size(m.codes(F.col("text"))) > 0).select("prompt_id").distinct()
    return p.join(hit, "prompt_id", "left_anti").select("prompt_id")


def strategies(spark: SparkSession, d: str) -> DataFrame:
    """Each way to transform a text."""
    S = mitigate.Strategy
    each = {"remove": S("remove"), "replace": S("replace", "[X]"), "encode": S("encode"), "prefix": S("prefix", "<<"), "suffix": S("suffix", ">>"), "wrap": S("wrap", "(", ")"), "custom": S("custom", "was: {original}")}
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), s.apply(F.col("text")).alias("out"), F.lit(s.preserves_content).alias("preserves"), F.lit(s.removes_threat).alias("removes")) for k, s in each.items()])
    return mixed_prompts(spark, d).select("prompt_id", F.explode(rows).alias("r")).select("prompt_id", "r.*")


def default_strategies(selected: bool) -> Query:
    """What each kind's default, or the selector's choice, makes of a text."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        sel = mitigate.Selector()
        of = (lambda k: sel.of(k)) if selected else (lambda k: mitigate.DEFAULTS[k])
        rows = F.array(*[F.struct(F.lit(k).alias("kind"), of(k).apply(F.col("text")).alias("out")) for k in mitigate.DEFAULTS])
        return mixed_prompts(spark, d).select("prompt_id", F.explode(rows).alias("r")).select("prompt_id", "r.*")

    return run


def respond(kind: str, message: str = "") -> Query:
    r = mitigate.Response(kind, message)

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = fixed_signals(spark, d)
        risk = (F.abs("prompt_id") % 5).cast("byte")
        return s.select("prompt_id", mitigate.respond(F.col("text"), F.col("signals"), risk, r, SecurityLevel(5), 10_000).alias("out"), r.would_mitigate(scoring.is_injection(risk)).alias("would"))

    return run


def sanitized(spark: SparkSession, d: str) -> DataFrame:
    """Local and global strategies folded over real signals."""
    m = Matcher(SecurityLevel(5))
    found = F.array(m.signals(F.col("text"), m.codes(F.col("text"))))
    # exploded, as the optimizer would scan each text for a filter's sake once more
    p = spread(mixed_prompts(spark, d)).select("prompt_id", "text", F.explode(F.filter(found, lambda s: F.size(s) > 0)).alias("s"))
    return p.select("prompt_id", mitigate.sanitize(F.col("text"), F.col("s")).alias("out"))


def a_windowed(spark: SparkSession, d: str) -> DataFrame:
    """The streaming aggregate over a table."""
    w = windowed_metrics(events(spark, d).withColumn("error", F.lit(None).cast("string")), width="1 hour")
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "risk_label", "n", "injections", F.round("avg_confidence", 6).alias("avg_confidence"))


def a_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Hours that begin every quarter of one."""
    w = windowed_metrics(events(spark, d).withColumn("error", F.lit(None).cast("string")), width="1 hour", slide="15 minutes")
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "risk_label", "n", "injections", F.round("avg_confidence", 6).alias("avg_confidence"))


def a_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each kind's events with less than an hour between neighbours."""
    s = session_metrics(events(spark, d).withColumn("error", F.lit(None).cast("string")), ("kind",), gap="1 hour", seq=("seq",))
    return s.select("kind", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), F.date_format("window.end", "yyyy-MM-dd HH:mm:ss").alias("ended"), "n", "injections", "most_confidence")


def conv_escalation(spark: SparkSession, d: str) -> DataFrame:
    """Risk over the turns: a question adds a quarter, and each rule of level 1 that matches another, up to a half."""
    m = Matcher(SecurityLevel(1))
    c = spark.read.parquet(f"{d}/conversations.parquet")
    risk = F.when(preprocess.is_question(F.col("text")), 0.25).otherwise(0.0) + F.least(F.lit(0.5), F.size(m.codes(F.col("text"))) * 0.25)
    e = escalate(c.select("conv_id", "turn", F.coalesce(risk, F.lit(0.0)).alias("risk")), Escalation(decay=0.5, most=1.0, alarm=0.4))
    return e.select("conv_id", "turn", F.round("risk", 6).alias("risk"), F.round("running", 6).alias("running"), "escalated")


def a_partials(spark: SparkSession, d: str) -> DataFrame:
    """Hourly states by kind, folded to days."""
    hours = partials.states(events(spark, d), {"hour": F.date_trunc("hour", "recorded_at"), "kind": F.col("kind")})
    f = partials.figures(partials.fold(hours, {"day": F.to_date("hour")}), ("day",))
    rounded = ("avg_ms", "std_ms", "detection_rate", "avg_positive", "avg_negative", "std_dev")
    return f.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "total_analyzed", "injections_detected", "total_ms", "min_ms", "max_ms", *[F.round(c, 9).alias(c) for c in rounded])


def policy_asof(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the policy in force for its user: each error event puts one in force, whose level follows from its id."""
    e = spark.read.parquet(f"{d}/events.parquet")
    history = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("policy_id"), (F.col("event_id") % 11).alias("level"))
    return asof_join(e.select("event_id", "user_id", "ts"), history, ("user_id",), "ts", "since", ("policy_id", "level"), ("policy_id",)).select("event_id", "policy_id", "level")


def span_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each prompt, what the dictionary's matches cover, by category and by all together."""
    spans = pat_scan(spark, d).select("prompt_id", F.explode(F.array("category", F.lit("*"))).alias("category"), "start", "stop")
    return coverage(spans, ("prompt_id", "category"))


def policy_update(spark: SparkSession, d: str) -> DataFrame:
    """Analyses by a policy of level 1, brought up to one with two rules more."""
    p = spread(mixed_prompts(spark, d))
    first = Policy("first", config=ConfigBuilder().with_security_level(1).with_response("sanitize").build())
    then = with_rules(first, custom=UPDATED_RULES)
    a = of_prompts(p, update(p, settled(update(p, None, None, first)), first, then))
    return a.select("prompt_id", "error", "risk_label", num(F.col("confidence")).alias("confidence"), "injection_detected", F.size("signals").alias("n_signals"), "mitigated_prompt")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("seq"), (F.col("toxic") == 1).alias("positive"))
    return events(spark, d).join(labels, "seq")


def a_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Events against labels at every threshold, by kind."""
    c = threshold_curve(labelled(spark, d), ("kind",), "confidence")
    return c.select("kind", "threshold", "true_positives", "false_positives", "false_negatives", "true_negatives", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


def label_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The analysis of every labelled document against its label, by source: rank statistic and best threshold."""
    a = analyses(spark, d).where("error is null").select(F.col("prompt_id").alias("doc_id"), "source", num(F.col("score")).alias("score"))
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", (F.col("toxic") == 1).alias("positive"))
    # the analysis is a large plan: it is run by itself
    s = curve_summary(threshold_curve(settled(a).join(labels, "doc_id"), ("source",)), ("source",))
    return s.select("source", "positives", "negatives", *[F.round(x, 6).alias(x) for x in ("auc", "best_threshold", "best_f1")])


def span_null(spark: SparkSession, d: str) -> DataFrame:
    """How many signals of the analysis have a place in the prompt, and how many lost it and why."""
    a = analyses(spark, d).where("error is null")
    count = lambda f: F.size(F.filter("signals", f))
    lost = lambda why: count(lambda s: s["span_omitted"] == why)
    return a.select("prompt_id", count(lambda s: s["span"].isNotNull()).alias("placed"), lost("preprocessing_changed_coordinates").alias("moved"), lost("decoded_variant_coordinates").alias("decoded"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full analysis at level 5 of the mixed prompts."""
    return analyze_full(5)(spark, sf_dir)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "pred_empty": scalar(lambda t: t == ""),
        "pred_maxlen": scalar(lambda t: preprocess.too_long(t, preprocess.Preprocessing())),
        "pre_ctrl": scalar(preprocess.drop_controls),
        "pre_url": scalar(codec.percent_decode),
        "pre_b64": scalar(preprocess.base64_whole),
        "pre_trunc": scalar(lambda t: truncate_bytes(t, 101)),
        "pre_full": scalar(preprocess.preprocess),
        "q_question": scalar(preprocess.is_question),
        "q_educational": scalar(preprocess.is_educational),
        "q_benign_flag": scalar(preprocess.looks_benign),
        "pat_scan": pat_scan,
        "pat_scan_join": pat_scan_join,
        "pat_rule_table": pat_rule_table,
        "pat_custom": pat_custom,
        "pat_type_counts": pat_type_counts,
        "h_benign": scalar(lambda t: num(heuristics.benign_score(t))),
        "h_adjust": lambda spark, d: fixed_signals(spark, d).select("prompt_id", listed(let(heuristics.benign_score(F.col("text")), lambda b: heuristics.damp(F.col("signals"), b))).alias("out")),
        "s_confusion": keyword(lambda t: F.coalesce(*keywords.confusion(t, 0.1))),
        "s_intent": keyword(lambda t: keywords.intent(t, 0.1)),
        "s_switch": keyword(lambda t: keywords.switches(t, 0.1)),
        "v_url": scalar(variants.url_variant),
        "v_b64": scalar(variants.base64_variant),
        "v_b64frag": scalar(lambda t: F.array_join(variants.base64_fragments(t), "|")),
        "v_hex": scalar(variants.hex_variant),
        "v_rot13": scalar(variants.rot13_variant),
        "v_ctrl": scalar(variants.control_variant),
        "v_dedup": scalar(lambda t: F.array_join(variants.decoded_variants(t), "|")),
        "f_context": lambda spark, d: fixed_signals(spark, d).select(
            "prompt_id", F.array_join(F.transform(combine.filter_by_context(F.col("signals"), preprocess.is_question(F.col("text")), preprocess.is_educational(F.col("text"))), lambda s: F.format_string("%.3f", s["confidence"].cast("double"))), ",").alias("out")
        ),
        "f_question": over_signals(lambda s, t: listed(combine.halve_in_questions(s, preprocess.is_question(t)))),
        "f_edu": over_signals(lambda s, t: listed(combine.lower_in_lessons(s, preprocess.is_educational(t)))),
        "f_drop": over_signals(lambda s, t: listed(combine.drop_faint(s, preprocess.is_question(t) | preprocess.is_educational(t)))),
        "r_level": part_of_score(lambda s, v: F.when(F.size(s) > 0, scoring.risk_label(scoring.risk_of(scoring.score(s, v)["score"], v))), 7),
        "r_none": over_signals(lambda s, t: F.when(F.size(s) == 0, num(scoring.score(s, SecurityLevel(5))["confidence"]))),
        "r_catadj": part_of_score(lambda s, v: F.array_join(F.transform(s, lambda x: F.format_string("%.3f", scoring.adjusted(x, v).cast("double"))), ",")),
        "r_weighted": part_of_score(lambda s, v: num(scoring.score(s, v)["score"])),
        "r_level_grid": level_grid,
        "r_floor": part_of_score(lambda s, v: scoring.assess(s, v)["risk_level"].cast("int"), 2),
        "r_conf": part_of_score(lambda s, v: num(scoring.score(s, v)["confidence"])),
        "r_top": over_signals(lambda s, t: scoring.top_signal(s)["kind"]),
        "r_diversity": over_signals(lambda s, t: F.size(F.array_distinct(F.transform(s, combine.type_name)))),
        "m_allow": respond("allow"), "m_block": respond("block"), "m_warn": respond("warn"), "m_custom": respond("custom", "Please rephrase."), "m_sanitize": respond("sanitize"),
        "ms_apply": strategies,
        "ms_encode": scalar(mitigate.encode_specials),
        "ms_default": default_strategies(False),
        "ms_select": default_strategies(True),
        "san_pipeline": sanitized,
        "san_dec": scalar(mitigate.sanitize_encodings),
        "san_se": scalar(mitigate.soften_social),
        "san_general": scalar(lambda t: mitigate.sanitize_general(t, True)),
        "san_cleanup": scalar(lambda t: mitigate.clean_up(t, 200)),
        "a_totals": a_totals,
        "a_rate_pct": lambda s, d: metrics.detection_rate_percent(metrics.totals(events(s, d))).select(F.round("detection_rate_percent", 4).alias("detection_rate_percent")),
        "a_risk": lambda s, d: metrics.by_risk(events(s, d)),
        "a_threat": a_threat,
        "a_conf": a_conf,
        "a_pct": lambda s, d: metrics.percentiles(events(s, d)),
        "a_retain": lambda s, d: metrics.retained(events(s, d)).select("seq"),
        "a_snapshot": a_snapshot,
        "a_windowed": a_windowed,
        "a_sliding": a_sliding,
        "a_sessions": a_sessions,
        "a_partials": a_partials,
        "a_thresholds": a_thresholds,
        "label_thresholds": label_thresholds,
        "policy_asof": policy_asof,
        "policy_update": policy_update,
        "conv_escalation": conv_escalation,
        "span_coverage": span_coverage,
        "span_null": span_null,
        "a_label_eval": a_label_eval,
        "u_norm": scalar(tx.normalize),
        "u_lev": helper_pair(tx.distance),
        "u_sim": helper_pair(lambda a, b: F.round(tx.similarity(a, b), 6)),
        "u_words": scalar(lambda t: F.array_join(tx.extract_words(t, 4), " ")),
        "u_entropy": scalar(lambda t: F.round(tx.entropy(t), 6)),
        "u_repeat": lambda s, d: spread(mixed_prompts(s, d)).select("prompt_id", tx.has_repeat(F.col("text"), 3).alias("out")),
        "u_isb64": scalar(tx.is_base64),
        "u_ishex": scalar(tx.is_hex),
        "u_urldec": scalar(tx.url_decode_latin),
        "u_detect": scalar(lambda t: F.array_join(tx.detect_encodings(t), ",")),
        "u_rx": named_patterns,
        "u_valid": scalar(lambda t: F.concat_ws(",", tx.valid_length(t, 1, 1000).cast("string"), tx.safe_characters(t).cast("string"), tx.valid_email(t).cast("string"), tx.valid_url(t).cast("string"))),
        "u_group": events_by_type,
        "u_mode": lambda s, d: tx.most_common(s.read.parquet(f"{d}/events.parquet"), "event_type"),
        "u_pctl": lambda s, d: tx.rank_percentiles(events(s, d), "duration_ms", (50, 90, 95, 99)),
        "u_time": lambda s, d: events(s, d).select("seq", tx.format_duration(F.col("duration_ms") * 997).alias("out")),
        "t_severity": over_signals(lambda s, t: F.array_join(F.transform(s, lambda x: tx.severity_bucket(x["confidence"])), ",")),
        "conv_first_flagged": conv_first_flagged,
        "source_rollup": source_rollup,
        "no_signal_antijoin": no_signal_antijoin,
        "preset_grid": preset_grid,
        "level_calibration": level_calibration,
        "src_prompt": analyze_full(5),
        "analyze_full": analyze_full(10),
    }
    q |= {f"pat_{c}": pattern_hits(c) for c in CATEGORIES}
    q |= {h: heuristic(h) for h in ("h_b64", "h_hex", "h_multi", "h_entropy", "h_special", "h_repeat", "h_punct", "h_format", "h_words", "h_caps", "h_rot13", "h_url", "h_unicode", "h_zw")}
    q |= {c: combination(c) for c in ("c_triple", "c_multi", "c_socjail", "c_ctxrole", "c_socdata", "c_authurg", "c_escal", "c_multistage")}
    return q


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (oracles.sql() | oracle_analysis.sql() | oracle_ordered.sql()).items() if k in queries()}
