"""Rules that come as a table, matched to prompts through an index of what each rule cannot do without."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.base import LOOKED_FOR, constant, fold_needed, held, java, looked_up, rules_by_string
from grainmill.functions.phrases import needed


#: Of a necessary string, so many characters are looked for.
GRAM = LOOKED_FOR


def match_rules(prompts: DataFrame, rules: DataFrame, text: str = "text", rule_id: str = "rule_id", pattern: str = "pattern", case_sensitive: bool = False, max_patterns: int = 3000) -> DataFrame:
    """The columns of ``prompts`` with ``rule_id`` and ``content`` (the rule's first match), a row for each rule that matches.

    The strings of which every match of a rule holds one are looked for in one pass over a text, all at once, and only rules so
    found are tried. The rules are broadcast: there are at most ``max_patterns``, and more are an error. Texts are
    read once; nothing is exchanged.

    Null texts match nothing; null ids stay; null patterns are no rules. Rules with one id are rules of
    their own. Columns of ``prompts`` named as the two new ones are replaced.
    """
    spark = prompts.sparkSession
    listed = rules.select(F.col(rule_id), F.col(pattern)).where(F.col(pattern).isNotNull()).limit(max_patterns + 1).collect()
    if len(listed) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns")
    compiled = [java(r[1], not case_sensitive) for r in listed]
    for rx in compiled:
        try:
            spark._jvm.java.util.regex.Pattern.compile(rx)
        except Exception as e:
            raise ValueError(f"pattern does not compile: {rx}") from e
    needs = [fold_needed(needed(r[1], True), GRAM) for r in listed]
    kept = [c for c in prompts.columns if c not in ("rule_id", "content")]
    # the caller's columns are set apart, so that none clashes
    p = prompts.select(*[F.col(f"`{c}`").alias(f"user_{i}") for i, c in enumerate(kept)])
    t = F.col(f"user_{kept.index(text)}")
    p = p.where(t.isNotNull())
    strings, rules_of = rules_by_string(needs)
    always = constant([k for k, n in enumerate(needs) if n is None], "array<int>")
    tried = F.concat(always, looked_up(held(t, strings), strings, rules_of)) if strings else always
    rule = spark.createDataFrame([(k, r[0], rx) for k, (r, rx) in enumerate(zip(listed, compiled))], rules.select(F.lit(0).alias("_k"), F.col(rule_id).alias("rule_id"), F.col(pattern).alias("_rx")).schema)
    met = p.withColumn("_k", F.explode(tried)).join(F.broadcast(rule), "_k").where(F.rlike(t, F.col("_rx")))
    return met.select(*[F.col(f"user_{i}").alias(c) for i, c in enumerate(kept)], "rule_id", F.regexp_substr(t, F.col("_rx")).alias("content"))
