"""Analyses brought up to a new policy: only texts that are new, or that the change can touch, are analysed again."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.base import let
from grainmill.functions.levels import SecurityLevel
from grainmill.functions.store import settled
from grainmill.operators import mitigate, preprocess, variants
from grainmill.operators.patterns import Matcher

from .config import DetectorConfig, Patterns
from .detector import Detector
from .policy import Policy

#: What an analysis of a text is kept as, beside its hash and the policy's marker.
KEPT = ("error", "risk_level", "risk_label", "confidence", "score", "injection_detected", "signals", "mitigated_prompt")


def text_hash(text: Column) -> Column:
    """SHA-256 of a text, as prompts are an adversary's; empty for a null one, which is a text of its own."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


@dataclass(frozen=True)
class Change:
    """What a new configuration can change in analyses by an old one."""

    everything: bool
    rules: tuple[str, ...]
    response: bool

    @classmethod
    def between(cls, old: DetectorConfig, new: DetectorConfig) -> Change:
        """Rules that only one of them has, by category, place and pattern; a difference in level, folding of letters, preprocessing or keyword checks touches every text."""
        plain = lambda c: (c.level.value, c.patterns.case_sensitive, c.preprocessing, c.keywords)
        ruled = lambda c: {rule: raw for rule, raw in zip(c.matcher().rules, c.matcher().raw())}
        a, b = ruled(old), ruled(new)
        only = dict.fromkeys({**a, **b}[r] for r in sorted(a.keys() ^ b.keys()))
        return cls(plain(old) != plain(new), tuple(only), old.response != new.response)

    def touched(self, text: Column, config: DetectorConfig) -> Column:
        """Whether a rule that differs matches the text or one of its readings. Without one, both find the same signals: all else is made of those and the text."""
        if self.everything or not self.rules:
            return F.lit(self.everything)
        m = Matcher(SecurityLevel(0), (), self.rules, config.patterns.case_sensitive, len(self.rules))
        hit = lambda t: F.exists(F.concat(F.array(t), variants.decoded_variants(t)), lambda x: F.size(m.codes(x)) > 0)
        ok = text.isNotNull() & ~preprocess.too_long(text, config.preprocessing) & (text != "")
        return F.coalesce(F.when(ok, let(preprocess.preprocess(text, config.preprocessing), hit)), F.lit(False))


def update(prompts: DataFrame, kept: DataFrame | None, old: Policy | None, new: Policy, prompt_id: str = "prompt_id", text: str = "text", selector: mitigate.Selector | None = None) -> DataFrame:
    """(text_hash, marker, what an analysis has, reanalysed): a row for each distinct text of ``prompts``, as a full run by ``new`` gives.

    ``kept``: what an earlier call returned; its rows by the marker of ``old`` are carried on
    where nothing that changed can touch them. Texts that are gone are left out. Without ``kept``, or with none by that marker,
    every text is analysed. Null and empty texts are texts; ids may be null or repeat.

    Hashes and verdicts are exchanged, once for each distinct text of a task; texts only
    where they are analysed, met by their id and hash, so a text that very many prompts
    share is no hot key. Write what is returned to a table of its own before the next call.
    """
    config, marker = new.detector_config(), new.marker()
    change = Change.between(old.detector_config(), config) if kept is not None else Change(True, (), False)
    mine = prompts.select(F.col(prompt_id).alias("_id"), F.col(text).alias("_text"), text_hash(F.col(text)).alias("text_hash"))
    each = mine.withColumn("_touched", change.touched(F.col("_text"), config)).groupBy("text_hash").agg(F.bool_or("_touched").alias("_touched"), F.min("_id").alias("_id"))
    if kept is None:
        before, status = None, each.withColumn("_need", F.lit(True))
    else:
        before = kept.where(F.col("marker") == old.marker()).select("text_hash", *KEPT)
        known = before.select("text_hash", F.lit(True).alias("_known"), F.coalesce("injection_detected", F.lit(False)).alias("_flagged"))
        need = F.col("_known").isNull() | F.col("_touched") | (F.col("_flagged") if change.response else F.lit(False))
        status = each.join(known, "text_hash", "left").withColumn("_need", need)
    status = settled(status.select("text_hash", "_id", "_need"))
    todo = status.where("_need").select("text_hash", F.col("_id").alias("_of"))
    meet = (mine["text_hash"] == todo["text_hash"]) & mine["_id"].eqNullSafe(todo["_of"])
    texts = mine.join(todo, meet, "left_semi").dropDuplicates(["text_hash"]).select("text_hash", "_text")
    fresh = Detector(config, selector or mitigate.Selector()).analyze(texts, "_text").select("text_hash", F.lit(marker).alias("marker"), *KEPT, F.lit(True).alias("reanalysed"))
    if before is None:
        return fresh
    same = before.join(status.where("NOT _need").select("text_hash"), "text_hash", "left_semi")
    return fresh.unionByName(same.select("text_hash", F.lit(marker).alias("marker"), *KEPT, F.lit(False).alias("reanalysed")))


def of_prompts(prompts: DataFrame, results: DataFrame, text: str = "text") -> DataFrame:
    """Every prompt with the analysis of its text; columns named as what an analysis has are replaced."""
    made = {*KEPT, "marker", "reanalysed", "text_hash"}
    p = prompts.select(*[c for c in prompts.columns if c not in made], text_hash(F.col(text)).alias("text_hash"))
    return p.join(results, "text_hash", "left").drop("text_hash")


def with_rules(policy: Policy, categories: tuple[str, ...] | None = None, custom: tuple[str, ...] = ()) -> Policy:
    """The policy with other rules."""
    return replace(policy, config=replace(policy.config, patterns=replace(policy.config.patterns or Patterns(), categories=categories, custom=custom)))
