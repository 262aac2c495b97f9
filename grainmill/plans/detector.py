"""The whole analysis as one narrow plan: no row meets another, so it also runs on streams."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.base import let
from grainmill.operators import combine, heuristics, keywords, mitigate, preprocess, scoring, variants
from grainmill.operators.signals import none, with_fields

from .config import DetectorConfig
from .evidence import signals_of


@dataclass(frozen=True)
class Detector:
    """Turns prompts into analyses by one configuration."""

    config: DetectorConfig = DetectorConfig()
    selector: mitigate.Selector = mitigate.Selector()

    def reconfigured(self, config: DetectorConfig) -> Detector:
        """A detector by another configuration, if that is valid; else an error, and this one stays in use."""
        return replace(self, config=config.validate())

    def with_strategy(self, kind: str, strategy: mitigate.Strategy) -> Detector:
        return replace(self, selector=self.selector.with_strategy(kind, strategy))

    def signals(self, text: Column) -> Column:
        """All signals of a processed text, after the combinations and the filter by context."""
        cfg, matcher = self.config, self.config.matcher()

        def scanned(texts: Column) -> Column:
            """texts: the text, then its other readings. The dictionary is in the plan once, for all of them."""
            found = F.transform(texts, lambda t: F.struct(t.alias("t"), matcher.codes(t).alias("codes")))

            def gathered(f: Column) -> Column:
                own = F.flatten(F.transform(F.slice(f, 1, 1), lambda x: matcher.signals(x["t"], x["codes"])))
                read = F.flatten(F.transform(F.slice(f, 2, 1_000_000), lambda x: variants.decoded_signals(matcher.signals(x["t"], x["codes"]))))
                parts = [own, heuristics.heuristic_signals(text, cfg.level)]
                if cfg.keywords.enabled:
                    parts.append(keywords.keyword_signals(text, cfg.keywords.similarity_threshold, cfg.keywords.max_context_length))
                return F.concat(*parts, read)

            return let(found, gathered)

        every = let(F.concat(F.array(text), variants.decoded_variants(text)), scanned)
        combined = let(every, lambda s: F.concat(s, combine.combination_signals(s, text)))
        flags = F.struct(preprocess.is_question(text).alias("q"), preprocess.is_educational(text).alias("e"))
        return let(combined, lambda s: let(flags, lambda f: combine.filter_by_context(s, f["q"], f["e"])))

    def analyze(self, df: DataFrame, text: str = "text", keep_processed: bool = False) -> DataFrame:
        """``df`` with error, risk_level, risk_label, confidence, score, injection_detected, signals and mitigated_prompt.

        A null text has the error ``null_prompt`` and one beyond the length limit
        ``prompt_too_long``; those rows have no analysis. An empty text is safe. Columns of
        these names are replaced. Where ``evidence.examine`` has been over ``df``, what it found is used.
        """
        cfg = self.config.validate()
        made = ("error", "risk_level", "risk_label", "confidence", "score", "injection_detected", "signals", "mitigated_prompt")
        keep = [c for c in df.columns if c not in made]
        raw = F.col(text)
        error = F.when(raw.isNull(), "null_prompt").when(preprocess.too_long(raw, cfg.preprocessing), "prompt_too_long")
        a = df.select(*keep, error.alias("error"))
        open_ = F.col("error").isNull() & (raw != "")
        a = a.withColumn("_text", F.when(open_, preprocess.preprocess(raw, cfg.preprocessing)))
        known = signals_of(df, cfg, text)
        found = F.when(F.col("_text").isNotNull(), self.signals(F.col("_text"))) if known is None else F.when(open_, known)
        found = found.otherwise(none())
        a = a.withColumn("signals", F.when(F.col("error").isNull(), found))
        a = a.withColumn("_a", F.when(F.col("error").isNull(), scoring.assess(F.col("signals"), cfg.level)))
        # spans of a processed text say nothing about the prompt
        lost = F.transform("signals", lambda s: with_fields(s, span=F.lit(None), span_omitted=F.when(s["span"].isNotNull(), F.lit("preprocessing_changed_coordinates")).otherwise(s["span_omitted"])))
        a = a.withColumn("signals", F.when(F.col("_text") != raw, lost).otherwise(F.col("signals")))
        risk, flagged = F.col("_a.risk_level"), scoring.is_injection(F.col("_a.risk_level"))
        response = mitigate.respond(raw, F.col("signals"), risk, cfg.response, cfg.level, cfg.preprocessing.max_length, self.selector)
        return a.select(
            *keep, "error", risk.alias("risk_level"), F.when(F.col("error").isNull(), scoring.risk_label(risk)).alias("risk_label"), F.col("_a.confidence").alias("confidence"), F.col("_a.score").alias("score"),
            flagged.alias("injection_detected"), "signals", F.when(flagged, response).alias("mitigated_prompt"), *(["_text"] if keep_processed else []),
        )


#: The planner gives frames made of objects or checkpoints, and what they are united with, at least this size.
UNKNOWN_SIZE = 2**62


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt over all slots, where the planner puts the input at fewer full partitions than that; a large input stays as its scan deals it.

    The analysis is bound by CPU, and small files are few partitions. Where the planner does
    not know the size, the number of partitions decides.
    """
    slots = partitions or df.sparkSession.sparkContext.defaultParallelism
    full = int(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").removesuffix("b"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = df.rdd.getNumPartitions() < slots if size >= UNKNOWN_SIZE else size < slots * full
    return df.repartition(slots) if few else df
