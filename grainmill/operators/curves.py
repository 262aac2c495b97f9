"""Labels against scores at every threshold at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grainmill.functions.ranges import RANGES, cut_points, range_of
from grainmill.functions.store import settled


def threshold_curve(scored: DataFrame, by: tuple[str, ...] = (), score: str = "score", positive: str = "positive", ranges: int = RANGES) -> DataFrame:
    """A row for each distinct score of a key, as the threshold from which on rows are flagged.

    (by, threshold, at_positive, at_negative, true_positives, false_positives, false_negatives,
    true_negatives, precision, recall, f1). Equal scores are one step. Rows with a null score or
    label count nowhere; null keys are keys like others. Recall is null without positives.

    Scores are counted first, then cumulated inside ranges of scores, each starting from what
    the higher ranges hold: no key needs all its scores in one task. The counts are kept in
    the shared folder, so the scores are made once.
    """
    keys, s = [f"_k{i}" for i in range(len(by))], F.col("s")
    rows = scored.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(score).cast("double").alias("s"), F.col(positive).cast("boolean").alias("y"))
    counted = settled(rows.groupBy(*keys, "s").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q")))
    placed = counted.withColumn("part", range_of(s, cut_points(counted.select("s"), "s", ranges)))
    of_key = W.partitionBy(*(keys or [F.lit(0)]))
    higher = of_key.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "part").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    above = lambda c: F.coalesce(F.sum(c).over(higher), F.lit(0))
    carried = parts.select(*keys, "part", above("p").alias("p"), above("q").alias("q"), F.sum("p").over(of_key).alias("all_p"), F.sum("q").over(of_key).alias("all_q"))
    both = placed.withColumn("first", F.lit(1)).unionByName(carried.withColumn("first", F.lit(0)), allowMissingColumns=True)
    down = W.partitionBy(*keys, "part").orderBy("first", F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    cumulated = both.select(*keys, "s", "p", "q", "first", F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp"), F.first("all_p").over(down).alias("all_p"), F.first("all_q").over(down).alias("all_q")).where("first = 1")
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("all_p") - F.col("tp"), F.col("all_q") - F.col("fp")
    return cumulated.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys)], s.alias("threshold"), F.col("p").alias("at_positive"), F.col("q").alias("at_negative"), tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), tn.alias("true_negatives"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def curve_summary(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, positives, negatives, auc, best_threshold, best_f1): the chance that a positive scores above a negative, ties as a half, and the threshold of the greatest f1, the higher one on ties.

    Without positives or without negatives ``auc`` is null, and without positives so is the threshold.
    """
    p, q = F.sum("at_positive"), F.sum("at_negative")
    won = F.sum(F.col("at_positive").cast("double") * (F.col("true_negatives") + F.col("at_negative") / 2))
    best = F.max(F.when(F.col("recall").isNotNull(), F.struct("f1", "threshold")))
    return curve.groupBy(*by).agg(p.alias("positives"), q.alias("negatives"), F.try_divide(won, p.cast("double") * q).alias("auc"), best["threshold"].alias("best_threshold"), best["f1"].alias("best_f1"))
