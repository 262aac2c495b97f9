"""The analysis over streams, and running metrics of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.plans.detector import Detector


def analyze_stream(stream: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """Each prompt as it arrives; nothing is kept between prompts, so any output mode will do."""
    return detector.analyze(stream, text)


def windowed_metrics(analyses: DataFrame, at: str = "recorded_at", width: str = "1 minute", late: str = "5 minutes", slide: str | None = None, seq: tuple[str, ...] = ()) -> DataFrame:
    """Counts a window of event time, overlapping ones with ``slide``; windows close when the watermark has passed them. With ``seq``, repeats of a row count once."""
    ok = analyses.where("error is null")
    return (
        (once(ok, seq, at, late) if seq else ok.withWatermark(at, late)).groupBy(F.window(at, width, slide), "risk_label")
        .agg(F.count("*").alias("n"), F.count_if("injection_detected").alias("injections"), F.avg("confidence").alias("avg_confidence"))
    )


def once(analyses: DataFrame, seq: tuple[str, ...], at: str = "recorded_at", late: str = "5 minutes") -> DataFrame:
    """One row for each ``seq``: of a stream the first within the watermark, of a table any. Null numbers are one."""
    if analyses.isStreaming:
        return analyses.withWatermark(at, late).dropDuplicatesWithinWatermark(list(seq))
    return analyses.dropDuplicates(list(seq))


def session_metrics(analyses: DataFrame, keys: tuple[str, ...], at: str = "recorded_at", gap: str = "30 minutes", late: str = "5 minutes", seq: tuple[str, ...] = ()) -> DataFrame:
    """(keys, window, n, injections, most_confidence): runs of a key's analyses no two neighbours of which are ``gap`` apart.

    With ``seq``, repeats of a row count once. Rows with an error or a null time count nowhere, null keys are keys like
    others. A session of a stream is told when the watermark has passed its end; ``dropped``
    counts the rows that came later than that. The runs of a task are merged before they are
    exchanged, so a key with very many rows sends few.
    """
    ok = analyses.where(F.col("error").isNull() & F.col(at).isNotNull())
    ok = once(ok, seq, at, late) if seq else ok.withWatermark(at, late)
    ok.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    return ok.groupBy(*keys, F.session_window(at, gap).alias("window")).agg(F.count("*").alias("n"), F.count_if("injection_detected").alias("injections"), F.max("confidence").alias("most_confidence"))


def dropped(query) -> int:
    """Rows that the watermark of a finished or running query has dropped, by the progress that it still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def run_to_table(df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()):
    """Append to Parquet, exactly once by the checkpoint; stops when the source is drained."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition_by).trigger(availableNow=True).start()
