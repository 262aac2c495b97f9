"""States of metrics: folded in any order and steps they give the figures of all rows, from tables and from streams."""

import bisect

from pyspark.sql import functions as F
from test_metrics import SCHEMA, analyses

from grainmill.operators import metrics, partials
from grainmill.streaming.analyze import run_to_table


def hourly(df):
    return partials.states(df, {"hour": F.date_trunc("hour", "recorded_at"), "label": F.col("risk_label")})


def test_folds_equal_the_whole(spark):
    df = spark.createDataFrame(analyses(3000), SCHEMA)
    hours = hourly(df).cache()
    assert hours.count() > 100
    days = partials.fold(hours, {"day": F.date_trunc("day", "hour"), "label": F.col("label")})
    one, steps = partials.figures(partials.fold(hours, {})).first(), partials.figures(partials.fold(days, {})).first()
    whole = df.where("error is null")
    t, c = metrics.totals(whole).first(), metrics.confidence_stats(whole).first()
    sd = whole.agg(F.stddev_pop("duration_ms")).first()[0]
    place = sorted(r["duration_ms"] for r in whole.collect())
    for got in (one, steps):
        for k in ("total_analyzed", "injections_detected", "total_ms", "min_ms", "max_ms"):
            assert got[k] == t[k]
        assert abs(got["avg_ms"] - t["avg_ms"]) < 1e-9 and abs(got["detection_rate"] - t["detection_rate"]) < 1e-12 and abs(got["std_ms"] - sd) < 1e-9
        for k in ("avg_positive", "avg_negative", "min_confidence", "max_confidence", "std_dev"):
            assert abs(got[k] - c[k]) < 1e-9
        for p in metrics.PERCENTS:  # how far the rank of what the sketch gives is from p
            low, high = (f(place, got[f"p{p}"]) / len(place) for f in (bisect.bisect_left, bisect.bisect_right))
            assert low - 0.01 <= p / 100 <= high + 0.01


def test_figures_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = partials.figures(partials.fold(hourly(empty), {})).collect()
    assert len(got) == 1 and got[0]["total_analyzed"] == 0 and got[0]["p99"] == 0 and got[0]["avg_ms"] == 0.0 and got[0]["std_dev"] == 0.0
    row = (1, None, None, None, None, None, None, None)
    got = partials.figures(partials.fold(hourly(spark.createDataFrame([row, row], SCHEMA)), {})).first()
    assert (got["total_analyzed"], got["injections_detected"], got["total_ms"], got["p50"]) == (2, 0, 0, 0)


def test_states_of_a_stream(spark, tmp_path):
    rows = analyses(400)
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    s = partials.states(stream.withWatermark("recorded_at", "1 minute"), {"w": F.window("recorded_at", "10 minutes")})
    run_to_table(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    kept = spark.read.parquet(str(tmp_path / "out"))
    end = kept.agg(F.max("w.end")).first()[0]
    closed = spark.createDataFrame([r for r in rows if r[1] < end], SCHEMA)
    got, want = partials.figures(partials.fold(kept, {})).first(), metrics.totals(closed.where("error is null")).first()
    assert got["total_analyzed"] == want["total_analyzed"] > 300 and got["total_ms"] == want["total_ms"] and got["injections_detected"] == want["injections_detected"]
