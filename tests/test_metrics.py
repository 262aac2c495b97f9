import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grainmill.operators import keywords, metrics
from grainmill.functions import text as tx
from grainmill.sources.prompts import read_prompts
from grainmill.streaming.analyze import run_to_table, windowed_metrics

BEGIN = datetime(2024, 5, 1, 12)
SCHEMA = "seq long, recorded_at timestamp, duration_ms long, error string, risk_label string, injection_detected boolean, confidence float, signals array<struct<kind:string>>"


def analyses(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        risk = rng.choice(["None", "Low", "Medium", "High", "Critical"])
        kinds = [{"kind": rng.choice(["Jailbreak", "Custom", "RolePlaying"])} for _ in range(rng.randint(0, 3))]
        error = "prompt_too_long" if i % 50 == 7 else None
        rows.append((i, BEGIN + timedelta(seconds=30 * i), rng.choice([3, 5, 5, 8, rng.randint(0, 900)]), error, None if error else risk, None if error else risk in ("Medium", "High", "Critical"), None if error else rng.choice([0.25, 0.5, 0.75]), None if error else kinds))
    return rows


def test_snapshot_matches_brute_force(spark):
    rows = [r for r in analyses() if r[3] is None]
    got = metrics.snapshot(spark.createDataFrame(analyses(), SCHEMA), samples=60, age="1 hour").collect()
    assert len(got) == 1
    s, ms = got[0], [r[2] for r in rows]
    hit = sum(r[5] for r in rows)
    assert (s["total_analyzed"], s["injections_detected"], s["total_ms"], s["min_ms"], s["max_ms"]) == (len(rows), hit, sum(ms), min(ms), max(ms))
    assert abs(s["detection_rate"] - hit / len(rows)) < 1e-12 and abs(s["avg_ms"] - sum(ms) / len(ms)) < 1e-9
    tally = lambda xs: [(k, xs.count(k)) for k in sorted(set(xs))]
    assert [tuple(x) for x in s["risk_levels"]] == tally([r[4] for r in rows])
    assert [tuple(x) for x in s["threat_types"]] == tally([k["kind"] for r in rows for k in r[7]])
    kept = [r for r in rows if r[1] >= rows[-1][1] - timedelta(hours=1)][-60:]
    place = sorted(r[2] for r in kept)
    assert s["percentiles"].asDict() == {f"p{p}": place[min(len(kept) * p // 100, len(kept) - 1)] for p in (50, 90, 95, 99)}
    c = [r[6] for r in kept]
    assert abs(s["confidence_stats"]["std_dev"] - statistics.pstdev(c)) < 1e-9 and s["confidence_stats"]["max_confidence"] == max(c)
    assert abs(s["confidence_stats"]["avg_positive"] - statistics.mean(r[6] for r in kept if r[5])) < 1e-9


def test_snapshot_of_nothing(spark):
    s = metrics.snapshot(spark.createDataFrame([], SCHEMA)).collect()
    assert len(s) == 1 and s[0]["total_analyzed"] == 0 and s[0]["risk_levels"] == [] and s[0]["percentiles"]["p99"] == 0 and s[0]["confidence_stats"]["avg_positive"] == 0


@pytest.mark.parametrize("values", [[], [7], [1, 1, 1, 2], list(range(1000)), [5] * 400 + list(range(100))])
def test_percentiles_match_sorting(spark, values):
    df, n, place = spark.createDataFrame([(v,) for v in values] + [(None,)], "duration_ms long"), len(values), sorted(values)
    assert metrics.percentiles(df).first().asDict() == {f"p{p}": place[min(n * p // 100, n - 1)] if n else 0 for p in metrics.PERCENTS}
    got = tx.rank_percentiles(df, "duration_ms", (0, 50, 100)).first()
    assert tuple(got) == tuple(place[int(p / 100 * (n - 1) + 0.5)] if n else None for p in (0, 50, 100))


def test_retention(spark):
    df = spark.createDataFrame(analyses(), SCHEMA)
    assert sorted(r["seq"] for r in metrics.retained(df, samples=10).collect()) == list(range(290, 300))
    assert {r["seq"] for r in metrics.retained(df, age="10 minutes").collect()} == set(range(279, 300))
    assert metrics.totals(metrics.reset(df)).first()["total_analyzed"] == 0


def windows(df):
    return sorted((r["window"]["start"], r["risk_label"], r["n"], r["injections"], round(r["avg_confidence"], 6)) for r in df.collect())


def test_windowed_metrics(spark, tmp_path):
    rows = analyses()
    want = {}
    for r in rows:
        if r[3] is None:
            want.setdefault((r[1].replace(second=0, minute=r[1].minute // 10 * 10), r[4]), []).append(r)
    want = sorted((k[0], k[1], len(v), sum(x[5] for x in v), round(statistics.mean(x[6] for x in v), 6)) for k, v in want.items())
    assert windows(windowed_metrics(spark.createDataFrame(rows, SCHEMA), width="10 minutes")) == want
    for k in range(3):  # three files, each later than the one before
        spark.createDataFrame(rows[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    flat = windowed_metrics(stream, width="10 minutes")
    run_to_table(flat, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    closed = windows(spark.read.parquet(str(tmp_path / "out")))
    assert closed and set(closed) <= set(want)  # those that the watermark has passed, whole
    assert {w for w in want if w[0] < BEGIN + timedelta(minutes=90)} <= set(closed)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_prompts_from_files(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a, b", "x"), (2, None, "y")], "id int, body string, more string")
    df.write.format(fmt).save(str(tmp_path / "p")) if fmt != "csv" else df.select("id", "body").write.csv(str(tmp_path / "p"))
    got = read_prompts(spark, str(tmp_path / "p"), fmt, "id", "body")
    assert got.columns == ["prompt_id", "text"] and sorted(map(tuple, got.collect())) == [(1, "a, b"), (2, None)]


def test_keyword_checks(spark):
    df = spark.createDataFrame([("to clarify, urgent: my boss said so. by the way, oh and also " + "x" * 60,), ("TO CLARIFY",), ("urgent",)], "t string")
    got = [r[0] for r in df.select(keywords.keyword_signals(F.col("t"), 0.1, 512)).collect()]
    assert [s["heuristic"] for s in got[0]] == ["confusion", "manipulation", "context_switching"] and got[1] == got[2] == []
    assert abs(got[0][1]["confidence"] - 0.8 * 0.35) < 1e-6
