"""Sessions and sliding windows of a stream whose rows come shuffled, late and repeated, against the table's."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from grainmill.streaming.analyze import dropped, run_to_table, session_metrics, windowed_metrics

BEGIN = datetime(2024, 5, 1, 12)
SCHEMA = "seq long, recorded_at timestamp, error string, risk_label string, injection_detected boolean, confidence double, user string"
GAP, LATE = timedelta(minutes=5), "10 minutes"


def analyses(n, seed):
    """In order of time, with pauses."""
    rng, t, rows = random.Random(seed), BEGIN, []
    for i in range(n):
        t += timedelta(seconds=rng.choice([5, 20, 60, 400]))
        rows.append((i, t, "prompt_too_long" if i % 40 == 9 else None, rng.choice(["None", "High"]), rng.random() < 0.3, rng.random(), rng.choice(["a", "a", "a", "b", None])))
    return rows


def sessions(rows):
    by = {}
    for r in {r[0]: r for r in rows if r[2] is None}.values():
        by.setdefault(r[6], []).append(r)
    out = []
    for k, mine in by.items():
        mine.sort(key=lambda r: r[1])
        run = [mine[0]]
        for r in mine[1:]:
            if r[1] - run[-1][1] >= GAP:
                out.append((k, run))
                run = []
            run.append(r)
        out.append((k, run))
    return sorted(((k, run[0][1], run[-1][1] + GAP, len(run), sum(r[4] for r in run)) for k, run in out), key=repr)


def told(df):
    return sorted(((r["user"], r["window"]["start"], r["window"]["end"], r["n"], r["injections"]) for r in df.collect()), key=repr)


def stream_of(spark, tmp_path, triggers):
    for k, rows in enumerate(triggers):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def shuffled(rows, seed, by):
    """Each a little out of place, and some twice."""
    rng = random.Random(seed)
    out = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, by)))
    return [r for r in out for _ in range(2 if rng.random() < 0.2 else 1)]


def test_sessions_of_a_table(spark):
    rows = analyses(400, 1)
    df = spark.createDataFrame(shuffled(rows, 2, 10_000) + [(900, None, None, "High", True, 0.5, "a")], SCHEMA)
    assert told(session_metrics(df, ("user",), gap="5 minutes", seq=("seq",))) == sessions(rows)
    assert session_metrics(df.limit(0), ("user",), gap="5 minutes").collect() == []


def test_sessions_of_a_stream(spark, tmp_path):
    rows = shuffled(analyses(400, 3), 4, 200)
    tooearly = (1000, BEGIN - timedelta(hours=3), None, "High", True, 0.5, "a")
    n = len(rows) // 5
    triggers = [rows[i * n : (i + 1) * n if i < 4 else None] for i in range(5)]
    triggers[3] = [*triggers[3], tooearly, (1001, *tooearly[1:])]  # later than any watermark allows
    flat = session_metrics(stream_of(spark, tmp_path, triggers), ("user",), gap="5 minutes", late=LATE, seq=("seq",))
    q = run_to_table(flat, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(200)
    got, want = told(spark.read.parquet(str(tmp_path / "out"))), sessions(rows)
    assert got and set(got) <= set(want) and dropped(q) == 2
    last = max(r[1] for r in rows) - timedelta(minutes=25)
    assert {w for w in want if w[2] < last} <= set(got)


def test_sliding_windows_of_a_stream(spark, tmp_path):
    rows = shuffled(analyses(300, 5), 6, 200)
    n = len(rows) // 3
    unpacked = lambda df: {(r["window"]["start"], r["risk_label"], r["n"], r["injections"]) for r in df.collect()}
    want = unpacked(windowed_metrics(spark.createDataFrame(rows, SCHEMA), width="20 minutes", slide="5 minutes", seq=("seq",)))
    stream = stream_of(spark, tmp_path, [rows[:n], rows[n : 2 * n], rows[2 * n :]])
    q = run_to_table(windowed_metrics(stream, width="20 minutes", slide="5 minutes", late=LATE, seq=("seq",)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(200)
    got = unpacked(spark.read.parquet(str(tmp_path / "out")))
    last = max(r[1] for r in rows) - timedelta(minutes=45)
    assert got <= want and {w for w in want if w[0] < last} <= got and dropped(q) == 0


def test_each_row_is_in_every_window_over_it(spark):
    df = spark.createDataFrame(analyses(50, 7), SCHEMA).where("error is null")
    w = windowed_metrics(df, width="20 minutes", slide="5 minutes")
    assert w.agg(F.sum("n")).first()[0] == 4 * df.count()
