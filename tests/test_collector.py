"""The live collector against a record-by-record account of the same records."""

import datetime as dt
import random

import pytest

from grainmill.streaming import collector
from grainmill.streaming.collector import Collector, collect

SCHEMA = "k string, recorded_at timestamp, seq long, duration_ms long, confidence double, injection_detected boolean, error string"


class Plain:
    """As the collector is described, with a list and nothing clever."""

    def __init__(self):
        self.rows, self.kept, self.since, self.due = [], [], 0, None

    def clear(self, now):
        newest = len(self.rows) - collector.KEPT
        self.kept = [i for i in self.kept if i >= newest and self.rows[i][0] >= now - collector.KEPT_MS]
        self.since, self.due = 0, now + collector.EVERY_MS

    def record(self, *row):
        self.due = self.due or row[0] + collector.EVERY_MS
        self.rows.append(row)
        self.kept.append(len(self.rows) - 1)
        self.since += 1
        if self.since >= collector.EVERY_RECORDS or row[0] >= self.due or len(self.kept) > collector.KEPT:
            self.clear(row[0])

    def figures(self, now):
        if now >= self.due:
            self.clear(now)
        ms = [r[1] for r in self.rows]
        mine = [self.rows[i] for i in self.kept]
        held = sorted(r[1] for r in mine)
        mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
        conf = [r[2] for r in mine]
        std = (sum((c - mean(conf)) ** 2 for c in conf) / len(conf)) ** 0.5 if conf else 0.0
        return [len(ms), sum(r[3] for r in self.rows), sum(ms), min(ms), max(ms), len(held), *[held[min(len(held) * p // 100, len(held) - 1)] if held else 0 for p in (50, 90, 95, 99)],
                mean([r[2] for r in mine if r[3]]), mean([r[2] for r in mine if not r[3]]), std]


def close(a, b):
    return len(a) == len(b) and all(abs(x - y) < 1e-9 for x, y in zip(a, b))


@pytest.mark.parametrize("kept, every, gap", [(10_000, 1_000, 500), (50, 1_000, 2_000), (10_000, 7, 70_000), (20, 5, 400_000)])
def test_a_record_at_a_time(monkeypatch, kept, every, gap):
    monkeypatch.setattr(collector, "KEPT", kept)  # of the plain account
    monkeypatch.setattr(collector, "EVERY_RECORDS", every)
    rng = random.Random(kept + every)
    own, plain, now = Collector(kept=kept), Plain(), 10**12
    for n in range(2500 if gap < 1000 else 300):
        now += rng.randint(0, gap)
        row = (now - rng.choice([0, 0, 0, 5_000]), rng.randint(0, 400), rng.random(), rng.random() < 0.3)
        own.record(*row)
        plain.record(*row)
        if n % 53 == 0:
            assert close(list(own.figures(now)[1:]), plain.figures(now)), n
            own = Collector.load(own.dump(), kept)


def test_a_stream_at_every_trigger_and_after_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collector, "KEPT", 60)
    rng, plain, want = random.Random(9), {}, []
    start = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    clock, files = 0, []
    for f in range(6):
        rows = []
        for n in range(50):
            clock += rng.randint(0, 40_000)
            rows.append([rng.choice("ab"), start + dt.timedelta(milliseconds=clock), f * 100 + n, rng.randint(0, 300), rng.random(), rng.random() < 0.4, None])
        rows += [["a", start + dt.timedelta(milliseconds=clock), 7000 + f, 5, 0.5, True, "prompt_too_long"], ["a", None, 8000 + f, 5, 0.5, True, None], ["b", start, 9000 + f, None, 0.5, True, None]]
        files.append(rows)
        for k in "ab":
            mine = sorted((r for r in rows if r[0] == k and r[6] is None and r[1] is not None and r[3] is not None), key=lambda r: (r[1], r[2]))
            c = plain.setdefault(k, Plain())
            at = [round((r[1] - start).total_seconds() * 1000) for r in mine]
            for t, r in zip(at, mine):
                c.record(t, *r[3:6])
            if mine:
                want.append((k, c.figures(at[-1])))
    got = []

    def run(names):
        for i in names:
            random.Random(i).shuffle(files[i])
            spark.createDataFrame(files[i], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            # no samples fall due by the watermark here: each trigger's rows are for the keys it brought
            q = collect(stream, ("k",), late="100 days", kept=60).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))
            q.start().awaitTermination()

    run(range(3))
    run(range(3, 6))  # every call is a new query on the same state
    assert len(got) == len(want)
    assert all(any(k == g[0] and close(list(g[2:]), w) for g in got) for k, w in want)


def test_samples_fall_due_with_the_watermark(spark, tmp_path):
    start = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    got = []

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = collect(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ("k",), late="1 second").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        q.trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start().awaitTermination()

    feed([["a", start, 1, 10, 0.5, True, None]])
    feed([["b", start + dt.timedelta(hours=2), 2, 20, 0.5, False, None]])
    feed([["b", start + dt.timedelta(hours=3), 3, 30, 0.5, False, None]])
    feed([["b", start + dt.timedelta(hours=4), 4, 40, 0.5, False, None]])
    alone = [g for g in got if g[0] == "a"]
    assert alone[0][2] == 1 and alone[0][7] == 1
    assert alone[-1][2] == 1 and len(alone) > 1  # the counter stays, and its figures came again without a record
