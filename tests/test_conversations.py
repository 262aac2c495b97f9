"""The fold over turns: the table's and the stream's form against one in Python."""

import random
from datetime import datetime, timedelta

import pytest

from grainmill.streaming.analyze import run_to_table
from grainmill.streaming.conversations import Escalation, escalate, escalate_stream

RULE = Escalation(0.5, 1.0, 0.6)
SCHEMA = "conv_id int, turn long, risk double"


def folded(rows, rule=RULE):
    turns = {}
    for c, t, r in rows:
        if t is not None:
            turns.setdefault(c, {})[t] = max(r or 0.0, turns.get(c, {}).get(t, 0.0))
    out = []
    for c, by in turns.items():
        x = 0.0
        for t in sorted(by):
            x = min(rule.most, max(0.0, rule.decay * x + by[t]))
            out.append((c, t, round(by[t], 9), round(x, 9), x >= rule.alarm))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r["conv_id"], r["turn"], round(r["risk"], 9), round(r["running"], 9), r["escalated"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_batch_equals_the_fold(spark, ranges):
    rng = random.Random(ranges)
    rows = [(1, t, rng.choice([0.0, 0.125, 0.5, 0.75, None])) for t in range(700)]  # one long conversation
    rows += [(rng.choice([2, 3, None]), rng.choice([None, rng.randint(0, 30)]), rng.random()) for _ in range(150)]
    rows += rows[:40]
    rng.shuffle(rows)
    got = escalate(spark.createDataFrame(rows, SCHEMA), RULE, ranges=ranges)
    assert got.columns == ["conv_id", "turn", "risk", "running", "escalated"] and told(got) == folded(rows)


def test_batch_of_nothing_and_bad_rules(spark):
    assert escalate(spark.createDataFrame([], SCHEMA)).collect() == []
    for bad in ((1.5, 1.0), (0.5, 0.0)):
        with pytest.raises(ValueError):
            Escalation(*bad)


def streamed(spark, tmp_path, triggers, **options):
    begin = datetime(2024, 1, 1)
    for k, rows in enumerate(triggers):
        timed = [(c, t, r, begin + timedelta(minutes=10 * k)) for c, t, r in rows]
        spark.createDataFrame(timed, SCHEMA + ", at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    s = spark.readStream.schema(SCHEMA + ", at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run_to_table(escalate_stream(s, RULE, **options), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(200)
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_with_turns_out_of_order_equals_the_fold(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice([0.0, 0.25, 0.5])) for c in range(6) for t in range(12)]
    order = rows[:]
    rng.shuffle(order)
    got = streamed(spark, tmp_path, [order[:30], order[30:50], order[50:]], late="1 day")
    assert told(got.where("not late")) == folded(rows) and got.where("late").count() == 0
    assert told(got.where("not late").drop("late")) == told(escalate(spark.createDataFrame(rows, SCHEMA), RULE))


def test_stream_gives_up_on_missing_turns_and_marks_late_ones(spark, tmp_path):
    # turn 1 is missing; it is given up when the watermark has passed turn 2, and comes later still
    got = streamed(spark, tmp_path, [[(1, 0, 0.5), (1, 2, 0.25)], [(2, 0, 0.0)], [(2, 1, 0.0)], [(1, 1, 0.9), (1, 3, 0.5)]], late="1 minute")
    of_one = sorted((r["turn"], r["running"], r["late"]) for r in got.where("conv_id = 1").collect() if not r["late"])
    assert of_one == [(0, 0.5, False), (2, 0.5, False), (3, 0.75, False)]
    assert [(r["turn"], r["risk"], r["running"]) for r in got.where("late").collect()] == [(1, 0.9, None)]
