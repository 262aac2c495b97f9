"""As-of joins, span coverage and threshold curves against brute force, with one hot key, ties, nulls and empty tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grainmill.functions.ranges import cut_points, range_of, ranges_at
from grainmill.operators.asof import asof_join
from grainmill.operators.curves import curve_summary, threshold_curve
from grainmill.operators.spans import coverage

BEGIN = datetime(2024, 1, 1)


def at(k):
    return None if k is None else BEGIN + timedelta(seconds=k)


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_ranges(spark, ranges):
    values = [7] * 300 + list(range(100))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    cuts = cut_points(df, "v", ranges)
    got = df.select("v", range_of(F.col("v"), cuts).alias("r"), ranges_at(F.col("v"), cuts).alias("m")).collect()
    assert all(r["r"] == sum(c < r["v"] for c in cuts) for r in got)
    assert {r["m"] for r in got if r["v"] == 7} == {max(1, cuts.count(7.0))} and {r["m"] for r in got if r["v"] == 99} == {max(1, cuts.count(99.0))}


def in_force(left, right, keyed):
    out = []
    for row in left:
        k, t = row[1], row[2]
        met = [r for r in right if (not keyed or (k is not None and r[0] == k)) and t is not None and r[1] is not None and r[1] <= t]
        best = max(met, key=lambda r: (r[1], r[2])) if met else None
        out.append((*row, *(best[2:] if best else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keyed,ranges", [(True, 4), (True, 64), (False, 8)])
def test_asof_matches_brute_force(spark, keyed, ranges):
    rng = random.Random(ranges)
    keys = [1] * 8 + [2, 3, None]  # most rows have one key, and many one instant
    left = [(i, rng.choice(keys), at(rng.choice([50, 50, rng.randint(0, 100), None]))) for i in range(400)] + [(7, 1, at(50))] * 3
    right = [(rng.choice(keys), at(rng.choice([None, 50, rng.randint(20, 90)])), i, rng.choice(["a", None])) for i in range(60)]
    a = spark.createDataFrame(left, "seq long, k int, t timestamp").withColumn("level", F.lit("old"))
    b = spark.createDataFrame(right, "k int, since timestamp, id long, level string")
    got = asof_join(a, b, ("k",) if keyed else (), "t", "since", ("id", "level"), ("id",), ranges)
    assert got.columns == ["seq", "k", "t", "id", "level"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == in_force(left, right, keyed)


def test_asof_of_nothing(spark):
    a, b = spark.createDataFrame([(1, 1, at(3))], "seq long, k int, t timestamp"), spark.createDataFrame([], "k int, t timestamp, v string")
    assert [tuple(r) for r in asof_join(a, b, ("k",), "t", "t", ("v",)).collect()] == [(1, 1, at(3), None)]
    assert asof_join(a.limit(0), b, ("k",), "t", "t", ("v",)).collect() == []


@pytest.mark.parametrize("ranges", [1, 6, 64])
def test_coverage_matches_brute_force(spark, ranges):
    rng = random.Random(ranges)
    rows = []
    for _ in range(500):
        a = rng.randint(0, 300)
        rows.append((rng.choice([1, 1, 1, 1, 2, None]), a, rng.choice([a, a - 3, None, a + rng.randint(1, 9), a + 9, a + rng.choice([1, 200])])))
    rows += [(9, 4, 4), (1, None, 3)]
    want = {}
    for k, a, b in rows:
        if a is not None and b is not None:
            n, depth = want.setdefault(k, [0, {}])
            want[k][0] += 1
            for p in range(a, b):
                depth[p] = depth.get(p, 0) + 1
    want = sorted(((k, n, len(d), max(d.values(), default=0)) for k, (n, d) in want.items()), key=repr)
    df = spark.createDataFrame(rows, "n int, start int, stop int")  # the key is named as a result is
    got = coverage(df.withColumnRenamed("n", "depth"), ("depth",), ranges=ranges)
    assert sorted((tuple(r) for r in got.toDF("k", "n", "covered", "deep").collect()), key=repr) == want
    assert coverage(df.limit(0), ("n",)).collect() == []


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_curve_matches_brute_force(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice([0, 0, 0, 1, None]), rng.choice([0.5, 0.5, None, round(rng.random(), 2)]), rng.choice([True, False, False, None])) for _ in range(600)]
    rows += [(5, 0.25, False), (5, 0.75, False), (6, 0.1, True)]  # a key without positives, and one without negatives
    curve = threshold_curve(spark.createDataFrame(rows, "level int, score double, positive boolean"), ("level",), ranges=ranges).cache()
    by = {}
    for k, s, y in rows:
        if s is not None and y is not None:
            by.setdefault(k, []).append((s, y))
    want = []
    for k, pairs in by.items():
        for t in {s for s, _ in pairs}:
            tp, fp = sum(s >= t and y for s, y in pairs), sum(s >= t and not y for s, y in pairs)
            fn, tn = sum(s < t and y for s, y in pairs), sum(s < t and not y for s, y in pairs)
            want.append((k, t, tp, fp, fn, tn))
    got = curve.select("level", "threshold", "true_positives", "false_positives", "false_negatives", "true_negatives").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    for r in curve_summary(curve, ("level",)).collect():
        pos, neg = ([s for s, y in by[r["level"]] if y is v] for v in (True, False))
        if pos and neg:  # the rank sum, pair by pair
            assert abs(r["auc"] - sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)) < 1e-9
            f1, t = max((2 * tp / (2 * tp + fp + fn), t) for k, t, tp, fp, fn, _ in want if k == r["level"])
            assert r["best_threshold"] == t and abs(r["best_f1"] - f1) < 1e-12
        else:
            assert r["auc"] is None and (r["best_threshold"] is None) == (not pos)


def test_a_hot_key_is_many_tasks(spark):
    """Nothing in the plans sorts a key's rows in one window but the ends of its ranges."""
    left = spark.range(2000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("t"))
    cuts = cut_points(left.select(F.unix_micros("t").alias("v")), "v")
    sizes = left.select(range_of(F.unix_micros("t"), cuts).alias("r")).groupBy("r").count().collect()
    assert len(sizes) == 64 and max(r["count"] for r in sizes) < 2000 / 64 * 2
