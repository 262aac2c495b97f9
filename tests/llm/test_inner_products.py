import math
import random

from pyspark.sql import functions as F

from grainmill.llm import inner_products


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 5:
            continue
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    return sorted(map(tuple, inner_products.top_k(df, F.col("vec_id") % 5 == 0, k).collect()))


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(inner_products, "BLOCK", 32)
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)]) * (1 + i % 7) for _ in range(20)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # one common vector
    rows += [(300, None), (305, [float("nan")] * 20), (310, [None] * 20), (None, rows[0][1]), (315, [0.0] * 20)]
    assert run(spark, rows) == brute(rows, 5)


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [1.0, 0.5])]) == [(0, 1, 1, 256 * 256 + 512 * 128)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
