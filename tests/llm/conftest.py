import random

import pytest

from samples import DOCS, words

@pytest.fixture(scope="session")
def corpus():
    """Random texts with copies, near copies, shared passages, nulls, empties and one long text."""
    rng = random.Random(4)
    passage = words(rng, 60)
    rows = []
    for i in range(60):
        t = words(rng, rng.randint(1, 120))
        if i % 6 == 1:
            t = t + " " + passage + ". " + words(rng, 10)
        if i % 9 == 2 and rows:
            t = rows[rng.randrange(len(rows))][1] or ""
        if i % 9 == 4 and rows:
            ws = (rows[i - 1][1] or "").split()
            if len(ws) > 40:
                ws[rng.randrange(len(ws))] = "changed"
            t = " ".join(ws)
        rows.append((i, t, rng.choice(["xx", "yy", None]), rng.choice(["a", "b", "c", None]), len(t)))
    rows += [(100, None, None, None, None), (101, "", "xx", "a", 0), (102, "é" * 300 + " " + "aaaa" * 200, "yy", "é", 0), (103, words(rng, 9000), "xx", "b", 0), (104, "!!! 123 ...", None, "a", 11), (105, "w " * 3, "xx", "c", 6)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
