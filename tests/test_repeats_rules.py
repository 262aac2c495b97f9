"""Tandem repeats, rules from a table, and every level at once."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.functions import repeats
from grainmill.functions.levels import SecurityLevel
from grainmill.operators.rule_tables import match_rules
from grainmill.plans.calibrate import calibrate
from grainmill.plans.config import ConfigBuilder
from grainmill.plans.detector import Detector, spread
from grainmill.sources.prompts import mixed_prompts, phrase_table


def square_by_brute_force(t, least):
    return least > 0 and any(t[i : i + r] == t[i + r : i + 2 * r] for r in range(least, len(t) // 2 + 1) for i in range(len(t) - 2 * r + 1))


@settings(max_examples=400, deadline=None)
@given(st.text("ab世", max_size=60), st.integers(0, 9))
def test_squares_of_short_texts(text, least):
    assert repeats.has_square(text, least) == square_by_brute_force(text, least)


@pytest.mark.parametrize("short, window, at_once", [(32, 8, 1 << 20), (2, 1, 16), (4, 2, 100)])
def test_squares_of_long_roots(monkeypatch, short, window, at_once):
    for name, value in (("SHORT", short), ("WINDOW", window), ("AT_ONCE", at_once)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(3)
    for n in range(60):
        noise = lambda k: "".join(rng.choice("abcdefghé") for _ in range(k))
        root = noise(rng.randint(3, 120))
        for t in (noise(rng.randint(0, 90)) + root + root + noise(rng.randint(0, 90)), noise(20) + root + root[:-1] + "Z" + noise(20), root + "X" + root, noise(250)):
            assert repeats.has_square(t, 12) == square_by_brute_force(t, 12), t


def test_colliding_hashes_decide_nothing(monkeypatch):
    monkeypatch.setattr(repeats, "BASE", repeats.np.uint64(1))  # all windows of equal sums collide
    rng = random.Random(4)
    for _ in range(30):
        t = "".join(rng.choice("abc") for _ in range(220))
        assert repeats.has_square(t, 20) == square_by_brute_force(t, 20)
    root = "".join(rng.choice("abcdefgh") for _ in range(50))
    assert repeats.has_square("xy" + root * 2 + "z", 33)


def test_a_megabyte_takes_no_square_of_its_time():
    rng = random.Random(5)
    plain = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    began = time.process_time()
    assert not repeats.has_square(plain, 10)
    assert time.process_time() - began < 5  # about one on a quiet machine
    assert repeats.has_square(plain[:400_000] * 2, 300_000)


RULES = [
    (1, r"weather\s+is"), (2, r"(secret|hidden)\s+handshake"), (3, r"\d{3}"), (4, r"İstanbul|x+y"), (5, r"ab"), (6, r"q"), (7, None), (8, r"(?:nothing|nowhere)\s+here"), (8, r"weather"), (9, r"hand.*hidden"), (None, r"\bnice\b"),
]


@pytest.mark.parametrize("gram", [3, 1, 5])
def test_rules_of_a_table_match_what_rlike_matches(spark, monkeypatch, gram):
    from grainmill.functions.base import java
    from grainmill.operators import rule_tables

    monkeypatch.setattr(rule_tables, "GRAM", gram)
    texts = ["The WEATHER is nice", "a Secret handshake, hidden hand\nshake", "123 and 12", "istanbul İSTANBUL xxY", "ab", "", None, "q", "hand in hand: hidden secret", "ſecret handſhake", "weather weather", "a b"]
    p = spark.createDataFrame(list(enumerate(texts)) + [(None, "weather is ab")] * 2, "prompt_id long, text string").withColumns({c: F.lit(c) for c in ("_k", "_gram", "_rx", "_held", "_before", "content", "pattern")})
    rules = spark.createDataFrame(RULES, "rule_id int, pattern string")
    got = match_rules(p, rules)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, rx in RULES:
        if rx is not None:
            want += [(r["prompt_id"], r["text"], i, r["m"]) for r in p.where(F.rlike("text", F.lit(java(rx)))).select("prompt_id", "text", F.regexp_substr("text", F.lit(java(rx))).alias("m")).collect()]
    assert sorted(((r["prompt_id"], r["text"], r["rule_id"], r["content"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_rule_tables_are_checked(spark):
    p = spark.createDataFrame([(1, "a")], "prompt_id long, text string")
    rules = lambda rows: spark.createDataFrame(rows, "rule_id int, pattern string")
    with pytest.raises(ValueError):
        match_rules(p, rules([(1, "a"), (2, "b")]), max_patterns=1)
    with pytest.raises(ValueError):
        match_rules(p, rules([(1, "(?P<a>x)\\1")]))
    assert match_rules(p, rules([])).collect() == [] and match_rules(p.limit(0), rules([(1, "a")])).collect() == []


def test_case_sensitive_rules(spark):
    p = spark.createDataFrame([(1, "Alpha beta")], "prompt_id long, text string")
    rules = spark.createDataFrame([(1, "alpha"), (2, "Alpha"), (3, "beta")], "rule_id int, pattern string")
    assert sorted(r["rule_id"] for r in match_rules(p, rules, case_sensitive=True).collect()) == [2, 3]


def test_prompts_are_spread_over_all_slots(spark):
    p = mixed_prompts(spark, "/root/testdata/sf0.01") if __import__("os").path.isdir("/root/testdata/sf0.01") else phrase_table(spark)
    assert spread(p, 7).rdd.getNumPartitions() == 7
    assert spread(spark.createDataFrame([(1, "a")] * 3, "i int, t string").coalesce(1), 7).rdd.getNumPartitions() == 7
    assert spread(spark.createDataFrame([(1, "a")] * 30, "i int, t string").repartition(9), 7).rdd.getNumPartitions() == 9


def test_calibration_equals_an_analysis_for_each_level(spark):
    p = phrase_table(spark).unionByName(spark.createDataFrame([(-5000, None, "x"), (-5001, "a" * 10_001, "x"), (-5002, "", "x")], "prompt_id long, text string, source string")).withColumns({"score": F.lit("mine"), "_once": F.lit("mine")})
    p = p.repartition(4)
    got = {(r["prompt_id"], r["level"]): (r["error"], r["score"], r["confidence"], r["risk_level"], r["injection_detected"]) for r in calibrate(p).collect()}
    assert len(got) == 11 * p.count()
    for v in (0, 3, 5, 8, 10):
        one = Detector(ConfigBuilder().with_security_level(v).build()).analyze(p).select("prompt_id", "error", "score", "confidence", "risk_level", "injection_detected")
        for r in one.collect():
            assert got[r["prompt_id"], v] == tuple(r)[1:], (r["prompt_id"], v)


def test_calibration_with_own_patterns_and_keywords(spark):
    b = lambda v: ConfigBuilder().with_security_level(v).with_custom_patterns("weather").with_keyword_checks().build()
    p = phrase_table(spark).limit(40)
    got = {(r["prompt_id"], r["level"]): r["score"] for r in calibrate(p, b(5), levels=(2, 9)).collect()}
    for v in (2, 9):
        assert all(got[r["prompt_id"], v] == r["score"] for r in Detector(b(v)).analyze(p).collect())
