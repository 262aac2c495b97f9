"""The dictionary's strings are looked for in one pass, and what a row needs once is worked out once."""

from pyspark.sql import functions as F

from grainmill import catalog
from grainmill.functions.base import held, looked_up, rules_by_string
from grainmill.functions.phrases import needed
from grainmill.functions.text import entropy
from grainmill.operators.heuristics import has_base64, has_hex
from grainmill.operators.rule_tables import match_rules

SMALL = "/root/testdata/sf0.001"


def test_strings_of_a_text_in_one_pass(spark):
    strings, of = rules_by_string([("ab",), ("abc d", "x"), ("kind",), None])
    rows = [(0, "zABC  \tD"), (1, "ab"), (2, "KIND"), (3, "kİnd x"), (4, ""), (5, None), (6, "世abc ab x")]
    d = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: sorted(r["k"]) for r in d.select("i", looked_up(held(F.col("t"), strings), strings, of).alias("k")).collect()}
    assert got == {0: [0, 1], 1: [0], 2: [2], 3: [1, 2], 4: [], 5: [], 6: [0, 1]}


def test_white_space_inside_necessary_strings():
    assert needed(r"act\s+as\s*if", True) == ("act as",) and needed(r"act\s+as", False) == ("act",)
    assert needed(r"\s+foo\s+", True) == ("foo ",) and needed(r"\s+", True) is None


def test_rule_tables_read_texts_once(spark):
    p = spark.createDataFrame([(1, "One\n two three"), (2, "one two  four")], "prompt_id long, text string")
    rules = spark.createDataFrame([(7, r"one\s+two\s+three")], "rule_id int, pattern string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rules", "")
    met = match_rules(p, rules)
    began = tracker.getJobIdsForGroup("rules")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r["prompt_id"], r["content"]) for r in met.collect()] == [(1, "One\n two three")]
    # only the rules are collected; no job counts what the texts hold
    assert len(began) <= 2 and "Exchange hashpartitioning" not in met._jdf.queryExecution().toString()


def test_the_kind_of_text_is_decided_once(spark):
    plan = catalog.queries()["f_context"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # the union's two branches
    assert plan.count("definition") == 2


def test_sanitizing_scans_each_text_once(spark):
    plan = catalog.queries()["san_pipeline"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # for texts of ASCII and for others; no filter scans besides
    assert plan.count("regexp_extract_all") == 2


def test_gates_of_the_checks(spark):
    rows = ["word aGVsbG8gd29ybGQ= end", "plain words only", "0x" + "deadbeef01" * 3, "a" * 7 + "1", "", "x_-" * 9 + "Ab", "".join(chr(0x4E00 + i) for i in range(100)) * 2]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = d.select(has_base64(F.col("t")).alias("b"), has_hex(F.col("t")).alias("h"), F.round(entropy(F.col("t")), 9).alias("e")).collect()
    assert [r["b"] for r in got][:2] == [True, False] and [r["h"] for r in got] == [False, False, True, False, False, False, False]
    assert got[6]["e"] == round(__import__("math").log2(100), 9) and got[4]["e"] == 0.0
