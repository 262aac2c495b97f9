from grainmill.llm import common, queries, url_filters
from grainmill.llm.components import connected_components


def judged(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, url_rule string")
    return {r["page_id"]: (r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in url_filters.judge(df, queries.RULES, **kw).collect()}


def test_rules_nulls_and_clashing_columns(spark):
    got = judged(spark, [(1, "HTTP://Www.Example.COM/en/x?q#f", "", "z"), (2, None, None, None), (3, "no scheme", "", None), (4, "https://a.net/es/", "", None), (5, "https://m.example.com/en/1", "", None), (6, "https://com", "", None), (7, "http://Éx.com/é", "", None)])
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4][2:] == ("net/es/", "block")
    assert got[5][2:] == ("example.com/en/", "block")
    assert got[6] == ("com", "", None, "allow")
    assert got[7] == ("Éx.com", "/é", "com/", "allow")


def test_blocks_reach_aliases_and_allows_win(spark):
    canonical = lambda u: f"<html><link href='{u}' rel=\"canonical\"></html>"
    rows = [
        (1, "http://a.org/1", canonical("http://x.net/es/1"), None),
        (2, "http://b.org/2", canonical("//a.org/1"), None),
        (3, "http://c.org/3", '<META http-equiv="Refresh" content="0; URL=http://b.org/2">', None),
        (4, "http://d.org/4", canonical("http://y.net/fr/1"), None),
        (5, "http://y.net/fr/1", canonical("http://ok.com/"), None),
        (6, "http://e.org/6", canonical("/7"), None),
        (7, "http://e.org/7", "", None),
    ]
    got = judged(spark, rows)
    assert [got[i][3] for i in (1, 2, 3)] == ["block"] * 3
    assert got[4][3] == "allow" and got[5][3] == "block"
    assert got[6][3] == got[7][3] == "allow"
    moves = spark.createDataFrame([("http://e.org/7", "http://z.net/es/9"), (None, "http://z.net/es/9")], "from_url string, to_url string")
    assert judged(spark, rows, redirects=moves)[6][3] == "block"


def test_an_address_crawled_very_often(spark, monkeypatch):
    """The address is dealt over parts, and every page of it keeps its verdict and its columns."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    rows = [(i, "http://hot.org/1", "", str(i)) for i in range(300)] + [(300, "http://hot.org/1", "<link rel='canonical' href='http://x.net/es/1'>", None), (301, "http://cold.org/", "", None), (302, None, "", None)]
    got = judged(spark, rows)
    assert len(got) == 303 and all(got[i] == ("hot.org", "/1", None, "block") for i in range(301)) and got[301][3] == got[302][3] == "allow"


def test_no_pages(spark):
    assert judged(spark, []) == {}


def test_components_match_union_find(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
