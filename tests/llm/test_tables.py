"""Columns of clashing names, repeated rows, empty tables, hot keys, and the queries against brute force."""

import collections
import random
import re
import zlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from samples import DOCS, words
from grainmill.llm import common, fingerprints, inner_products, language, mixing, near_dups, packing, queries, sharding, suffix_dedup, tokens, url_filters

INNER = (
    "_key _bytes _part _rank _shard _order _slot _h _k _p _mid _mh _all _size _src _id _perm _tie _salt _parts u h g at n c k marks mark spans copies blocks tree row key home to range guest made next node alias "
    "host path best component low high band bucket id rep signature set1 set2 z user_0 user_1 _node _alias _tree _k1 _k2 _copy _copies _i _range"
).split()


def with_clashes(df):
    return df.withColumns({c: F.lit(f"mine {c}") for c in INNER if c not in df.columns})


@pytest.mark.parametrize(
    "operate, own",
    [
        (lambda d: sharding.shard(d, 3), {"_shard", "_slot"}),
        (mixing.mixed_documents, set()),
        (near_dups.without_near_duplicates, set()),
        (lambda d: near_dups.without_near_duplicates(d.unionByName(d)), set()),
        (lambda d: suffix_dedup.remove_repeats(d, 70, with_text=True), set()),
        (fingerprints.fingerprint, set()),
        (lambda d: fingerprints.with_next(d, ["text"]), set()),
        (tokens.count_tokens, set()),
        (lambda d: language.identify(d, language.train(d)), set()),
        (lambda d: url_filters.judge(d.withColumn("url", F.concat(F.lit("http://a.net/es/"), "doc_id")).withColumn("html", F.lit("<link rel=canonical href=http://b.net/fr/1>")), queries.RULES), set()),
    ],
    ids=["shard", "mixed_documents", "without_near_duplicates", "without_near_duplicates of repeated rows", "remove_repeats", "fingerprint", "with_next", "count_tokens", "identify", "judge"],
)
def test_columns_of_inner_names_pass_through(spark, docs, operate, own):
    out = operate(with_clashes(docs))
    rows = out.collect()
    assert rows
    for c in set(INNER) - own:
        assert {r[c] for r in rows} == {f"mine {c}"}, c


@pytest.mark.parametrize(
    "operate",
    [
        lambda d: near_dups.near_duplicates(d), lambda d: packing.pack(d, 256), lambda d: inner_products.top_k(d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), *[c for c in INNER]), F.col("vec_id") % 5 == 0)
    ],
    ids=["near_duplicates", "pack", "top_k"],
)
def test_other_columns_are_not_read(spark, docs, operate):
    assert operate(with_clashes(docs.where("doc_id is not null"))).count() > 0


def repeated(spark):
    """Rows that occur several times, ids with several texts, null ids."""
    rng = random.Random(6)
    rows = [(i % 4, words(rng, 80), "xx", "a", 1) for i in range(6)]
    return spark.createDataFrame(rows + rows[:3] + rows[:1] * 5 + [(None, rows[0][1], None, None, None)] * 3 + [(9, None, None, None, None)] * 2, DOCS)


def test_repeated_rows(spark):
    df = repeated(spark)
    n = df.count()
    texts = [r["text"] for r in df.collect()]
    sizes = [len((t or "").encode()) for t in texts]
    # sharding: slots of their own
    s = sharding.shard(df, 2).collect()
    assert len(s) == n and len({(r["_shard"], r["_slot"]) for r in s}) == n
    # tokens and packing: each row alone
    assert sorted(r["n_bytes"] for r in tokens.count_tokens(df).collect()) == sorted(sizes)
    pieces = packing.pack(df, 64).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] + 1 for r in tokens.count_tokens(df).collect())
    # mixing: documents of their own, nobody above twice
    m = mixing.mix(df).collect()
    assert len(m) == n and all(sum(p["words"] for p in r["pieces"]) <= 2 * r["size"] for r in m)
    # copies lose everything
    gone = suffix_dedup.remove_repeats(df, 70).collect()
    assert len(gone) == n
    often = collections.Counter(texts)
    assert sorted(r["n_removed"] for r in gone) == sorted(z if often[t] > 1 and t else 0 for t, z in zip(texts, sizes))
    # near copies: rows with an id and equal texts share the smallest id
    found = near_dups.near_duplicates(df, percent=85).collect()
    assert len(found) == n and all(r["kept"] for r in found if r["doc_id"] is None or not r["n_shingles"])
    assert {r["component_id"] for r in found if r["doc_id"] is None} == {None}
    # fingerprints: equal texts, equal roots
    roots = collections.defaultdict(set)
    for r in fingerprints.fingerprint(df).collect():
        roots[r["text"] or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in roots.values())
    # languages: as often as rows
    assert language.identify(df, language.train(df)).count() == n
    # pages: judged alike
    pages = df.select("doc_id", F.lit("http://m.example.com/en/1").alias("url"), F.lit("").alias("html"))
    assert [r["url_verdict"] for r in url_filters.judge(pages, queries.RULES).collect()] == ["block"] * n
    # vectors: each a candidate, none its own query's
    v = df.where("doc_id is not null").select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("double")).alias("embedding"))
    top = inner_products.top_k(v, F.col("vec_id") == 0, 3).collect()
    assert top and all(r["query_id"] == 0 and r["vec_id"] != 0 for r in top)


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", queries.queries())
def test_empty_tables(spark, empty_tables, name):
    out = queries.queries()[name](spark, empty_tables)
    assert out.collect() == [] and len(out.columns) >= 4


def test_pipeline_of_nothing(spark, empty_tables):
    cp = pytest.importorskip("corpus_pipeline")
    assert cp.run(spark, empty_tables).collect() == []


def test_inner_products_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(i, [1e16 + i, 1e16]) for i in range(4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        inner_products.top_k(df, F.col("vec_id") == 0, 2).collect()


def test_long_urls_and_pages(spark):
    long = "http://x.net/" + "a/" * 200_000
    page = "<p>" + "x" * 2_000_000 + "<link rel='canonical' data-rel='x' href='http://y.net/es/1'>"
    rows = [(1, long, page), (2, "http://y.net/es/1", ""), (3, "http://z.org/", "<link data-rel=canonical href=http://y.net/es/1>")]
    got = {r["page_id"]: r["url_verdict"] for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


@pytest.fixture(scope="module")
def tables(spark, docs, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_mix_query_matches_brute_force(spark, tables, corpus):
    got = {r["doc_id"]: r for r in queries.op6_source_mix(spark, tables).collect()}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in corpus}
    source = {r[0]: r[3] for r in corpus}
    totals = collections.Counter()
    for i, n in size.items():
        totals[source[i]] += n
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight, left, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(totals.values()), {}
    while over := [s for s in order if s not in target and left * weight[s] / sum(weight[x] for x in order if x not in target) > 2 * totals[s]]:
        for s in over:
            target[s] = 2.0 * totals[s]
        left = 1.5 * sum(totals.values()) - sum(target.values())
    share = left / max(1, sum(weight[x] for x in order if x not in target))
    target |= {s: share * weight[s] for s in order if s not in target}
    taken = collections.Counter()
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], totals[source[i]]) and abs(r["target"] - target[source[i]]) < 1e-6 and 0 <= r["taken"] <= 2 * size[i]
        taken[source[i]] += r["taken"]
    assert set(got) == set(size) and all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_shard_query_matches_brute_force(spark, tables, corpus):
    got = queries.op9_histogram_shard(spark, tables).collect()
    texts = {r[0]: r[1] for r in corpus}
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw)) and 0 <= r["shard"] < 8
    largest, held = max(r["size"] for r in got), collections.Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(held.values()) <= sum(held.values()) / 8 + largest
    # in the order of shard and slot, equal texts stand together
    line = [texts[r["doc_id"]] or "" for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    runs = 1 + sum(a != b for a, b in zip(line, line[1:]))
    assert runs == len(set(line))


def test_language_query_keeps_its_split(spark, tmp_path):
    from test_language_pipeline import labelled

    rows = labelled(300, 5)
    spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows] + [(900, None, "en", "s", 0), (901, "12", "en", "s", 2)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_language(spark, str(tmp_path)).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert all(r["held_out"] == out(i) for i, r in got.items()) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    held = [(i, g) for i, _, g in rows if out(i)]
    assert sum(got[i]["lang_pred"] == g for i, g in held) / len(held) > 0.97


def test_sums_of_parts_give_one_model(spark, monkeypatch):
    import numpy as np
    from test_language_pipeline import labelled

    df = spark.createDataFrame(labelled(300, 8), "doc_id long, text string, lang string")
    one = language.train(df)
    monkeypatch.setattr(language, "SUMMED", 40)
    parts = language.train(df.repartition(7))
    assert one.langs == parts.langs and np.allclose(one.weights, parts.weights, atol=1e-6)
    assert language.train(df, most_languages=2).langs == tuple(sorted(k for k, _ in sorted(df.groupBy("lang").count().collect(), key=lambda r: (-r[1], r[0]))[:2]))


def test_mixed_pieces_are_bytes_of_their_documents(spark, docs, corpus):
    texts = {r[0]: r[1] or "" for r in corpus} | {500: " one\n\ntwo\tthree  \r\n four " * 40}
    df = docs.unionByName(spark.createDataFrame([(500, texts[500], None, "q", 0)], DOCS))
    out = mixing.mixed_documents(df).collect()
    parts = [r for r in out if r["text"] != texts[r["doc_id"]]]
    assert parts and all(r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in out)
    assert any("\n\n" in r["text"] for r in parts if r["doc_id"] == 500) or all(r["doc_id"] != 500 for r in parts)


def test_small_tables_are_not_cut_to_shreds(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, words(rng, 5), None, "s", 0) for i in range(20)], DOCS)
    assert mixing.mixed_documents(df).count() <= 20 * 1.5 + 8


def test_sources_are_ranked_by_code_point(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("aZé\U0001f600￮") for _ in range(3)) for _ in range(60)}, key=lambda s: s.encode()) + [None]
    df = spark.createDataFrame([(s, 10) for s in names], "source string, source_size long").repartition(5)
    got = {r["source"]: r["weight"] for r in mixing.source_targets(df).collect()}
    assert got == {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_groups_of_thousands_match_brute_force(spark, monkeypatch):
    """Near copies by a few to many edits, chains of them, copies, and a passage that a third of the documents share."""
    monkeypatch.setattr(near_dups, "BLOCK", 60)
    monkeypatch.setattr(common, "HOT_ROWS", 40)
    rng = random.Random(12)
    boiler, rows = words(rng, 70), []
    while len(rows) < 2400:
        t = words(rng, rng.randint(20, 160)).split()
        if len(rows) % 3 == 0:
            t = boiler.split() + t[: rng.randint(5, 60)]
        rows.append(" ".join(t))
        for _ in range(rng.choice([0, 0, 1, 3])):
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = words(rng, 1)
            rows.append(" ".join(t))
    rows += [rows[0]] * 200
    sets = [shingles(t) for t in rows]
    classes, where = {}, collections.defaultdict(list)
    for i, s in enumerate(sets):
        classes.setdefault(frozenset(s), i)
    for s, i in classes.items():
        for x in s:
            where[x].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = 0
    for i in classes.values():
        met = collections.Counter(j for x in sets[i] for j in where[x] if j < i)
        for j, n in met.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                links += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {i: find(classes[frozenset(s)]) for i, s in enumerate(sets)}
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), percent=85).collect()}
    assert links > 400
    assert got == want


def test_salted_joins_are_joins(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    many = spark.createDataFrame([(1, i) for i in range(100)] + [(k, k) for k in range(2, 30)] + [(None, 5)], "k int, v int")
    few = common.cut(many.where("k is not null and k != 9").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")))
    for how in ("inner", "left"):
        got = common.join_salted(many, few, ["k"], "n", how)
        assert got.columns == ["k", "v", "top"]
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(few.drop("n"), "k", how).collect()))


@pytest.mark.parametrize("n", [0, 1, 5, 100, 4000])
def test_buckets_come_from_one_constant(spark, n):
    from bisect import bisect_left

    rng = random.Random(n)
    cuts = sorted(rng.randrange(-(2**63), 2**63) for _ in range(n))
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(200)] + cuts[:20] + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("b", common.bucket_of(F.col("k"), cuts))
    assert all(r["b"] == bisect_left(cuts, r["k"]) for r in df.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "split(" not in plan


def test_clusters_must_name_a_shared_folder():
    of = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder}))
    assert common.shared_folder(of("yarn", "hdfs://x/")) == "hdfs://x"
    assert common.shared_folder(of("local[4]", None))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            common.shared_folder(of(master, None))


def test_texts_across_stride_edges(monkeypatch):
    rng = random.Random(1)
    text = (words(rng, 4000) + " \n ").encode() + b"x" * 500
    whole = near_dups.word_hashes(text).tolist()
    monkeypatch.setattr(near_dups, "STRIDE", 37)
    assert near_dups.word_hashes(text).tolist() == whole
    bpe = tokens.word_bpe(tokens.default_path())
    ids = bpe.ids(text.decode())
    monkeypatch.setattr(tokens, "TOGETHER", 50)
    assert bpe.ids(text.decode()) == ids and list(bpe.encode(["a b", None, text.decode(), "日本 x", ""])) == [bpe.ids(t) for t in ["a b", None, text.decode(), "日本 x", ""]]
    monkeypatch.setattr(tokens, "MEMO", 3)
    assert bpe.ids(text.decode()) == ids
