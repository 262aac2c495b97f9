"""Fingerprints, mixing and shards."""

import hashlib
import zlib

from pyspark.sql import functions as F

from grainmill.llm import fingerprints, mixing, sharding


def test_roots_test_equality(spark):
    texts = ["", "a", "a\n", "a\n\nb", "a\nb", "a. b.", "a.b.", None, "x" * 999, "x" * 1000, "a b. c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert got[0] == got[7] and len(set(got.values())) == len(texts) - 1


def test_likeness_and_places_of_edits(spark):
    a = "one. two. three.\n\nfour. five.\n\nsix."
    df = spark.createDataFrame([(a, a.replace("five", "FIVE"))], "a string, b string")
    t = df.select(fingerprints.tree(F.col("a")).alias("a"), fingerprints.tree(F.col("b")).alias("b"))
    r = t.select(fingerprints.likeness(fingerprints.leaves_of(F.col("a")), fingerprints.leaves_of(F.col("b"))).alias("l"), fingerprints.differing_sections(F.col("a"), F.col("b")).alias("d")).first()
    assert r["d"] == [1] and abs(r["l"] - 10 / 12) < 1e-9


def test_next_document(spark):
    ids = [5, 9, 9, -3, 0, 77, None, 12, 13]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    for per in (1, 2, 100):
        got = fingerprints.with_next(df, ["text"], rows_per_bucket=per).collect()
        order = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
        want = {t: order[(n + 1) % len(order)][1] for n, (_, t) in enumerate(order)}
        assert {r["text"]: r["next_text"] for r in got} == want and len(got) == len(ids)
    assert fingerprints.with_next(df.limit(0), ["text"]).count() == 0
    one = fingerprints.with_next(df.where("doc_id = 77"), ["text"]).first()
    assert one["next_text"] == one["text"]


def test_fingerprint_query(spark, docs, corpus, tmp_path):
    from grainmill.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op4_merkle_fingerprint(spark, str(tmp_path)).collect()}
    rows = sorted(((r[0], r[1] or "") for r in corpus), reverse=True)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (edited == t)


def test_targets_are_reshared(spark):
    rows = [("a", 10), ("b", 1000), ("c", 30), (None, 400), ("é", 0)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, (s, _) in enumerate(order)}
    cap, left, want = {s: 2 * n for s, n in rows}, 1.5 * sum(n for _, n in rows), {}
    open_ = set(cap)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in open_}
            break
        want |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        open_ -= over
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_meets_targets(spark, docs, corpus):
    m = mixing.mix(docs.withColumn("size", F.lit("clash"))).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rs: sorted((r["doc_id"], r["size"], [tuple(p) for p in r["pieces"]]) for r in rs)
    assert key(m) == key(again) and len(m) == len(corpus)
    taken = {}
    for r in m:
        t = sum(p["words"] for p in r["pieces"])
        assert t <= 2 * r["size"] and all(0 <= p["shard"] < 8 and p["words"] > 0 for p in r["pieces"])
        s = taken.setdefault(r["source"], [0, r["target"], 0])
        s[0] += t
        s[2] += r["size"]
    assert all(abs(t - target) <= 1 for t, target, _ in taken.values())
    assert abs(sum(t[1] for t in taken.values()) - 1.5 * sum(t[2] for t in taken.values())) < 1e-6


def test_blocks_split_exactly(spark):
    q = spark.createDataFrame([("a", 50), ("b", 14), (None, 1), ("z", 0)], "source string, n_blocks long")
    got = {r["source"]: r["shards"] for r in mixing.split_blocks(q, 5, 3).collect()}
    assert {s: len(x) for s, x in got.items()} == {"a": 50, "b": 14, None: 1}
    counts = [sum(x.count(k) for x in got.values()) for k in range(5)]
    assert sum(counts) == 65 and max(counts) - min(counts) <= 2


def test_mixed_documents(spark, docs, no_docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    m = {r["doc_id"]: sum(p["words"] for p in r["pieces"]) for r in mixing.mix(docs).collect()}
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len((r["text"] or "").split())
    assert words == {i: n for i, n in m.items() if n}
    assert mixing.mixed_documents(no_docs).count() == 0


def test_shards_are_even_and_gapless(spark, docs, corpus, no_docs):
    rows = corpus + [(1000 + i, "same text", None, None, None) for i in range(60)]
    df = spark.createDataFrame(rows, docs.schema).withColumn("_slot", F.lit(9))
    out = sharding.shard(df, 4).select("doc_id", "text", "_shard", "_slot").collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    big = max(size(r["text"]) for r in out)
    sums = [sum(size(r["text"]) for r in out if r["_shard"] == k) for k in range(4)]
    assert max(sums) - min(sums) <= 2 * big
    for k in range(4):
        slots = sorted(r["_slot"] for r in out if r["_shard"] == k)
        assert slots == list(range(len(slots)))
    assert sharding.shard(no_docs, 4).count() == 0
    assert {r["_shard"] for r in sharding.shard(df, 1).collect()} == {0}


def test_histogram_is_exact(spark):
    keys = [(k * 7919 % 10007, k % 50 + 1) for k in range(3000)] + [(5000, 40_000)]
    s = sharding.find_splitters(spark.createDataFrame(keys, "_key long, _bytes long"), "_key", "_bytes", 5, probes=16)
    for cut in s.cuts:
        assert s.known[cut][0] == sum(b for k, b in keys if k <= cut)
    assert s.cuts == sorted(s.cuts)


def test_crc(spark):
    assert spark.createDataFrame([("é",)], "t string").select(F.crc32("t")).first()[0] == zlib.crc32("é".encode())


def test_parts_follow_the_bytes(spark, monkeypatch):
    """More bytes are more parts, not longer ones, up to the bound; and the rows are sharded alike."""
    df = spark.createDataFrame([(i, f"{i} " * 40) for i in range(3000)], "doc_id long, text string")
    seen = []
    real = sharding.bucket_of
    monkeypatch.setattr(sharding, "LEAST_PARTS", 1)
    monkeypatch.setattr(sharding, "bucket_of", lambda key, at: seen.append(len(at)) or real(key, at))
    shards = []
    for size, most in ((1 << 20, 16_384), (200, 16_384), (200, 16)):
        monkeypatch.setattr(sharding, "MOST_PARTS", most)
        shards.append(sorted((r["doc_id"], r["_shard"], r["_slot"]) for r in sharding.shard(df, 2, part_bytes=size).collect()))
        seen.append(None)
    assert shards[0] == shards[1] == shards[2]
    last = [seen[k - 1] for k, n in enumerate(seen) if n is None]  # the cuts by which rows move
    assert last[1] > 1_000 > last[0] == last[2]  # those of the splitters alone, where they are parts enough
