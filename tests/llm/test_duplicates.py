import collections
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from grainmill.llm import near_dups, suffix_dedup


def brute_spans(texts, length):
    """{id: (n_bytes, n_removed, n_spans, sha256)}"""
    data = {i: (t or "").encode() for i, t in texts}
    seen = collections.Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(df, length):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, length).collect()}


def test_passages_match_brute_force(spark, docs, corpus, monkeypatch):
    want = brute_spans([(r[0], r[1]) for r in corpus], 70)
    assert removed(docs.withColumn("u", F.lit("clash")).withColumn("n_spans", F.lit(1)), 70) == want
    assert sum(w[1] for w in want.values()) > 1000


def test_hot_hashes_are_dealt_over_tasks(spark, monkeypatch):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = noise(150)
    rows = [(i, noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90))) for i in range(40)] + [(99, "ab" * 200), (98, "q" * 300)]
    monkeypatch.setattr(suffix_dedup, "SALTED", 3)
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), 100) == brute_spans(rows, 100)


def test_kept_text_and_empty(spark, docs, no_docs):
    out = suffix_dedup.remove_repeats(docs, 70, with_text=True).collect()
    for r in out:
        assert r["n_removed"] or hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert suffix_dedup.remove_repeats(no_docs, 70).count() == 0


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    for n, k in ((1, 2), (50, 2), (400, 3), (700, 1), (300, 200)):
        x = rng.integers(1, k + 1, n).astype(np.uint8)
        order = suffix_dedup.suffix_array(x, n + 8)
        raw = x.tobytes()
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(n))


def test_anchors_depend_on_content_only():
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    h, a, b = suffix_dedup.anchors(text, 120)
    assert a[0] == 0 and b[-1] == len(text) - 120 and (a[1:] == b[:-1] + 1).all()
    h2, a2, b2 = suffix_dedup.anchors(text[500:], 120)
    assert set(h2.tolist()) <= set(h.tolist())


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, r = sorted((find(a), find(b)))
                parent[r] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def found(df, percent):
    out = near_dups.near_duplicates(df, percent=percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


def test_groups_match_brute_force(spark, docs, corpus):
    assert found(docs.withColumn("signature", F.lit(0)), 85) == groups([(r[0], r[1]) for r in corpus], 85)


def test_chains_of_near_copies(spark):
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(150)]
    rows = []
    for i in range(45):  # each a few words from the one before, far from the first
        for _ in range(2):
            base[rng.randrange(len(base))] = str(rng.randrange(10**6))
        rows.append((i, " ".join(base)))
    rows += [(100 + i, "Same Words here") for i in range(5)] + [(200, "same words here"), (201, " \t\n"), (202, None), (203, "")]
    want = groups(rows, 85)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 85) == want


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)))
    s = near_dups.signatures([np.unique(a), np.unique(b)], 2000, 1)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.05


def test_no_documents(spark, no_docs):
    assert near_dups.near_duplicates(no_docs).count() == 0


def test_long_words_and_gaps_change_no_other_word(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, other = [word() for _ in range(1000)], [word() for _ in range(60)]
    token = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(1, " ".join(base)), (2, " ".join([*base[:500], token, *base[500:]])), (3, " ".join(other)), (4, " ".join(other[:30]) + "\n" * 5000 + " ".join(other[30:]))]
    rows += [(5, token[:4096] + "a" + token), (6, token[:4096] + "b" + token)]
    assert near_dups.word_hashes(b"one " + token.encode() + b" two")[[0, 2]].tolist() == near_dups.word_hashes(b"one two").tolist()
    want = groups(rows, 85)
    assert [want[i][1] for i in range(1, 7)] == [1, 1, 3, 3, 5, 6]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 85) == want
