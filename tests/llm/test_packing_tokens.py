import zlib

import numpy as np
from pyspark.sql import functions as F

from grainmill.llm import packing, tokens

ODD = ["I'm don't 's we'll ''s !'s abc123 1.5 <|endoftext|> hi", "ÀÉ İstanbul ﬁ ½ x² é é", "a b​c <|start", "日本語 テスト", "  ", "", None, "ſ K ŉ"]


def library(text):
    t = tokens.word_bpe(tokens.default_path()).tokenizer
    return t.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, docs, corpus):
    rows = corpus + [(900 + i, t, None, None, None) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, docs.schema).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(df).collect()}
    for i, t, *_ in rows:
        n = len(library(t))
        assert got[i] == (len((t or "").encode()), n, n > 2048), t and t[:40]


def test_whole_tokens_are_proved():
    bpe = tokens.word_bpe(tokens.default_path())
    assert len(bpe.whole) > 20_000
    for w in list(bpe.whole)[::997]:
        assert np.array(library(w), "<u4").tobytes() == bpe.whole[w]


def check_pieces(rows, texts, length):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts.items():
        ids = np.array([*library(t), 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_pack_round_trip(spark, docs, corpus):
    rows = packing.pack(docs.withColumn("start", F.lit("clash")), 256, with_ids=True).collect()
    texts = {r[0]: r[1] for r in corpus}
    padding = check_pieces(rows, texts, 256)
    assert padding < 0.05 * sum(r["length"] for r in rows)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_pack_chunks_and_empty(spark, docs, corpus, no_docs, monkeypatch):
    p = packing.Packer(64, np.zeros(10, bool), 0, False)
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (5, 300, 1, 64, 63, 2, 700)]
    out = []
    for i, b in enumerate(ids):
        p.add(i, b)
        out += p.pieces(False) if p.held > 100 else []
    out += p.pieces(True)
    assert sum(o[2] for o in out) == sum(len(b) // 4 for b in ids)
    assert packing.pack(no_docs).count() == 0


def test_cuts_are_optimal_by_brute_force():
    import random

    rng, costs, length = random.Random(0), packing.Costs(), 16
    for _ in range(40):
        n = rng.randint(1, 60)
        ends = np.array(sorted({n, *rng.sample(range(1, n + 1), min(n, rng.randint(1, 12)))}))
        sentences = np.array(sorted(rng.sample(range(1, n + 1), min(n, 4))))
        places = {0: 0} | {int(s): costs.sentence for s in sentences} | {int(e): 0 for e in ends}
        wide = sorted(places)
        for a, b in zip(wide, wide[1:]):
            if b - a > length // 4:
                places |= {x: costs.inside for x in range(a + length // 4, b, length // 4)}
        best = {0: 0}
        price = lambda s: costs.sequence + (0 if s & (s - 1) == 0 else length - s)
        for j in sorted(places)[1:]:
            best[j] = min(best[i] + price(j - i) for i in best if 0 < j - i <= length) + places[j]
        cuts = packing.choose_cuts(ends, sentences, n, length, True)
        got = sum(price(b - a) + places[b] for a, b in zip([0, *cuts], cuts))
        assert got == best[n]


def test_texts_without_sentence_ends_are_cut_inside():
    ends = np.arange(1, 201) * 410
    cuts = packing.choose_cuts(ends, np.zeros(0, np.int64), int(ends[-1]), 2048, True)
    size = np.diff([0, *cuts])
    assert size.max() <= 2048 and cuts[-1] == ends[-1]
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in size.tolist()[:-1]) < 0.03 * ends[-1]


def test_other_scripts_sentences_are_cut_at_their_ends(spark):
    for mark in "。！؟।":
        df = spark.createDataFrame([(1, f"abc def ghi jkl{mark} " * 60)], "doc_id long, text string")
        own = len(library(mark))
        rows = sorted(packing.pack(df, 64, with_ids=True).collect(), key=lambda r: r["start"])
        assert len(rows) > 4 and all(list(r["ids"][-own:]) == library(mark) for r in rows[:-1]), mark
