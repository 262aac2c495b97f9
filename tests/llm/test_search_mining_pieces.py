"""Lexical search, hard negatives and the SentencePiece codec against brute force and the library."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from samples import DOCS, words
from grainmill.llm import lexical, negatives, pieces, queries

CLASHES = "key row term tf n part df most w bound seen under low rest common sum more score rank q id v label asked place ids decoded_x p_scores a_ids _salt _parts _read user_0".split()


def clashing(df):
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES if c not in df.columns})


# --- lexical search


def found_by_brute_force(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in q.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=10):
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    i = clashing(spark.createDataFrame(items, "item_id long, text string"))
    return sorted(map(tuple, lexical.search(d, i, k).collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["the", "of", "The", "é", "世界"]) if rng.random() < 0.5 else words(rng, 1)[:3] for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(20)]  # ties
    docs += [(5, docs[5][1])] * 2 + [(None, docs[9][1]), (500, None), (501, ""), (502, "... !!"), (503, "the " * 5000), (504, "zz\x00yy_xx-0z É é")]
    items = [(i, docs[i * 7][1]) for i in range(20)] + [(3, "the the of"), (None, "the"), (30, None), (31, "?"), (32, "the of"), (33, "nowhere xyzzy"), (34, "ZZ YY 0Z é")]
    return docs, items


@pytest.mark.parametrize("small", [200_000, 0])
def test_search_equals_brute_force(spark, monkeypatch, library, small):
    monkeypatch.setattr(lexical, "SMALL", small)
    if not small:
        monkeypatch.setattr(lexical, "HOT_ROWS", 16)
    assert searched(spark, *library) == found_by_brute_force(*library, 10)


def test_search_of_one_best(spark, library):
    docs, items = library
    assert searched(spark, docs, items[:5], 1) == found_by_brute_force(docs, items[:5], 1)


def test_search_in_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == [] and searched(spark, [(1, None)], [(1, "a")]) == []


# --- hard negatives


def mined_by_brute_force(rows, every, k, n_pos):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for r in ok:
        if r[0] % every == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, q in anchors.values():
        pos = sorted((-dot(q, v), j) for j, other, v in ok if other == lab and j != i)[:n_pos]
        for s, j in pos:
            neg = sorted((-dot(q, v), x) for x, other, v in ok if other != lab and 30 * -s <= 100 * dot(q, v) <= 90 * -s)[:k]
            out += [(i, j, r + 1, x, -s, -t) for r, (t, x) in enumerate(neg)]
    return sorted(out)


def mined(spark, rows, every=5, k=4):
    df = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3))
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0, k).collect()))


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(12)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.gauss(0.3, 1) for _ in range(12)]) for i in range(260)]
    rows += [(400 + i, i % 3, rows[10][2]) for i in range(40)]  # one common vector
    rows += [(500, None, rows[0][2]), (505, 1, None), (510, 1, [None] * 12), (515, 1, [float("nan")] * 12), (520, 1, [float("inf")] + [0.0] * 11), (None, 1, rows[0][2]), (525, 2, [0.0] * 12), (530, 2, [1.0]), (535, 9, rows[3][2]), (540, 1, [])]
    return rows


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_negatives_equal_brute_force(spark, monkeypatch, vectors, broadcast):
    for name, value in (("BLOCK", 64), ("ANCHORS", 16), ("STEP", 32), ("HELD", 2), ("BROADCAST", broadcast)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, vectors) == mined_by_brute_force(vectors, 5, 4, 5)


def test_negatives_of_repeated_rows(spark, vectors):
    rows = vectors[:40] + vectors[:6] + [(5, 2, vectors[8][2])]
    assert mined(spark, rows) == mined_by_brute_force(rows, 5, 4, 5)


def test_negatives_of_few_rows_and_none(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (5, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5])]) == [(0, 1, 1, 2, 131072, 65536)]
    with pytest.raises(OverflowError):
        mined(spark, [(0, 1, [1e9]), (1, 1, [1e9])])


# --- SentencePiece


@pytest.fixture(scope="module")
def codec():
    import sentencepiece

    pytest.importorskip("public_tokenizers")
    return pieces.piece_bpe(pieces.default_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_bos=True, add_eos=True), "<u4").tobytes()


def test_codec_equals_the_library(codec):
    own, library = codec
    rng = random.Random(13)
    bits = ["a", "aab", " ", "  ", "▁", "\n", "\n\n", "the", "ing", "in", "g", "é", "世界", "ขข", "\0", "﻿", "😀", "er", "he", "\t", " t", "<s>", "</s>", "<unk>", "<0x41>", "=", "====", "--", "0", "00", ".", ",", "�", "\x85"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        ids = own.encode(text)
        assert ids == ids_of(library, text), text
        assert own.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist()), text
    for _ in range(2000):
        text = "".join(own.pieces[rng.randrange(259, len(own.pieces))].replace("▁", " ") for _ in range(rng.randint(0, 10)))
        assert own.encode(text) == ids_of(library, text), text
        ids = [rng.choice([0, 1, 2, rng.randrange(259), rng.randrange(len(own.pieces))]) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_codec_of_long_texts(codec, monkeypatch):
    own, library = codec
    rng = random.Random(14)
    text = "".join(rng.choice("abcde") for _ in range(50_000)) + " " * 5000 + "a" * 5000 + "世" * 3000 + "\n" * 3000 + "word, and word " * 3000
    assert own.encode(text) == ids_of(library, text)
    for name, value in (("PART", 100), ("MEMO", 5), ("PAIRS", 7), ("LONGEST", 3)):
        monkeypatch.setattr(pieces, name, value)
    text = text[-9000:] + " \n ▁▁x\n\n" + text[40_000:61_000]
    assert own.encode(text) == ids_of(library, text)


def test_codec_refuses_other_models(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.byte_fallback = False
    (tmp_path / "other.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceBpe(str(tmp_path / "other.model"))


def test_query_gives_the_librarys_digests(spark, codec, monkeypatch):
    _, library = codec
    rng = random.Random(15)
    rows = [(i, words(rng, rng.randint(0, 80)) + rng.choice(["", " é 世界 ขข", "\n\n- a\n  b"]), "xx", "a", 1) for i in range(60)]
    rows += [(None, "x y", None, None, None), (100, None, None, None, None), (101, "", "xx", "a", 0), (102, words(rng, 9000), "xx", "b", 0)] + rows[:3] * 2
    monkeypatch.setattr(queries, "table", lambda *_: clashing(spark.createDataFrame(rows, DOCS)))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {r[1]: ids_of(library, r[1]) for r in rows}
    want = [(r[0], len(ids[r[1]]) // 4, sha(ids[r[1]]), sha(library.decode(np.frombuffer(ids[r[1]], "<u4").tolist()).encode())) for r in rows]
    assert sorted(map(tuple, queries.op13_piece_codec(spark, "").collect()), key=repr) == sorted(want, key=repr)


def test_codec_keeps_columns_and_broken_bytes(spark, codec):
    d = clashing(spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text UNION ALL SELECT 2L, 'a b'"))
    out = pieces.decode(pieces.encode(d)).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == ["a�b", "a b"]
    for c in set(CLASHES) - {"ids"}:
        assert {r[c] for r in out} == {f"mine {c}"}
    assert pieces.decode(pieces.encode(d.limit(0))).collect() == []
    assert spark.sql("SELECT cast(null AS binary) AS ids").transform(pieces.decode).first()["decoded"] is None
