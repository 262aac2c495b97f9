import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from samples import words
from grainmill.llm import language


def labelled(n, seed):
    rng = random.Random(seed)
    syllables = {"en": ["the", "ing", "tion", "er", "wh"], "de": ["sch", "ein", "ung", "ß", "ver"], "fr": ["eau", "ç", "oi", "que", "é"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(labelled(400, 1), "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.train(df.where(~language.held_out(F.col("doc_id"))), per_language=60)
    out = language.identify(df, model).where(language.held_out(F.col("doc_id"))).collect()
    assert len(out) > 80 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_undecidable_texts_and_no_model(spark):
    df = spark.createDataFrame(labelled(90, 2), "doc_id long, text string, lang string")
    model = language.train(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !!"), (4, "²³"), (5, "é")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and got[5][0] != "und"
    nothing = language.train(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}
    one = language.train(df.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in language.identify(df, one).collect()} == {"fr"}


def test_codewords_are_apart():
    for n in (2, 4, 5, 9, 30):
        c = language.codewords(n)
        apart = (c.shape[1] - c @ c.T) / 2 + np.eye(n) * 99
        assert apart.min() >= (1 if n == 2 else 2) and len(c) == n


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")

    from test_duplicates import brute_spans, groups

    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "suffix_dedup", "mixing", "packing"]
    rows = labelled(60, 7)
    df = spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows] + [(900, None, None, None, 0), (901, "123", None, "s", 3)], docs.schema)
    assert {r["doc_id"] for r in cp.identify_language(spark, df, "").collect()} == {r[0] for r in rows}
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in groups([(r[0], r[1]) for r in corpus], 80).items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want
    clean = {r["doc_id"]: r["text"] for r in cp.remove_repeated_passages(spark, docs, "").collect()}
    for i, (n, gone, _, _) in brute_spans([(r[0], r[1]) for r in corpus], 200).items():
        assert len(clean[i].encode()) == n - gone
    from grainmill.llm import mixing, tokens

    taken = {r["doc_id"]: sum(p["words"] for p in r["pieces"]) for r in mixing.mix(docs).collect()}
    mixed, held = cp.mix_sources(spark, docs, ""), {}
    texts = {r[0]: r[1] or "" for r in corpus}
    for r in mixed.collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["text"] in texts[r["doc_id"]]
    assert mixed.columns == docs.columns and held == {i: n for i, n in taken.items() if n}
    bpe, want = tokens.word_bpe(tokens.default_path()), {}
    for i, t in texts.items():
        want[i] = len(bpe.ids(t)) // 4 + 1
    packed, got, seqs = cp.pack_sequences(spark, docs, "").collect(), {}, {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for pieces in seqs.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:])) and sum(n for _, n in pieces) <= 2048
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def test_documents_without_any_label_stay(spark, docs):
    cp = pytest.importorskip("corpus_pipeline")

    rows = labelled(20, 3)
    df = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t, _ in rows] + [(900, None, None, None, 0), (901, "123 ²", None, "s", 5), (902, "", None, "s", 0)], docs.schema)
    out = cp.identify_language(spark, df, "")
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}


#: Names of what operators return, as a pipeline's table may have them.
RESULTS = "lang_pred score lang_ambiguous n_shingles component_id kept n_bytes n_removed n_spans kept_sha256 kept_text size pieces target fingerprint url_rule n_tokens start length".split()


def odd_rows():
    rng = random.Random(21)
    one, two, three = words(rng, 80), words(rng, 80), words(rng, 80)
    near = one.split()
    near[40] = "changed"
    return [
        (1, one, "xx", "a"), (1, one, "xx", "a"), (1, one, "yy", "b"),  # one id, one text, another source
        (5, one, "xx", "a"), (5, two, "xx", "a"), (6, two, "xx", "b"),  # one id, two texts
        (None, " ".join(near), "xx", None), (None, three, "xx", None), (None, None, None, None), (None, None, None, None), (8, "", "xx", "a"), (8, "", "xx", "b"), (9, None, None, "a"),
    ]


def test_stages_over_null_and_repeated_ids(spark, docs):
    cp = pytest.importorskip("corpus_pipeline")

    rows = [(*r, len(r[1] or "")) for r in odd_rows()]
    df = spark.createDataFrame(rows, docs.schema).withColumns({c: F.lit(f"mine {c}") for c in RESULTS})
    untouched = lambda out: all(r[c] == f"mine {c}" for r in out for c in RESULTS)
    kept = cp.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    got = kept.collect()
    texts = [r["text"] for r in got]
    assert untouched(got) and texts.count(rows[0][1]) == 1 and texts.count(rows[4][1]) == 1 and texts.count(rows[7][1]) == 1 and rows[6][1] not in texts
    assert {(r["doc_id"], r["text"]) for r in got} == {(1, rows[0][1]), (5, rows[4][1]), (None, rows[7][1]), (None, None), (8, ""), (9, None)} and len(got) == 7
    clean = cp.remove_repeated_passages(spark, df, "")
    assert clean.columns == df.columns and clean.count() == len(rows) and untouched(clean.collect())
    assert [r["text"] for r in clean.where("text = '' or doc_id is null").collect()].count("") >= 8
    mixed = cp.mix_sources(spark, df, "")
    again = sorted(map(tuple, cp.mix_sources(spark, df.repartition(5), "").collect()), key=repr)
    got = mixed.collect()
    assert mixed.columns == df.columns and untouched(got) and sorted(map(tuple, got), key=repr) == again
    # a source's pieces are its own
    assert {r["source"] for r in got} == {"a", "b", None}
    assert all((r["doc_id"], r["source"]) in {(x[0], x[3]) for x in rows} for r in got)
    packed = cp.pack_sequences(spark, df, "").collect()
    assert len({(r["doc_id"], r["start"]) for r in packed}) <= len(packed) and len(packed) >= len(rows)
    labels = [(i, t, g, "s", len(t)) for i, t, g in labelled(40, 5)] + [(None, labelled(2, 6)[0][1], None, None, 3), (3, labelled(2, 6)[1][1], None, None, 3)]
    named = cp.identify_language(spark, spark.createDataFrame(labels, docs.schema).withColumns({c: F.lit(f"mine {c}") for c in RESULTS}), "")
    assert named.columns == df.columns and untouched(named.collect()) and named.count() == len(labels)


def test_stages_over_an_empty_table(spark, docs):
    cp = pytest.importorskip("corpus_pipeline")

    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == [], name
