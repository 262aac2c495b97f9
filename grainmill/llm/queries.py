"""One thin query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, inner_products, language, lexical, mixing, near_dups, negatives, packing, pieces, sharding, suffix_dedup, tokens, url_filters
from .common import let, table

#: The rules of the url query.
RULES = [
    url_filters.Rule(True, "com", "/"),
    url_filters.Rule(False, "example.com", "/en/"),
    url_filters.Rule(True, "www.example.com", "/en/"),
    url_filters.Rule(False, "net", "/es/"),
    url_filters.Rule(False, "net", "/fr/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_sequence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 2048)


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tree_of = lambda row: let(fingerprints.tree(row["text"]), lambda t: F.struct(fingerprints.leaves_of(t).alias("leaves"), fingerprints.root(t).alias("fingerprint")))
    d = fingerprints.with_next(docs, ["text", "leaves"], derive=tree_of)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "leaves", "next_leaves")
    d = d.withColumn("edit", fingerprints.tree(F.col("edited"))).withColumn("edit_leaves", fingerprints.leaves_of(F.col("edit")))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprints.root(F.col("edit")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("leaves"), F.col("edit_leaves")).alias("near_edited"), fingerprints.likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return m.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=2048).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_histogram_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # The digests go through the exchange in place of the text.
    text = F.coalesce("text", F.lit(""))
    small = d.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_digest"))
    s = sharding.shard(small, 8, text="_digest", size="size")
    return s.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.col("lang_ambiguous").alias("ambiguous"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(v.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_top_products": op2_top_products,
        "op3_sequence_pack": op3_sequence_pack,
        "op4_merkle_fingerprint": op4_merkle_fingerprint,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_source_mix": op6_source_mix,
        "op7_token_count": op7_token_count,
        "op10_language": op10_language,
        "op8_minmax_dedup": op8_minmax_dedup,
        "op9_histogram_shard": op9_histogram_shard,
        "op11_lexical_search": op11_lexical_search,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_piece_codec": op13_piece_codec,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return {k: v for k, v in SQL.items() if k in queries()}
