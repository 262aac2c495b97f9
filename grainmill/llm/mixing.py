"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame functions. Every source gets a target in words; its documents, in a seeded
permutation, form a stream that is read from the start until the target is met, again
from the start where the target exceeds the source. The stream is cut into blocks of
equal words. The blocks of all sources are split recursively between the two halves of
the output shards, each node a random half of exact size, so that the counts of a
source's blocks on each side follow the multivariate hypergeometric law and their sums
are exact. Inside a shard the pieces have a seeded random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, given_back, ranked, row_keys, set_apart

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]"


def source_targets(
    totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, source: str = "source", size: str = "source_size"
) -> DataFrame:
    """``totals`` (a row per source) with ``weight`` and ``target``.

    Sources by code point, null last, take the weights in turn. ``share`` of all sizes is
    dealt by weight; no target exceeds ``most`` times its source's size, and the excess is
    reshared by weight, a pass over the sources each time, until none is above. However
    many sources there are, no task and not the driver holds more than a range of them.
    """
    weight = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("_i", F.lit(len(weights))).cast("int"))
    t = cut(ranked(totals, F.col(source).asc_nulls_last()).withColumn("weight", weight).drop("_i").withColumn("_cap", F.lit(float(most)) * F.col(size)))
    dealt, level, capped = F.lit(float(share)) * F.sum(size), 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("weight")
        every, taken, open_, n = t.agg(dealt, F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if open_ is None or n == capped:
            break
        level, capped = (every - taken) / open_, n
    target = F.col("_cap") if level and open_ is None else F.least("_cap", F.lit(level) * F.col("weight"))
    return t.withColumn("target", target).drop("_cap")


def split_blocks(quotas: DataFrame, n_shards: int, seed: int, source: str = "source", blocks: str = "n_blocks") -> DataFrame:
    """(source, shards): for each source, the output shard of each of its blocks, in block order.

    A node's blocks are ranked by a seeded hash: 1024 ranges of it are counted, and only
    inside a range are blocks numbered, so no task holds a node.
    """
    b = quotas.where(F.col(blocks) > 0).select(source, F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)).alias("block"))
    b = b.withColumn("_lo", F.lit(0)).withColumn("_m", F.lit(n_shards))
    node = ["_lo", "_m"]
    for depth in range(max(0, n_shards - 1).bit_length()):
        key = F.xxhash64(F.lit(seed), F.lit(depth), F.coalesce(F.col(source), F.lit("")), F.col(source).isNull(), F.col("block"))
        b = cut(b.withColumn("_k", key).withColumn("_range", F.shiftrightunsigned("_k", 54)))
        counts = b.groupBy(*node, "_range").agg(F.count("*").alias("_c"))
        up = W.partitionBy(*node).orderBy("_range")
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(W.partitionBy(*node)))
        inside = W.partitionBy(*node, "_range").orderBy("_k", F.col(source).asc_nulls_last(), "block")
        b = b.withColumn("_r", F.row_number().over(inside)).join(counts.drop("_c"), [*node, "_range"])
        half = F.floor(F.col("_m") / 2).cast("int")
        on_left = (F.col("_m") > 1) & (F.col("_before") + F.col("_r") <= F.round(F.col("_n") * half / F.col("_m")))
        single = F.col("_m") <= 1
        b = b.withColumn("_left", on_left).withColumn("_half", half).select(
            source, "block", F.when(F.col("_left") | single, F.col("_lo")).otherwise(F.col("_lo") + F.col("_half")).alias("_lo"),
            F.when(single, F.col("_m")).when(F.col("_left"), F.col("_half")).otherwise(F.col("_m") - F.col("_half")).alias("_m"),
        )
    listed = b.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("block", F.col("_lo").alias("shard")))).alias("_s"))
    return listed.select(source, F.col("_s.shard").alias("shards"))


def mix(
    docs: DataFrame, n_shards: int = 8, blocks_per_shard: int = 64, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    seed: int = 17, least_block: int = 64, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, pieces, and the ``carry`` columns.

    ``pieces`` is an array of (shard, block, start, words, order): words start to
    start + words of the document go to that shard; sorting a shard by ``order`` shuffles
    it. A document is taken in whole passes and at most one part, never more than ``most``
    times; a document without words (or null text) has no piece. Null sources are a source
    of their own, last in order. Repeated rows are documents of their own. The same input
    gives the same pieces, however it is partitioned. Empty input, no rows. Blocks have at
    least ``least_block`` words, so that small tables are not cut to shreds.

    A source of any size is summed in up to 4096 parts by permuted id, and its target and
    blocks meet its documents by source and part, so a hot source is never in one task.
    """
    return _mix(docs, n_shards, blocks_per_shard, weights, share, most, seed, least_block, doc_id, text, source, carry)[0]


def _mix(docs, n_shards, blocks_per_shard, weights, share, most, seed, least_block, doc_id, text, source, carry, ties: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``mix``, and how many words it takes in all. ``ties``: carried columns that order documents of one id, size and text."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    perm = F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = cut(
        docs.select(
            F.col(doc_id).alias("_id"), F.col(source).alias("_src"), size.alias("_size"), perm.alias("_perm"),
            F.xxhash64(F.col(text)).alias("_tie"), F.shiftrightunsigned(perm, 52).alias("_part"), *[F.col(c) for c in carry],
        )
    )
    parts = rows.groupBy("_src", "_part").agg(F.sum("_size").alias("_n"))
    totals = parts.groupBy("_src").agg(F.sum("_n").alias("_total"))
    targets = cut(source_targets(totals, weights, share, most, "_src", "_total"))
    all_words = targets.agg(F.coalesce(F.sum(F.ceil("target")), F.lit(0))).first()[0]
    block = max(least_block, -(-int(all_words) // (n_shards * blocks_per_shard)))
    want = F.round("target").cast("long")
    quotas = targets.select("_src", F.ceil(want / F.lit(block)).cast("long").alias("_blocks"))
    shards = split_blocks(quotas, n_shards, seed, "_src", "_blocks")
    plan = targets.select(F.col("_src").alias("_psrc"), "_total", "target", want.alias("_want")).join(shards, F.col("_psrc").eqNullSafe(F.col("_src")), "left").select(
        "_psrc", "_total", "target", "_want", F.coalesce("shards", F.array().cast("array<int>")).alias("_shards")
    )
    before = W.partitionBy("_src").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.join(plan, F.col("_src").eqNullSafe(F.col("_psrc"))).select(F.col("_src").alias("_osrc"), F.col("_part").alias("_opart"), "_base", "_total", "target", "_want", "_shards")
    within = W.partitionBy("_src", "_part").orderBy("_perm", "_id", "_size", "_tie", *ties).rowsBetween(W.unboundedPreceding, -1)
    at = rows.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    at = at.join(offsets, F.col("_src").eqNullSafe(F.col("_osrc")) & (F.col("_part") == F.col("_opart"))).withColumn("_at", F.col("_base") + F.col("_in"))
    mixed = at.select(
        F.col("_id").alias(doc_id), F.col("_src").alias(source), F.col("_size").alias("size"), F.col("_total").alias("source_size"), "target",
        _pieces(int(-(-most // 1)), block, seed).alias("pieces"), *[F.col(c) for c in carry],
    )
    return mixed, int(all_words)


def _pieces(passes: int, block: int, seed: int) -> Column:
    """The document's overlap with each block of its source's stream, in each pass."""
    size = F.col("_size")

    def of_pass(p: Column) -> Column:
        begin = p * F.col("_total") + F.col("_at")
        end = F.least(begin + size, F.col("_want"))
        first, last = F.floor(begin / F.lit(block)).cast("long"), F.floor((end - 1) / F.lit(block)).cast("long")

        def of_block(b: Column) -> Column:
            low, high = F.greatest(begin, b * block), F.least(end, (b + 1) * block)
            return F.struct(
                F.get(F.col("_shards"), b.cast("int")).alias("shard"), b.alias("block"), (low - begin).alias("start"), (high - low).alias("words"),
                F.xxhash64(F.lit(seed + 1), F.col("_perm"), F.col("_at"), p, b).alias("order"),
            )

        return F.when(end > begin, F.transform(F.sequence(first, F.greatest(first, last)), of_block)).otherwise(
            F.array().cast("array<struct<shard:int,block:bigint,start:bigint,words:bigint,order:bigint>>")
        )

    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max(0, passes - 1)).cast("long")), of_pass))


#: Words of a shard that are shuffled together.
SHUFFLED = 2_000_000


def mixed_documents(
    docs: DataFrame, n_shards: int = 8, blocks_per_shard: int = 64, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    seed: int = 17, least_block: int = 64, doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mix itself: a row of ``docs`` for every piece, its text cut to the piece's words where it is a part.

    A whole document keeps its text byte for byte, and a part the bytes from its first
    word to its last; ``n_chars`` follows the text where that column exists. The mix is
    worked out on ids, sizes and hashes of rows; texts move twice, to the pieces and to
    the shards. All columns of ``docs`` pass through, whatever their names; null ids and
    sources are ids and sources like others, null and empty texts have no piece. Rows that are alike in every column count as copies of one, with
    the pieces of all; rows that differ in any column have pieces of their own. Columns of
    maps are not compared. Reruns agree. A shard lies in parts by its random order, as
    many as its words need, and each part is shuffled by it. Empty input, no rows.
    """
    apart, names = set_apart(docs)
    t, keys = F.col(names[text]), ("_k1", "_k2")
    keyed = row_keys(apart, *keys)
    m, words = _mix(keyed, n_shards, blocks_per_shard, weights, share, most, seed, least_block, names[doc_id], names[text], names[source], keys, keys)
    pieces = m.groupBy(*keys).agg(F.flatten(F.collect_list("pieces")).alias("_all"), F.max("size").alias("_size"), F.count("*").alias("_copies")).where(F.size("_all") > 0)
    pieces = cut(pieces)
    p = keyed.join(pieces, list(keys))
    if (pieces.agg(F.max("_copies")).first()[0] or 1) > 1:
        p = p.withColumn("_copy", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))).where("_copy = 1")
    p = p.withColumn("_p", F.explode("_all"))
    # each word with the white space before it
    spaced = F.regexp_extract_all(t, F.lit(f"({GAP}*{WORD})"), 1)
    part = F.regexp_replace(F.array_join(F.slice(spaced, (F.col("_p.start") + 1).cast("int"), F.col("_p.words").cast("int")), ""), f"^{GAP}+", "")
    p = p.withColumn(names[text], F.when(F.col("_p.words") < F.col("_size"), part).otherwise(t))
    if "n_chars" in names:
        p = p.withColumn(names["n_chars"], F.length(t).cast(docs.schema["n_chars"].dataType))
    parts = max(64, -(-words // (n_shards * SHUFFLED)))
    p = p.withColumns({"_shard": F.col("_p.shard"), "_order": F.col("_p.order")}).withColumn("_part", F.pmod("_order", F.lit(parts)))
    return p.repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", "_order").select(*given_back(names))
