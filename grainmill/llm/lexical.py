"""Ranked lexical search: integer BM25-like scores over postings, exact top k for each item.

Postings (bucket of the term, term, document, occurrences, length) are a table in which each
file is in order of bucket and term. Items' terms join it on bucket and term, each match is
scored in integers and added up by item and document, and a row number takes the top k.

The number of matches is that of items times documents times common terms, so they are never
exchanged: where the items' terms are few enough to broadcast, postings are dealt by document
once, and joined, added up and cut to the best k inside a task.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import tidy
from .common import HOT_KEYS, HOT_ROWS, cut, delete_folder, shared_folder

#: Buckets that terms fall into.
BUCKETS = 64
#: Rows of items' terms that are broadcast at most (some 20 MB); beyond it both sides are exchanged by term.
SMALL = 200_000

# Fixed values of the score.
TOP, TF, LENGTH, LEAST, SHARE = 1_000_000_000, 1000, 8, 25, 75

# all that is not in a term becomes a blank, A-Z become lower case
_BLANK = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The maximal matches of letters and digits of ASCII and all that is not ASCII, A-Z lower-cased."""
    return raw.translate(_BLANK).split()


def _counted(df: DataFrame, key: str, text: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """(key, row, term, tf, n) for each distinct term of each row (the ``wanted`` ones only, if named), and for each batch a row without a term that holds its rows with terms (tf) and all their terms (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            out_key, out_row, out_term, out_tf, out_n = [], [], [], [], []
            some = every = 0
            for key_, row, t in zip(keys, rows, b.column(2)):
                terms = terms_of(t.as_buffer().to_pybytes()) if t.is_valid else []
                if not terms:
                    continue
                n = len(terms)
                some, every = some + 1, every + n
                found = Counter(terms if wanted is None else filter(wanted.__contains__, terms))
                out_term += found
                out_tf += found.values()
                out_key += [key_] * len(found)
                out_row += [row] * len(found)
                out_n += [n] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*out_key, None], pa.int64()), pa.array([*out_row, None], pa.int64()), pa.array([*out_term, None], pa.string()), pa.array([*out_tf, some], pa.int64()), pa.array([*out_n, every], pa.int64())],
                ["key", "row", "term", "tf", "n"],
            )

    read = df.select(df[key].cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), df[text].alias("text"))
    return read.mapInArrow(tidy(run), "key long, row long, term string, tf long, n long")


def _bucketed(terms: DataFrame) -> DataFrame:
    return terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))


def _meet(postings: DataFrame, terms: DataFrame, few: bool, total: int) -> DataFrame:
    """Postings joined to rows (bucket, term, df, ...): by broadcast where those are ``few``, with the postings dealt by document; else dealt by term, hot ones over parts."""
    if few:
        return postings.repartition("row").join(F.broadcast(terms), ["bucket", "term"])
    most = max(HOT_ROWS, total // HOT_KEYS)
    parts = F.ceil(F.col("df") / F.lit(most)).cast("long")
    hot = F.broadcast(terms.where(F.col("df") > most).select("term", parts.alias("_parts")).distinct())
    dealt = postings.join(hot, "term", "left").withColumn("_salt", F.pmod(F.xxhash64("row"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    return dealt.join(terms.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), ["bucket", "term", "_salt"]).drop("_salt")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, ties to the smaller doc_id.

    Null and empty texts have no terms: such documents are found by nothing and count
    nowhere, such items have no rows. Item rows with one id are one item, all their terms added; null
    item ids take no part. Repeated document rows are documents of their own; null doc_ids come last
    among ties. Columns other than the ids and texts are not read. Empty tables give no
    rows. Only sums over the corpus (two numbers) and, where they are few, the items' terms
    reach the driver or a broadcast.
    """
    spark = docs.sparkSession
    asked = _counted(items.where(F.col(item_id).isNotNull()), item_id, text).where("term is not null")
    asked = cut(asked.groupBy(F.col("key").alias("item_id"), "term").agg(F.sum("tf").alias("q")))
    words = asked.select("term").distinct()
    few = words.limit(SMALL + 1).count() <= SMALL
    wanted = frozenset(r[0].encode() for r in words.collect()) if few else None
    folder = f"{shared_folder(spark)}/postings-{uuid.uuid4()}"
    counted = _bucketed(_counted(docs, doc_id, text, wanted)).sortWithinPartitions("bucket", "term")
    counted.write.parquet(folder)
    stored = spark.read.schema(counted.schema).parquet(folder)
    n_docs, n_terms = stored.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = cut(_ranked(stored.where("term is not null").withColumnRenamed("key", "doc_id"), asked, n_docs, max(1, n_terms), k))
    delete_folder(spark, folder)
    return out


def part_of_score(n_docs: int, n_terms: int) -> Column:
    """What an occurrence count adds a unit of weight, by the document's length."""
    m = f"({100 - SHARE} + ({SHARE}L * n * {n_docs}L) div {n_terms}L)"
    return F.expr(f"({TOP}L * tf) div ({TF}L * tf + {LENGTH}L * {m})")


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs + 2.0)) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


def _ranked(postings: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    p = postings.select("bucket", "term", "row", "doc_id", part_of_score(n_docs, n_terms).alias("part"))
    known = asked.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("w", F.col("q") * weight(n_docs, F.col("df")))
    known = cut(_bucketed(known.where("w > 0").select("item_id", "term", "df", "w")))
    n_known, total = known.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    met = _meet(p, known, n_known <= SMALL, total)
    # dealt by document already: what a document gets from an item is added up in its task
    scored = met.groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
