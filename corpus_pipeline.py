"""A corpus from raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import language, mixing, near_dups, packing, suffix_dedup
from grainmill.llm.common import delete_folder, given_back, set_apart, shared_folder

#: A score under this is rejected: no language is likelier than all others together.
LEAST_SCORE = 0.5
#: 30 bands of 4 miss a link at a likeness of 0.8 with a probability under 2e-7.
BANDING = near_dups.Banding(bands=30, rows=4)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``lang`` stays as it was. Null and empty texts, texts without letters and undecided ones go.

    Where no row has a text and a label, no language can be learned: all texts with letters stay.
    Each row is judged by its text alone, so null and repeated ids and repeated rows make no
    difference; columns named like the model's results come back as they were. An empty table stays empty.
    """
    model = language.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    apart, names = set_apart(docs)
    found = language.identify(apart, model, names["text"])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*given_back(names))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows with a null id are last in order, and rows that share an id are judged each by its own
    text: of copies one stays, whatever their ids, and a document that is like no other always does. Texts that
    are null, empty or without words are like no other, but of wholly repeated rows one stays.
    """
    return near_dups.without_near_duplicates(docs, percent=80, how=BANDING)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur elsewhere; a text may become empty, and a null one does.

    Ids are not looked at. Repeated rows are copies of one another and lose what they share.
    ``n_chars`` follows the text; all other columns, whatever their names, stay as they were.
    """
    apart, names = set_apart(docs)
    made = [c for c in docs.columns if c not in ("text", "n_chars")]
    cleaned = suffix_dedup.remove_repeats(apart.select(*[names[c] for c in made], names["text"]), 200, text=names["text"], with_text=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(names[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each piece that is taken, repeats included.

    Null ids and sources are ids and sources like others; texts without words have no piece;
    rows alike in every column count as copies of one, with the pieces of all. Other columns pass through.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a sequence. Null and empty texts are their end token alone; every row is packed, null and repeated ids included."""
    return packing.pack(docs, 2048)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing, suffix arrays and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What each but the last returns is written to the shared folder and deleted when the next one has been written; the last of them is what the result reads."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
