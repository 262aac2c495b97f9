"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
MIN_LONG = -(2**63)
#: A key with more than this share of the rows is split in joins, so fewer keys than this are.
HOT_KEYS = 10_000
#: A part of a split key has at least so many rows.
HOT_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local run gets a temporary one; a cluster, whose executors would not share it, an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="grainmill-")
    return named.rstrip("/")


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    ``free``: what came before had large exchanges. Spark deletes their files when the
    driver has collected the objects that stand for them, so that is asked for here.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    if free:
        del df
        gc.collect()
        sc._jvm.System.gc()
    return out


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def set_apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns under names that no operator uses, and those names by the old ones."""
    names = {c: f"user_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def given_back(names: dict[str, str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``set_apart`` under their own names."""
    return [F.col(n).alias(c) for c, n in names.items() if c not in without]


def join_salted(many: DataFrame, few: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``many`` joined to ``few`` on ``keys``; no key's rows all meet in one task.

    ``few`` has one row a key; its column ``n`` (left out of the result) says how many rows
    of ``many`` have the key, and it is read several times, so it should be cut. A key with
    more than a ten-thousandth of all rows is dealt over parts; there are fewer than
    ten thousand such keys, so their list is small enough to broadcast, whatever the table.
    """
    total = few.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    parts = F.when(F.col(n) > most, F.ceil(F.col(n) / F.lit(most))).otherwise(1).cast("long")
    hot = F.broadcast(few.where(F.col(n) > most).select(*keys, parts.alias("_parts")))
    dealt = many.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_parts")))).drop("_parts")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(n)
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def row_keys(df: DataFrame, k1: str, k2: str) -> DataFrame:
    """``df`` with two hashes of the whole row, 128 bits together; columns with maps, which Spark does not hash, are left out."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    nulls = [c.isNull() for c in cols]  # a null leaves no trace in a hash
    return df.withColumns({k1: F.xxhash64(F.lit(1), *cols, *nulls), k2: F.xxhash64(F.lit(2), *reversed(cols), *nulls)})


def ranked(df: DataFrame, *by: Column) -> DataFrame:
    """``df`` with ``_i``, the rows' places (from 0) in that order: ranges are numbered each, and the ranges' row counts, as many as there are partitions, add up."""
    ranged = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    counts = dict(ranged.groupBy("_range").count().collect())
    first, before = [], 0
    for k in range(max(counts, default=-1) + 1):
        first.append(before)
        before += counts.get(k, 0)
    numbered = ranged.withColumn("_i", F.row_number().over(W.partitionBy("_range").orderBy(*by)) - 1)
    return numbered.withColumn("_i", F.get(longs(first), F.col("_range")) + F.col("_i")).drop("_range")


def bucket_of(value: Column, splitters: list[int]) -> Column:
    """Index of the first splitter that is >= value (len(splitters) if none is).

    ``splitters`` ascend. They are one constant, an array of about sqrt(n) runs, so that a
    row costs two short scans rather than one over all of them.
    """
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    runs = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    nested = F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    below = lambda a: F.size(F.filter(a, lambda t: t < value))
    return let(below(longs([r[-1] for r in runs])), lambda run: F.least(run * step + below(F.coalesce(F.get(nested, run), longs([]))), F.lit(len(splitters))))


def longs(values: list[int]) -> Column:
    """A constant array that stays short in the plan, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>") if values else F.array().cast("array<long>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)
