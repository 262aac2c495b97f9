"""Hard negatives: for each anchor and each of its best positives, the rows of other labels that score next to it.

Anchors and candidates are blocks of integer vectors; a block of anchors meets a block of
candidates in one matrix product in float64, exact below 2^53. A first pass keeps each
anchor's best positives, in lists that merge; a second one, which knows the positives' scores, keeps the best negatives
inside each positive's window of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import tidy
from .common import cut
from .inner_products import NO_LIMIT, _exact, _matrix, integers

#: Vectors of a candidate block and of an anchor block, and candidates that are ranked at a time.
BLOCK, ANCHORS, STEP = 4096, 512, 512
#: Bytes of all anchor blocks up to which they are broadcast; beyond it both kinds of blocks are exchanged.
BROADCAST = 32 << 20
#: Parts into which the candidates are dealt in that exchange, and anchor blocks whose lists a task holds at a time.
PARTS, HELD = 16, 64

Pick = Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def _packed(rows: DataFrame, size: int, width: int, extra: dict[str, int] = {}, by: str | None = None) -> DataFrame:
    """Rows (id, label, v, and ``extra`` arrays of those widths) of a partition, ``size`` at a time, or those of one value of ``by``, as one row of binary columns."""
    names = ["ids", "labels", "v", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0

        def put(count: int) -> pa.RecordBatch:
            nonlocal held, n
            whole = [np.concatenate(c) for c in zip(*held)]
            out = [c[:count] for c in whole]
            held, n = ([[c[count:] for c in whole]], n - count) if n > count else ([], 0)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in out)], ["q", *names])

        for b in batches:
            keys = np.asarray(b.column(0))
            starts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
            for low, high in zip(starts, starts[1:]):
                if n and keys[low] != key:
                    yield put(n)
                key = int(keys[low])
                s = b.slice(low, high - low)
                held.append([np.asarray(s.column(1)), np.asarray(s.column(2)), _matrix(s.column(3), width), *(_matrix(s.column(4 + i), w) for i, w in enumerate(extra.values()))])
                n += high - low
                while n >= size:
                    yield put(size)
        if n:
            yield put(n)

    read = rows.select((F.col(by) if by else F.lit(0)).cast("long").alias("q"), "id", "label", "v", *extra)
    return read.mapInArrow(tidy(run), ", ".join(["q long", *(f"{x} binary" for x in names)]))


def best(key: np.ndarray, score: np.ndarray, id_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each key, ties to the smaller id."""
    order = np.lexsort((id_, -score, key))
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    keep = order[place < k]
    return key[place < k], score[keep], id_[keep]


def _lists(pairs: DataFrame, width: int, k: int, columns: list[str], pick: Pick, lists: int) -> DataFrame:
    """(anchor_id, n, id, score): for each list n of each anchor the best k of what ``pick`` lets in, of each task.

    ``pairs``: an anchor block (``columns``, ids, labels and vectors first) and a candidate block a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for ids, (key, score, id_, _) in held.items():
                a = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[key // lists]), pa.array((key % lists).astype(np.int32)), pa.array(id_), pa.array(score)], ["anchor_id", "n", "id", "score"])
            held.clear()

        for b in batches:
            for r in range(b.num_rows):
                raw = [b.column(c)[r].as_buffer().to_pybytes() for c in range(len(columns) + 3)]
                mine = dict(zip(columns, (np.frombuffer(x, np.int64) for x in raw)))
                a = mine["a_v"].reshape(-1, width)
                ids, labels, v = (np.frombuffer(x, np.int64) for x in raw[-3:])
                v = v.reshape(-1, width)
                if raw[0] not in held:
                    if len(held) >= HELD:
                        yield from flush()
                    none = np.zeros(0, np.int64)
                    held[raw[0]] = [none, none, none, np.full(len(a) * lists, NO_LIMIT)]
                state = held[raw[0]]
                for low in range(0, len(v), STEP):
                    part = slice(low, low + STEP)
                    scores = _exact(a, v[part])
                    keys, hits, cols = [state[0]], [state[1]], [state[2]]
                    for n, may in enumerate(pick(mine, scores, ids[part], labels[part], state[3].reshape(-1, lists))):
                        i, j = np.nonzero(may)
                        keys.append(i * lists + n)
                        hits.append(scores[i, j])
                        cols.append(ids[part][j])
                    if sum(map(len, keys)) == len(state[0]):
                        continue
                    state[:3] = best(np.concatenate(keys), np.concatenate(hits), np.concatenate(cols), k)
                    n_of = np.bincount(state[0], minlength=len(state[3]))
                    full = np.flatnonzero(n_of == k)
                    state[3][full] = state[1][np.cumsum(n_of)[full] - 1]
        yield from flush()

    return pairs.select(*columns, "ids", "labels", "v").mapInArrow(tidy(run), "anchor_id long, n int, id long, score long")


def _met(candidates: DataFrame, anchors: DataFrame, blocks: int, small: bool) -> DataFrame:
    """Each candidate block with each anchor block (its number is ``q``): anchors are broadcast if ``small``, else both are dealt by number and part."""
    each = candidates.drop("q").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    if small:
        return each.join(F.broadcast(anchors), "q")
    each = each.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(PARTS)))
    return each.join(anchors.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["q", "part"])


def mine(
    vectors: DataFrame, is_anchor: Column, k: int = 10, positives: int = 5, low: int = 30, high: int = 90, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's best positives.

    A row's score is the inner product of its integers (floor of ``scale`` times each component)
    with the anchor's; higher comes first, ties by the smaller id. An anchor's positives are its first ``positives``
    rows of the same label and another id; a positive's negatives are the first ``k`` rows of another label with ``low`` *
    positive_score <= 100 * negative_score <= ``high`` * positive_score (all, if fewer).

    Rows with a null id, label or vector, or a null or non-finite component, take no part.
    Shorter vectors are filled with zeros. Of rows with one id the one with the smallest
    label and vector is the anchor; as candidates they all count. Products that
    leave 64 bits raise. Other columns are not read. Empty input, or no anchor, no rows.

    The anchors are the caller's stated set and may grow with the data: they are broadcast
    only while all their blocks are under ``BROADCAST`` bytes.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), integers(F.col(vector), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    rows = cut(rows.where("id is not null and label is not null and v is not null"))
    n, width, most = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))), F.lit(0))).first()
    width = max(1, width)
    if most * most * width * max(100, high, low) >= 2**63:
        raise OverflowError("scores beyond 64 bits")
    anchors = cut(rows.where("asked").groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v"))
    n_anchors = anchors.count()
    blocks = max(1, -(-n_anchors // ANCHORS))
    small = n_anchors * 8 * (width + 2 + 2 * positives) <= BROADCAST
    candidates = cut(_packed(rows.repartition(max(1, -(-n // BLOCK))), BLOCK, width))

    def numbered(df: DataFrame, extra: dict[str, int] = {}) -> DataFrame:
        dealt = df.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition("q").sortWithinPartitions("q")
        packed = _packed(dealt, 1 << 30, width, extra, by="q")
        return packed.select("q", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("v").alias("a_v"), *extra)

    def same(a: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, least: np.ndarray) -> Iterator[np.ndarray]:
        yield (labels[None] == a["a_labels"][:, None]) & (ids[None] != a["a_ids"][:, None]) & (scores >= least)

    def others(a: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, least: np.ndarray) -> Iterator[np.ndarray]:
        other, hundred = labels[None] != a["a_labels"][:, None], 100 * scores
        target = a["p_scores"].reshape(-1, positives)
        for j in range(positives):
            t = target[:, j, None]
            yield other & (t != NO_LIMIT) & (low * np.maximum(t, -(2**56)) <= hundred) & (hundred <= high * np.maximum(t, -(2**56))) & (scores >= least[:, j, None])

    first = _lists(_met(candidates, numbered(anchors), blocks, small), width, positives, ["a_ids", "a_labels", "a_v"], same, 1)
    by_anchor = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    pos = first.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives)
    pos = cut(pos.select("anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    listed = pos.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("p", i)["positive_score"], F.lit(NO_LIMIT)))
    asked = anchors.join(listed, anchors["id"] == listed["anchor_id"]).select("id", "label", "v", filled.alias("p_scores"))
    second = _lists(_met(candidates, numbered(asked, {"p_scores": positives}), blocks, small), width, k, ["a_ids", "a_labels", "a_v", "p_scores"], others, positives)
    by_positive = W.partitionBy("anchor_id", "n").orderBy(F.desc("score"), "id")
    neg = second.withColumn("rank", F.row_number().over(by_positive)).where(F.col("rank") <= k)
    neg = neg.select("anchor_id", (F.col("n") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return neg.join(pos, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
