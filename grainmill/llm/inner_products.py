"""Exact top-k inner products over vectors in descending length.

Components become integers. Vectors, longest first, are packed into blocks; each block
also holds its vectors turned by the singular vectors of all the data, so that the first
few coordinates carry most of an inner product and the Cauchy-Schwarz inequality bounds
the rest: q.v <= sum of the first coordinates' products + |rest of q| |rest of v|. A block
whose longest vector cannot reach a query's k-th score is not joined to it at all; inside
a block only candidates whose bound reaches that score get their exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Vectors of a data block, and queries of a query block.
BLOCK, QUERIES = 4096, 512
#: Coordinates in the partial sum.
HEAD = 16


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null for null vectors and for null or non-finite components."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers; components that a shorter vector lacks are 0."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of v v' over all rows, added up by rows of the matrix: width x width sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], ["i", "s"])

    parts = vectors.select("v").mapInArrow(run, "i int, s array<double>").select("i", F.posexplode("s"))
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "pos").agg(F.sum("col").alias("s")).collect():
        out[r["i"], r["pos"]] = r["s"]
    return out


def _pack(rows: DataFrame, size: int, width: int) -> DataFrame:
    """Consecutive rows (id, v) of each partition, ``size`` at a time: (block, ids, v, longest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ms = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for b in batches:
            ids, ms = np.concatenate((ids, np.asarray(b.column(0)))), np.concatenate((ms, _matrix(b.column(1), width)))
            while len(ids) >= size:
                yield put(ids[:size], ms[:size])
                ids, ms = ids[size:], ms[size:]
        if len(ids):
            yield put(ids, ms)

    def put(i: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        block = np.uint64(xxhash.xxh3_64_intdigest(i.tobytes() + m.tobytes())).view(np.int64)
        longest = float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max()))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([i.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([longest])], ["block", "ids", "v", "longest"])

    return rows.select("id", "v").mapInArrow(run, "block long, ids binary, v binary, longest double")


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[-1]
    if bound < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if bound >= 2**63:
        raise OverflowError("inner products beyond 64 bits")
    return q @ v.T


def search_block(q_ids, q, v_ids, v, rotation, k: int, floor_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, vec id, score) of each query's k best in the block among scores of at least ``floor_``, and how many exact products it took."""
    qr, vr = q @ rotation, v @ rotation
    head = min(HEAD, q.shape[1])
    q_rest = np.sqrt((qr[:, head:] ** 2).sum(1))
    v_rest = np.sqrt((vr[:, head:] ** 2).sum(1))
    rows, ids, scores, products = [], [], [], 0
    q_len, v_len = np.sqrt((qr**2).sum(1)), np.sqrt((vr**2).sum(1))
    tail = np.maximum.accumulate(v_len[::-1])[::-1]  # longest from here on
    slack = 1e-9 * (1 + q_len.max(initial=0) * v_len.max(initial=0))
    low = floor_.astype(np.float64).copy()
    best_s: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    best_i: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    step = 512
    for a in range(0, len(v), step):
        live = np.flatnonzero(q_len * tail[a] + slack >= low)
        if not len(live):
            break
        part = slice(a, a + step)
        bound = qr[live, :head] @ vr[part, :head].T + q_rest[live, None] * v_rest[None, part] + slack
        may = bound >= low[live, None]
        cols = np.flatnonzero(may.any(0))
        if not len(cols):
            continue
        exact = _exact(q[live], v[part][cols])
        products += exact.size
        may = may[:, cols] & (v_ids[part][cols][None] != q_ids[live][:, None])
        for n, i in enumerate(live.tolist()):
            hit = np.flatnonzero(may[n] & (exact[n] >= low[i]))
            if len(hit):
                s = np.concatenate((best_s[i], exact[n][hit]))
                d = np.concatenate((best_i[i], v_ids[part][cols][hit]))
                order = np.lexsort((d, -s))[:k]
                best_s[i], best_i[i] = s[order], d[order]
                if len(order) == k:
                    low[i] = max(low[i], s[order][-1])
    for i in range(len(q)):
        rows.append(np.full(len(best_s[i]), i))
        ids.append(best_i[i])
        scores.append(best_s[i])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(rows or [empty]), np.concatenate(ids or [empty]), np.concatenate(scores or [empty]), products)


NO_LIMIT = -(2**62)


def _begin(queries: DataFrame, top: tuple[bytes, bytes] | None, rotation: np.ndarray, width: int, k: int) -> DataFrame:
    """Query blocks with what the longest vectors gave: ``found``, ``low`` (each query's k-th score there) and ``need`` (the length under which no vector can enter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q_ids, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["v"], np.int64).reshape(-1, width)
                low = np.full(len(q_ids), NO_LIMIT)
                i, ids, scores, _ = search_block(q_ids, q, np.frombuffer(top[0], np.int64), np.frombuffer(top[1], np.int64).reshape(-1, width), rotation, k, low)
                n = np.bincount(i, minlength=len(q_ids))
                ends = np.cumsum(n)
                full = n == k
                low[full] = scores[ends[full] - 1]
                size = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                # no length helps a query of zeros that has k scores of 0 already, but ties may
                need = float(np.where(low > 0, low / np.maximum(size, 1e-12), 0.0).min())
                found = [{"query_id": a, "vec_id": c, "score": e} for a, c, e in zip(q_ids[i].tolist(), ids.tolist(), scores.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]]), pa.array([r["ids"]], pa.binary()), pa.array([r["v"]], pa.binary()), pa.array([low.tobytes()], pa.binary()), pa.array([need * (1 - 1e-9)]),
                     pa.array([found], pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])))],
                    ["q_block", "q_ids", "q", "low", "need", "found"],
                )

    return queries.mapInArrow(run, "q_block long, q_ids binary, q binary, low binary, need double, found array<struct<query_id:long,vec_id:long,score:long>>")


def _search(pairs: DataFrame, rotation: np.ndarray, width: int, k: int) -> DataFrame:
    """``pairs``: a query block and a data block a row. (query_id, vec_id, score) of the best k of each query in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                q_ids, q, low, v_ids, v = (np.frombuffer(b.column(c)[n].as_buffer(), np.int64) for c in range(5))
                i, ids, scores, _ = search_block(q_ids, q.reshape(-1, width), v_ids, v.reshape(-1, width), rotation, k, low)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return pairs.select("q_ids", "q", "low", "ids", "v").mapInArrow(run, "query_id long, vec_id long, score long")


def _level(length: Column) -> Column:
    """Lengths in steps of a sixteenth of a doubling: few values, whatever the data."""
    return F.floor(F.log2(F.greatest(length, F.lit(1e-6))) * 16).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best others, ties to the smaller id; all, if fewer.

    ``is_query`` picks the queries among the rows. Null vectors, vectors with null or
    non-finite components, and null ids take no part; shorter vectors are filled with
    zeros; empty vectors score 0. Rows with one id and several vectors are candidates
    each, but none is its own query's. Products beyond 64 bits raise. Other columns are
    not read. Empty input, no rows.

    The queries are the caller's stated set and may grow with the data: both sides are
    packed into blocks. Every query block first meets the block of the longest vectors,
    one block of bounded size; then the blocks long enough to matter, by an equi-join on
    the block's place in the order of length.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = cut(rows.where("v is not null and id is not null").withColumn("norm", F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x)))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = width or 1
    values, turned = np.linalg.eigh(_gram(rows, width))
    rotation = np.ascontiguousarray(turned[:, np.argsort(-values)])
    by_length = (F.desc("norm"), F.asc("id"))
    ordered = rows.repartitionByRange(max(1, -(-n // (4 * BLOCK))), *by_length).sortWithinPartitions(*by_length)
    place = W.orderBy(F.desc("longest"), "block")
    data = cut(_pack(ordered, BLOCK, width))
    heads = cut(data.select("block", "longest").withColumn("place", F.row_number().over(place)))
    asked = rows.where("asked").repartitionByRange(max(1, -(-n // (64 * QUERIES))), *by_length).sortWithinPartitions(*by_length)
    top = data.join(heads.where("place = 1"), "block").select("ids", "v").first()
    begun = cut(_begin(_pack(asked, QUERIES, width).select("block", "ids", "v"), (bytes(top[0]), bytes(top[1])) if top else None, rotation, width, k))
    # how many blocks are at least as long as each level
    levels = sorted(heads.groupBy(_level(F.col("longest")).alias("l")).count().collect(), reverse=True)
    reach, so_far = [], 0
    for r in levels:
        so_far += r["count"]
        reach.append((r["l"], so_far))
    last = F.coalesce(F.array_max(F.transform(F.array(*[F.struct(F.lit(x).alias("l"), F.lit(y).alias("n")) for x, y in reach]), lambda r: F.when(r["l"] >= _level(F.col("need")), r["n"]).otherwise(0))), F.lit(0)) if reach else F.lit(0)
    wanted = begun.withColumn("last", last).where("last > 1").withColumn("place", F.explode(F.sequence(F.lit(2), F.col("last"))))
    met = wanted.select("place", "q_ids", "q", "low").join(heads.select("block", "place").where("place > 1").join(data, "block"), "place")
    best = begun.select(F.explode("found").alias("f")).select("f.*").unionByName(_search(met, rotation, width, k))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
