"""Near duplicates by min-max hashing, banding, and exact confirmation.

Each of half as many hash functions as the signature has values gives its smallest and its
largest value over a document's shingles, both unbiased for the Jaccard likeness. Bands of
the signature name candidates; every link is confirmed on the full shingle sets; connected
components of confirmed links are the groups.

Documents with equal sets are one class first, so copies cost one row. In a bucket, each
class is first held against the bucket's smallest class. What that leaves unjoined is held
against each other by signatures alone; texts go only to the classes that this leaves a
partner, and links are confirmed where they lie, so that only links leave the bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .arrow import by_bytes, tidy
from .common import cut, given_back, join_salted, ranked, row_keys, set_apart
from .components import connected_components

_U = np.uint64
#: Rows of a bucket that are compared with one another in one task, times two.
BLOCK = 1000


@dataclass(frozen=True)
class Banding:
    """``bands`` x ``rows`` signature values from half as many hash functions.

    At a likeness of 0.85, 24 bands of 5 miss a link with a probability under 1e-6.
    ``slack``: standard deviations below the threshold at which signatures rule a pair out.
    """

    bands: int = 24
    rows: int = 5
    words: int = 5
    seed: int = 3
    slack: float = 6.0


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1 << 12, np.uint64)
np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full((1 << 12) - 1, _BASE))), out=_POWERS)


_WHITE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of a text that are hashed together, up to the next white space.
STRIDE = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (bytes between white space, A-Z lower-cased), in order."""
    out, low = [], 0
    while low < len(text):
        gap = _WHITE.search(text, low + STRIDE)
        high = gap.start() if gap else len(text)
        out.append(_hashed(text[low:high]))
        low = high
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashed(text: bytes) -> np.ndarray:
    x = _FOLD[np.frombuffer(text, np.uint8)]
    space = _SPACE[x]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64)
    place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) if first[0] == 0 else None
    if place is None:
        lead = first[0]
        place = np.concatenate((np.zeros(lead, np.int64), np.arange(lead, len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))))
    power = _POWERS[place & 4095]
    far = np.flatnonzero(place >= 4096)  # by the place alone, so a word's hash does not depend on the words beside it
    power[far] *= _mix((place[far] >> 12).astype(np.uint64) + _U(1))
    value = np.where(space, _U(0), _BYTE[x] * power)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return _mix(total[stop] - total[first] + (stop - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; of all words, if fewer; empty without words."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    k = min(words, n)
    h = np.full(n - k + 1, _U(k))
    for i in range(k):
        h = _mix(h * _BASE + w[i : n - k + 1 + i])
    return np.unique(h)


def signatures(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """len(sets) x n values of 32 bits: the minimum and the maximum under each of n / 2 hash functions. Sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    rng = np.random.default_rng(seed)
    out = np.empty((len(sets), n), np.uint32)
    for k, (a, b) in enumerate(rng.integers(1, 1 << 63, (n // 2, 2), dtype=np.uint64)):
        h = (flat ^ b) * (a | _U(1))
        h = ((h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15) >> _U(32)).astype(np.uint32)
        out[:, 2 * k] = np.minimum.reduceat(h, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(h, starts)
    return out


def sketch(docs: DataFrame, how: Banding, doc_id: str, text: str) -> DataFrame:
    """(id, n_shingles, set1, set2, signature): set1, set2 are 128 bits of the whole set; all three null without words."""
    kind = docs.schema[doc_id].dataType.simpleString()
    n = how.bands * how.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, 1):
                sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", how.words) for t in part.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                marks: list = [None] * len(sets)
                digest: list = [(None, None)] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], n, how.seed)):
                        marks[i] = row.tobytes()
                        d = xxhash.xxh3_128_digest(sets[i].tobytes())
                        digest[i] = (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()), pa.array(marks, pa.binary())],
                    ["id", "n_shingles", "set1", "set2", "signature"],
                )

    return docs.select(doc_id, text).mapInArrow(tidy(run), f"id {kind}, n_shingles long, set1 long, set2 long, signature binary")


def band_keys(signature: str, how: Banding) -> Column:
    """A hash of each band of the signature and its number."""
    step = 4 * how.rows
    return F.array(*[F.xxhash64(F.lit(k), F.substring(signature, 1 + k * step, step)) for k in range(how.bands)])


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    met = int(np.count_nonzero(merged[1:] == merged[:-1]))  # equal neighbours
    return 100 * met >= percent * (len(merged) - met)


def packed_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, z): texts compressed, as they only travel from here on."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(t.as_buffer().to_pybytes()) for t in b.column(1)], pa.binary())], ["id", "z"])

    return docs.select(doc_id, text).where(F.col(text).isNotNull()).mapInArrow(tidy(run), f"id {kind}, z binary")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets meet 100 * intersection >= percent * union. ``texts``: (id, z).

    The text of b goes to a's rows by joins that may be split, so a class with very many
    candidates spreads over tasks; each task keeps a's set while its rows pass.
    """
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").select("a", "b", "za", "zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, unpack = None, None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                z = batch.column(2)[i].as_py()
                if z != held:
                    held, own = z, shingle_set(unpack(z), words)
                other = shingle_set(unpack(batch.column(3)[i].as_buffer()), words)
                if alike(own, other, percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(tidy(run), f"a {kind}, b {kind}")


class _Meeting:
    """Rows of a bucket that meet in one task, and which pairs of them their signatures leave."""

    def __init__(self, rows: list[dict], percent: int, how: Banding):
        n, j = how.bands * how.rows, percent / 100
        self.least = int(np.floor(n * j - how.slack * np.sqrt(n * j * (1 - j))))
        self.rows, self.width, self.band, self.whole = rows, how.rows, rows[0]["band"], rows[0]["low"] == rows[0]["high"]
        self.own = np.array([r["own"] for r in rows])
        self.sig = np.stack([np.frombuffer(r["signature"], np.uint32) for r in rows])
        self.group = np.unique(np.array([r["component"] for r in rows]), return_inverse=True)[1]

    def partners(self, i: int) -> np.ndarray:
        """Earlier rows of other groups with enough equal values. A pair that an earlier band has in one bucket too is left to that."""
        others = np.flatnonzero((self.group[:i] != self.group[i]) & (self.whole | (self.own[:i] != self.own[i])))
        if not len(others):
            return others
        same = self.sig[others] == self.sig[i]
        near = same.sum(1) >= self.least
        others, same = others[near], same[near]
        if self.band and len(others):
            others = others[~same[:, : self.band * self.width].reshape(len(others), self.band, self.width).all(2).any(1)]
        return others


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket and pair of blocks, which come together; none that has a single row."""
    place, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if (r["bucket"], r["low"], r["high"]) != place:
                if len(rows) > 1:
                    yield rows
                place, rows = (r["bucket"], r["low"], r["high"]), []
            rows.append(r)
    if len(rows) > 1:
        yield rows


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "id")


def _survivors(residue: DataFrame, percent: int, how: Banding) -> DataFrame:
    """(bucket, low, high, own, band, id, component, signature): rows of ``residue`` that signatures leave with a partner, once for each meeting.

    ``residue``: (bucket, band, size, id, component, signature), of buckets in which more
    than one group is left, ``size`` their rows. A bucket of more than BLOCK rows is dealt
    in pairs of blocks.
    """
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    dealt = residue.withColumn("parts", F.ceil(F.col("size") / F.lit(BLOCK)).cast("long")).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "band", "id", "component", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield b

        for rows in _meetings(watched()):
            m, left = _Meeting(rows, percent, how), np.zeros(len(rows), bool)
            for i in range(1, len(rows)):
                met = m.partners(i)
                left[met] = True
                left[i] |= len(met) > 0
            kept = [r for r, k in zip(rows, left.tolist()) if k]
            if kept:
                yield pa.RecordBatch.from_pylist(kept, schema=schema)

    return _together(dealt).mapInArrow(tidy(run), dealt.schema)


def _linked(met: DataFrame, percent: int, how: Banding) -> DataFrame:
    """(a, b): confirmed links between groups that share a bucket; per meeting at most enough to join its groups. ``met``: survivors and their texts, z."""
    kind = met.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for rows in _meetings(batches):
            m, sets, found = _Meeting(rows, percent, how), {}, []

            def full(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingle_set(unpack(rows[k]["z"]), how.words)
                return sets[k]

            for i in range(1, len(rows)):
                for k in m.partners(i).tolist():
                    if m.group[k] != m.group[i] and alike(full(i), full(k), percent):
                        found.append((rows[k]["id"], rows[i]["id"]))
                        m.group[m.group == m.group[k]] = m.group[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b"])

    return _together(met).mapInArrow(tidy(run), f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, how: Banding = Banding(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per document.

    component_id is the smallest id that confirmed links reach, the document's own
    included; kept says whether it is that. Documents without words (or null text) are
    linked with nothing, nor are those with a null id, which are kept. Ids must be
    unique: texts that share one are taken for one document's, and their groups become one
    (``without_near_duplicates`` takes any ids). Empty input, no rows. Other columns are not read.

    Copies meet their class, and classes their buckets, in joins that deal large groups
    over tasks.
    """
    rows = cut(sketch(docs, how, doc_id, text), free=True)
    sets = ["set1", "set2"]
    usable = F.col("set1").isNotNull() & F.col("id").isNotNull()
    classes = cut(rows.where(usable).groupBy(*sets).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min("signature").alias("signature")))
    spread = classes.select(F.col("rep").alias("id"), F.posexplode(band_keys("signature", how)).alias("band", "bucket"))
    shared = cut(spread.groupBy("bucket").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1"))
    in_shared = cut(join_salted(spread, shared, ["bucket"], "n"), free=True)
    stars = cut(in_shared.where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
    texts = cut(packed_texts(docs, doc_id, text).join(in_shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "z"]), free=True)
    links = cut(confirm(stars, texts, percent, how.words), free=True)
    found = connected_components(links)
    placed = in_shared.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x != y")
    open_ = cut(open_.select("bucket", "n", F.col("n").alias("size")))
    residue = join_salted(placed, open_, ["bucket"], "n").join(classes.select(F.col("rep").alias("id"), "signature"), "id")
    again = cut(_linked(_survivors(residue, percent, how).join(texts, "id"), percent, how), free=True)
    # the groups so far are the nodes now: few of them meet
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    met = again.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(met).select(F.col("node").alias("group"), F.col("component").alias("final"))
    grouped = cut(classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*sets, "n", F.coalesce("component", "rep").alias("group")))
    sizes = cut(grouped.groupBy("group").agg(F.count("*").alias("classes")).join(joined, "group"))
    ends = cut(join_salted(grouped, sizes, ["group"], "classes", "left").select(*sets, "n", F.coalesce("final", "group").alias("component")))
    # rows that are in no class have keys that no class has, and none has two of them
    apart = F.monotonically_increasing_id()
    keyed = rows.select("id", "n_shingles", *[F.when(usable, F.col(c)).otherwise(apart).alias(c) for c in sets])
    out = join_salted(keyed, ends, sets, "n", "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(doc_id), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, how: Banding = Banding(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all documents of a group of near duplicates but that with the smallest id; all columns pass through, whatever their names.

    Ids may be null or repeated: such rows are numbered in order of id (null last) and
    content, and judged like any others, so a group keeps one row whatever its ids.
    Null and empty texts and texts without words are like nothing and stay, but of rows alike in
    every column one stays. Empty input, no rows.
    """
    apart, names = set_apart(docs)
    i = names[doc_id]
    n, named = apart.agg(F.count("*"), F.count(i)).first()
    if n == named == apart.select(i).distinct().count():
        kept = near_duplicates(apart, percent, how, i, names[text]).where("kept").select(i)
        return apart.join(kept, i, "left_semi").select(*given_back(names))
    keyed = row_keys(apart, "_k1", "_k2")
    places = cut(ranked(keyed.select(i, "_k1", "_k2").distinct(), F.col(i).asc_nulls_last(), F.asc("_k1"), F.asc("_k2")).select("_k1", "_k2", "_i"))
    given = keyed.join(places, ["_k1", "_k2"]).withColumn("_copy", F.row_number().over(W.partitionBy("_k1", "_k2").orderBy(F.lit(0)))).where("_copy = 1")
    kept = near_duplicates(given.select("_i", names[text]), percent, how, "_i", names[text]).where("kept").select("_i")
    return given.join(kept, "_i", "left_semi").select(*given_back(names))
