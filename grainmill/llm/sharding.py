"""Histogram sort: shards of equal bytes, with copies of a text beside each other.

Only DataFrame functions. A document's key is 39 bits of its text's hash above 24 bits of
its id's hash, so copies adjoin and a group of copies of any size can still be cut. Exact
bytes below candidate boundaries are counted over all partitions, and the probes between
which a splitter must lie are refined until it meets the tolerance; then rows move once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bucket_of, cut, given_back, longs, set_apart

KEY_TOP = 1 << 63
#: A part, which is sorted in one task, is about so many bytes; there are at least so many parts a shard, and so many in all at most.
PART_BYTES, LEAST_PARTS, MOST_PARTS = 128 << 20, 64, 16_384


def shard_key(text: Column, doc_id: Column) -> Column:
    """A non-negative long. Null text is as an empty one, null id as -1."""
    high = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 25)
    low = F.xxhash64(F.coalesce(doc_id, F.lit(-1))).bitwiseAND(F.lit((1 << 24) - 1))
    return F.shiftleft(high, 24).bitwiseOR(low)


@dataclass(frozen=True)
class Splitters:
    """``cuts``: a key's shard is the number of cuts below it. ``known``: exact (bytes, rows) at or below each probed key."""

    cuts: list[int]
    known: dict[int, tuple[int, int]]
    total: int
    rounds: int


def count_below(sized: DataFrame, key: str, size: str, known: dict[int, tuple[int, int]], gaps: list[tuple[int, int]], probes: int) -> bool:
    """Count, in one pass, the exact bytes and rows at or below new probes spread over the ``gaps``; false if none is left.

    At most ``probes`` + the number of gaps sums reach the driver.
    """
    asked: set[int] = set()
    for lo, hi in gaps:
        n = max(1, probes // len(gaps))
        asked |= {lo + (hi - lo) * i // (n + 1) for i in range(1, n + 1)} - {lo, hi}
    if not asked:
        return False
    at, low, high = sorted(asked), min(lo for lo, _ in gaps), max(hi for _, hi in gaps)
    found = sized.where((F.col(key) > low) & (F.col(key) <= high)).groupBy(bucket_of(F.col(key), at).alias("i")).agg(F.sum(size), F.count("*")).collect()
    counted = {r[0]: (r[1], r[2]) for r in found}
    base, rows = known[low]
    for i, k in enumerate(at):
        more = counted.get(i, (0, 0))
        base, rows = base + more[0], rows + more[1]
        known[k] = (base, rows)
    return True


def splittable(known: dict[int, tuple[int, int]], low: int, high: int) -> bool:
    return high - low > 1 and known[high][1] - known[low][1] > 1


def find_splitters(sized: DataFrame, key: str, size: str, n_shards: int, probes: int = 512, tolerance: float = 0.001, max_rounds: int = 16) -> Splitters:
    """Refine probes until each of the n_shards - 1 splitters is within ``tolerance`` of a shard's bytes.

    A splitter that no key can bring nearer (one key holds more than the tolerance) stops
    when its interval has one row or no further key.
    """
    total, rows = sized.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    want = [total * (k + 1) / n_shards for k in range(n_shards - 1)]
    near = max(1.0, tolerance * total / n_shards)
    known = {-1: (0, 0), KEY_TOP - 1: (total, rows)}
    rounds = 0
    while rounds < max_rounds and total:
        keys = sorted(known)
        below = [known[k][0] for k in keys]
        gaps = set()
        for w in want:
            i = min(max(1, bisect_left(below, w)), len(keys) - 1)
            if min(abs(below[i] - w), abs(below[i - 1] - w)) > near and splittable(known, keys[i - 1], keys[i]):
                gaps.add((keys[i - 1], keys[i]))
        if not gaps or not count_below(sized, key, size, known, sorted(gaps), probes):
            break
        rounds += 1
    keys = sorted(known)
    below = [known[k][0] for k in keys]
    cuts = []
    for w in want:
        i = min(max(1, bisect_left(below, w)), len(keys) - 1)
        cuts.append(keys[i] if abs(below[i] - w) < abs(below[i - 1] - w) else keys[i - 1])
    return Splitters(cuts, known, total, rounds)


def shard(
    docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", size: str | None = None,
    tolerance: float = 0.001, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``docs`` with ``_shard`` (from 0) and ``_slot`` (gapless from 0 in its shard, in key order).

    ``size`` names a column of bytes; without it a document weighs its text's UTF-8 bytes
    plus 1. Null texts weigh 1. Equal texts adjoin in the order, so at most one group is
    cut at each boundary. A row moves once, to one of the parts of its shard, of about
    ``part_bytes`` each (at most ``MOST_PARTS`` in all, longer ones beyond that); the parts'
    exact row counts give each its first slot, so no task holds a whole shard. Repeated rows get slots of their own. Empty input, no rows. Columns called
    _shard or _slot are replaced; all others pass through, whatever their names.
    """
    apart, names = set_apart(docs)
    i, t = F.col(names[doc_id]), F.col(names[text])
    weight = F.col(names[size]) if size else F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1
    keyed = apart.withColumn("_key", shard_key(t, i)).withColumn("_bytes", weight)
    small = cut(keyed.select("_key", "_bytes"))
    split = find_splitters(small, "_key", "_bytes", n_shards, tolerance=tolerance)
    # A shard's parts lie between probed keys; a gap that holds much more than a part is probed again.
    parts = min(max(n_shards * LEAST_PARTS, split.total // part_bytes), max(MOST_PARTS, n_shards))
    much = 4 * split.total / parts
    known = split.known
    for _ in range(8):
        keys = sorted(known)
        gaps = [(a, b) for a, b in zip(keys, keys[1:]) if known[b][0] - known[a][0] > much and splittable(known, a, b)]
        if not gaps or not count_below(small, "_key", "_bytes", known, gaps, 16 * len(gaps)):
            break
    inner = sorted({*split.cuts, *known} - {-1, KEY_TOP - 1})
    part = bucket_of(F.col("_key"), inner)
    edges = [0, *[known[k][1] for k in inner], known[KEY_TOP - 1][1]]
    shard_of, first, slot, now = [], [], 0, 0
    for p in range(len(inner) + 1):
        lowest = inner[p - 1] if p else -1
        s = bisect_right(split.cuts, lowest)
        if s != now:
            now, slot = s, 0
        shard_of.append(s)
        first.append(slot)
        slot += edges[p + 1] - edges[p]
    placed = keyed.withColumn("_part", part)
    order = W.partitionBy("_part").orderBy("_key", i.asc_nulls_last())
    out = placed.withColumn("_rank", F.row_number().over(order))
    at = lambda values: F.get(longs(values), F.col("_part"))
    return out.select(
        *given_back(names, ("_shard", "_slot")),
        at(shard_of).cast("int").alias("_shard"),
        (at(first) + F.col("_rank") - 1).cast("long").alias("_slot"),
    )
