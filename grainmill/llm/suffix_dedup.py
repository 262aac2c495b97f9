"""Removal of repeated passages by suffix arrays built in two stages.

A text's windows (every ``length`` bytes) are dealt by anchors: the window's anchor is the
place in it whose 64-byte string has the smallest hash, leftmost on ties, so equal windows
have equal anchors at equal offsets. Windows of one anchor make a block of text. Anchors
whose hash occurs once hold no repeated window. Blocks that occur twice or more are
repeated throughout. Where one hash has differing blocks, they come together and are
sorted: suffixes smaller than their successors directly, the others induced by bucket
scans; neighbours with a common prefix of ``length`` bytes are repeated windows.

A hash with very many differing blocks is dealt over several tasks; what no task can see
alone, windows that are equal across its tasks, is counted by a 128-bit hash of each
window's class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import by_bytes, tidy
from .common import cut, given_back, join_salted, set_apart

#: Bytes of an anchor's string; at most the window's length.
ANCHOR = 64
#: Starts looked at together, below 2^24 for the packed positions.
STRIDE = 1 << 20
#: Text of blocks that one suffix array holds, or that of one hash's share of them, if that is more.
SORTED_BYTES = 1 << 18
#: Differing blocks of one hash that one task gets.
SALTED = 8192

_U = np.uint64
_BYTE = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW24 = _U((1 << 24) - 1)


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) of each run of windows with one anchor; none for texts under ``length`` bytes."""
    hashes, firsts, lasts = [], [], []
    for low in range(0, max(0, len(text) - length + 1), STRIDE):
        x = np.frombuffer(text, np.uint8, count=min(STRIDE + length - 1, len(text) - low), offset=low)
        span = min(ANCHOR, length)
        h, done, p = _BYTE[x], 1, 0x9E3779B97F4A7C15
        while done < span:  # doubling; the last step may overlap
            step = min(done, span - done)
            h = h[: len(h) - step] * _U(p if step == done else pow(0x9E3779B97F4A7C15, step, 1 << 64)) + h[step:]
            p = p * p & (1 << 64) - 1
            done += step
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        key = (h & ~_LOW24) | np.arange(len(h), dtype=np.uint64)
        wide, done = length - span + 1, 1
        while done * 2 <= wide:
            key = np.minimum(key[:-done], key[done:])
            done *= 2
        if done < wide:
            key = np.minimum(key[: len(key) - (wide - done)], key[wide - done :])
        at = (key & _LOW24).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        hashes.append(h[at[first]].view(np.int64))
        firsts.append(first + low)
        lasts.append(np.append(first[1:], len(at)) - 1 + low)
    if not hashes:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def words8(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros after the end."""
    k = np.concatenate((x, np.zeros(8, np.uint8))).astype(np.uint64)
    for s in (1, 2, 4):
        k = (k[:-s] << _U(8 * s)) | k[s:]
    return k[: len(x)]


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``x``, ordered by at least their first ``depth`` bytes; equal ones stand together.

    Stage one sorts the suffixes that are smaller than their successors, eight bytes at a
    time, only ties going on. Stage two scans the buckets of first bytes upwards: a suffix
    found there puts its predecessor, if that is the larger of the two, at the next free
    place of its own bucket.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int32)
    up, level = np.append(x[1:] > x[:-1], False), np.append(x[1:] == x[:-1], False)
    turn = np.arange(n, dtype=np.int32)
    turn[level] = n - 1  # the last place is never level
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    smaller = up[turn]
    del up, level, turn
    direct = np.flatnonzero(smaller).astype(np.int32)
    direct = _sorted_to(direct, words8(x), depth)
    heads = np.searchsorted(x[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, here: int) -> np.ndarray:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        first = x[before]
        same = first == here
        others, chars = before[~same], first[~same]
        if len(others):
            order = np.argsort(chars, kind="stable")
            others, chars = others[order], chars[order]
            edges = np.flatnonzero(np.diff(chars)) + 1
            for part, c in zip(np.split(others, edges), chars[np.concatenate(([0], edges))].tolist()):
                waiting[c].append(part)
        return before[same]

    waiting[int(x[n - 1])].append(np.array([n - 1], np.int32))
    for c in range(256):
        while waiting[c]:
            now = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(now)
            more = induce(now, c)
            if len(more):
                waiting[c].append(more)
        now = direct[heads[c] : heads[c + 1]]
        if len(now):
            out.append(now)
            induce(now, c)
    return np.concatenate(out)


def _sorted_to(at: np.ndarray, key8: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the ``depth`` bytes from each place on."""
    n = len(key8)
    k = key8[at]
    by = np.argsort(k, kind="stable")
    order, k = at[by], k[by]
    del by
    tied, group = _ties(k[1:] != k[:-1])
    done = 8
    while len(tied) and done < depth:
        sub = order[tied]
        place = sub + np.int32(done)
        k = np.where(place < n, key8[np.minimum(place, n - 1)], _U(0))
        by = np.lexsort((k, group))
        order[tied], group, k = sub[by], group[by], k[by]
        still, within = _ties((group[1:] != group[:-1]) | (k[1:] != k[:-1]))
        tied, group = tied[still], within
        done += 8
    return order


def _ties(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, ``new`` where one differs from the row before: the places of those that have an equal, and the numbers of their groups."""
    if not len(new):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    tied = np.flatnonzero(np.append(False, ~new) | np.append(~new, False)).astype(np.int32)
    return tied, np.cumsum(np.append(0, new), dtype=np.int32)[tied]


def repeated_starts(blocks: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, twice, leads) over the blocks laid end to end, a zero between.

    ``starts``: the windows' places in suffix order; ``twice``: whether a neighbour shares
    ``length`` bytes; ``leads``: whether it is the first of its equals. Bytes are shifted
    up by one, which UTF-8 allows, to free zero.
    """
    raw = b"\xff".join(blocks) + b"\xff"
    x = np.frombuffer(raw, np.uint8) + np.uint8(1)
    sizes = np.array([len(b) for b in blocks])
    ends = np.cumsum(sizes + 1) - 1
    order = suffix_array(x, length)
    rest = np.repeat(ends.astype(np.int32), sizes + 1) - np.arange(len(x), dtype=np.int32)
    starts = order[rest[order] >= length]
    del order, rest
    key8 = words8(x)
    same = np.arange(1, len(starts), dtype=np.int32)
    for o in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[key8[starts[same] + o] == key8[starts[same - 1] + o]]
    common = np.zeros(len(starts) + 1, bool)
    common[same] = True
    return x, starts, common[:-1] | common[1:], ~common[:-1]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true."""
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _occurrences(texts: DataFrame, length: int, hashes_only: bool) -> DataFrame:
    """Anchors of (u, text): h, and unless ``hashes_only`` the block's own hash g, u and its place (first start, number of windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, 1, rows=512):
                hs, gs, us, ats = [], [], [], []
                for u, t in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = t.as_buffer().to_pybytes()
                    h, first, last = anchors(raw, length)
                    if not len(h):
                        continue
                    hs.append(h)
                    if not hashes_only:
                        gs.append(np.array([xxhash.xxh3_64_intdigest(raw[i : j + length]) for i, j in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64))
                        us.append(np.full(len(h), u, np.int64))
                        ats.append((first << 16) | (last - first))
                if hs:
                    cols = [hs] if hashes_only else [hs, gs, us, ats]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h", "g", "u", "at"][: len(cols)])

    return texts.mapInArrow(tidy(run), "h long" if hashes_only else "h long, g long, u long, at long")


def _block_text(wanted: DataFrame, length: int) -> DataFrame:
    """(h, salt, salts, g, n, block): the blocks of ``wanted`` (u, text, blocks), cut from the text; from each copy of it in another task too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            for u, t, blocks in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = t.as_buffer().to_pybytes()
                own = (u, xxhash.xxh3_64_intdigest(raw))
                if own in seen:  # a copy
                    continue
                seen.add(own)
                rows = []
                for w in blocks.as_py():
                    first, more = w["at"] >> 16, w["at"] & 0xFFFF
                    part = raw[first : first + more + length]
                    if np.uint64(xxhash.xxh3_64_intdigest(part)).view(np.int64) == w["g"]:  # else another text of the same u
                        rows.append((w["h"], w["salt"], w["salts"], w["g"], w["n"], part))
                if rows:
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*rows))[:5]], pa.array([r[5] for r in rows], pa.binary())], ["h", "salt", "salts", "g", "n", "block"])

    return wanted.select("u", "text", "blocks").mapInArrow(tidy(run), "h long, salt long, salts long, g long, n long, block binary")


def _sort_blocks(blocks: DataFrame, length: int) -> DataFrame:
    """(h, g, n, low, high, w1, w2): runs of repeated windows in a block (w1 null), and, for hashes dealt over tasks, each class of windows by its hash."""
    dealt = blocks.repartition("h", "salt").sortWithinPartitions("h", "salt", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            raw = [r[4] for r in held]
            x, starts, twice, leads = repeated_starts(raw, length)
            begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
            again = np.zeros(len(x), bool)
            again[starts[twice]] = True
            del x, twice
            rows = []
            for (h, g, n, salts, block), a in zip(held, begin.tolist()):
                windows = len(block) - length + 1
                if n > 1:
                    rows.append((h, g, n, 0, windows - 1, None, None))
                else:
                    rows += [(h, g, n, p, q, None, None) for p, q in zip(*(v.tolist() for v in _runs(again[a : a + windows])))]
            if any(r[3] > 1 for r in held):
                which = np.searchsorted(begin, starts[leads], side="right") - 1
                for s, k in zip(starts[leads].tolist(), which.tolist()):
                    h, g, n, salts, block = held[k]
                    if salts > 1:
                        low = s - int(begin[k])
                        d = xxhash.xxh3_128_digest(block[low : low + length])
                        rows.append((h, g, n, low, low, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["h", "g", "n", "low", "high", "w1", "w2"])

        for b in batches:
            for h, salt, salts, g, n, block in zip(*(c.to_pylist() for c in b.columns[:5]), b.column(5)):
                if (h, salt) != last and size >= SORTED_BYTES:
                    yield from flush()
                    held, size = [], 0
                block = block.as_py()
                if held and (h, salt) == last and held[-1][1] == g:
                    continue  # a copy of the text in another task gave it too
                held.append((h, g, n, salts, block))
                size += len(block)
                last = (h, salt)
        if held:
            yield from flush()

    return dealt.mapInArrow(tidy(run), "h long, g long, n long, low long, high long, w1 long, w2 long")


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, if asked for).

    Every byte covered by a ``length``-byte string that starts anywhere else too, in the
    same document or another, goes; all copies go, and strings are judged on the input.
    Null and empty texts, and texts shorter than ``length``, lose nothing. Repeated rows
    are copies of one another. A cut may fall inside a character: the digest is over the
    bytes, and kept_text leaves out what is no character any more. Empty input, no rows.
    Columns of these five names are replaced; all others pass through.

    Anchors, blocks and texts that a large share of the rows have are dealt over tasks in
    every join that they are a key of.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    apart_docs, names = set_apart(docs)
    own = {c: n for c, n in names.items() if c not in (text, *made)}
    whole = F.coalesce(F.col(names[text]), F.lit(""))
    rows = apart_docs.select(*own.values(), whole.alias("text"), F.xxhash64(whole).alias("u"))
    texts = rows.select("u", "text")
    long_enough = texts.where(F.octet_length("text") >= length)
    counts = cut(_occurrences(long_enough, length, True).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    found = cut(join_salted(_occurrences(long_enough, length, False), counts, ["h"], "c"), free=True)
    # distinct blocks first: a hash met everywhere is few rows from here on
    per_block = found.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("u", "at")).alias("one"))
    per_hash = cut(per_block.groupBy("h").agg(F.count("*").alias("blocks"), F.count("*").alias("k")))
    block = cut(join_salted(per_block, per_hash, ["h"], "blocks"), free=True)
    chosen = block.where("k > 1").withColumn("salts", F.ceil(F.col("k") / F.lit(SALTED)).cast("long")).select(
        F.col("one.u").alias("u"), F.struct("h", F.pmod("g", "salts").alias("salt"), "salts", "g", "n", F.col("one.at").alias("at")).alias("b")
    )
    copies = cut(texts.groupBy("u").agg(F.count("*").alias("copies")))
    wanted = cut(copies.join(chosen.groupBy("u").agg(F.collect_list("b").alias("blocks")), "u"))
    runs = cut(_sort_blocks(_block_text(join_salted(long_enough, wanted, ["u"], "copies"), length), length), free=True)
    classes = runs.where("w1 is not null")
    across = classes.groupBy("h", "w1", "w2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    # a class that is met again elsewhere: its windows, wherever the block has them
    crossed = classes.join(across, ["h", "w1", "w2"]).select("h", "g", "n", "low", "high")
    whole_blocks = block.where("k = 1").select("h", "g", "n", F.lit(0).cast("long").alias("low"), F.col("one.at").bitwiseAND(F.lit(0xFFFF)).alias("high"))
    parts = runs.where("w1 is null").select("h", "g", "n", "low", "high").unionByName(crossed).unionByName(whole_blocks)
    spans = cut(parts.groupBy("h", "g").agg(F.max("n").alias("n"), F.collect_set(F.struct("low", "high")).alias("spans")))
    hit = join_salted(found, spans, ["h", "g"], "n").select("u", F.struct("g", "at", "spans").alias("mark"))
    marks = hit.groupBy("u").agg(F.collect_set("mark").alias("marks"))
    marked = cut(copies.join(marks, "u"), free=True)
    return _cut_out(join_salted(rows, marked, ["u"], "copies", "left").select(*own.values(), "text", "marks"), own, length, with_text)


def _cut_out(marked: DataFrame, own: dict[str, str], length: int, with_text: bool) -> DataFrame:
    names = list(own.values())
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    made += [T.StructField("kept_text", T.StringType())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(names)
        for whole in batches:
            for b in by_bytes(whole, at, rows=2048):
                rows = []
                for t, marks in zip(b.column(at), b.column(at + 1)):
                    raw = t.as_buffer().to_pybytes()
                    n, spans, rest = len(raw), 0, raw
                    if marks.is_valid:
                        change = np.zeros(n + 1, np.int32)
                        for m in marks.as_py():
                            first, more = m["at"] >> 16, m["at"] & 0xFFFF
                            if np.uint64(xxhash.xxh3_64_intdigest(raw[first : first + more + length])).view(np.int64) == m["g"]:
                                for s in m["spans"]:
                                    if first + s["high"] + length <= n:
                                        change[first + s["low"]] += 1
                                        change[first + s["high"] + length] -= 1
                        gone = np.cumsum(change[:-1]) > 0
                        spans = len(_runs(gone)[0])
                        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    rows.append((n, n - len(rest), spans, hashlib.sha256(rest).hexdigest(), *([rest.decode("utf-8", "ignore")] if with_text else [])))
                cols = list(zip(*rows)) if rows else [[] for _ in made]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), *[pa.array(c, k) for c, k in zip(cols, types)]], [*names, *[f.name for f in made]])

    kept = [marked.schema[n] for n in names]
    return marked.mapInArrow(tidy(run), T.StructType([*kept, *made])).select(*given_back(own), *[f.name for f in made])
