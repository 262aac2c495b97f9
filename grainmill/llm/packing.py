"""Packing token streams into sequences by order-preserving dynamic programming.

The documents of a partition, in order, are one stream of tokens. Where to cut it is found
by dynamic programming over document ends and sentence ends (and, in stretches without
either, places a quarter and, from lengths of 128 on, a 64th of the length apart): the cost
of a sequence is its padding and a fixed charge, the cost of a cut is 0 after a document,
more inside it. With f the least cost up to a cut and x its place, f(j) = min over
x(j) - x(i) <= L of f(i) + x(i), plus L - x(j): a sliding minimum that a monotone queue
keeps. A sequence of a power of two tokens has no padding; predecessors at such a distance,
from a sixteenth of the length on, are looked up besides.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import tidy
from .tokens import _byte_alphabet, default_path, word_bpe

SENTENCE_MARKS = (".", "!", "?", "…", "。", "．", "｡", "！", "？", "؟", "۔", "।", "॥", "።", "။", "។", "։")
#: Tokens between two searches; the tail after the last good cut goes on to the next one.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Costs:
    """In tokens of padding. ``sequence``: the place in a batch that each sequence takes, however short; more than a cut inside, so that the next document is cut to fill a sequence."""

    sentence: int = 4
    inside: int = 48
    sequence: int = 64


def choose_cuts(ends: np.ndarray, sentences: np.ndarray, n: int, length: int, last: bool, costs: Costs = Costs()) -> list[int]:
    """Places to cut a stream of ``n`` tokens, ascending, the first above 0.

    ``ends``: places after a document, ``sentences``: places after a sentence. If ``last``
    the final cut is ``n``, else the cheapest within the last ``length`` tokens.
    """
    cost = np.full(n + 1, -1, np.int32)
    cost[sentences] = costs.sentence
    cost[ends] = 0
    cost[0] = 0
    if cost[n] < 0:
        cost[n] = costs.inside
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > min(costs.inside, length // 4))
    step = length // 64  # a quarter of short lengths costs less than a cut inside: none for them
    step = step if step > 1 else 0
    for i in wide:  # a stretch without a place to cut
        if gaps[i] > length // 4:
            cost[np.arange(at[i] + length // 4, at[i + 1], length // 4)] = costs.inside
        if step and gaps[i] > costs.inside:
            cost[np.arange((at[i] // step + 1) * step, at[i + 1], step)] = costs.inside
    if len(wide):
        at = np.flatnonzero(cost >= 0)
    x, pay = at.tolist(), cost[at].tolist()
    # (place, place a power of two before it), ascending
    met = []
    p = 1 << max(0, (length // 16).bit_length() - 1)
    while p <= length:
        i = np.searchsorted(at, at - p)
        hit = np.flatnonzero((at >= p) & (at[np.minimum(i, len(at) - 1)] == at - p))
        met.append(np.stack((hit, i[hit])))
        p *= 2
    met = np.concatenate(met, axis=1)
    met = met[:, np.argsort(met[0], kind="stable")]
    later, earlier = [*met[0].tolist(), -1], met[1].tolist()
    f, back = [0] * len(x), [0] * len(x)
    sums, places, head, e = [0], [0], 0, 0  # the queue: f + x, ascending, and the index
    for j in range(1, len(x)):
        here = x[j]
        while x[places[head]] < here - length:
            head += 1
        i = places[head]
        best = sums[head] + length - here
        while later[e] == j:
            if f[earlier[e]] < best:
                i = earlier[e]
                best = f[i]
            e += 1
        best += pay[j] + costs.sequence
        f[j], back[j] = best, i
        while len(sums) > head and sums[-1] >= best + here:
            sums.pop()
            places.pop()
        sums.append(best + here)
        places.append(j)
    j = len(x) - 1
    if not last:
        first = bisect_right(x, n - length)
        j = min(range(max(1, first), len(x)), key=lambda i: (f[i] - x[i] // length, -i))
    cuts = []
    while j > 0:
        cuts.append(x[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs one partition's documents, a chunk at a time."""

    def __init__(self, length: int, sentence_ids: np.ndarray, first_sequence: int, with_ids: bool, costs: Costs = Costs(), split_marks: tuple[tuple[int, ...], ...] = ()):
        self.split_marks = split_marks  # sentence marks that are more than one token
        self.length, self.sentence_ids, self.sequence, self.with_ids, self.costs = length, sentence_ids, first_sequence, with_ids, costs
        self.docs: list[tuple[object, int, int, bytes]] = []  # id, start of these tokens in it, its tokens, ids
        self.held = 0

    def add(self, doc_id: object, ids: bytes) -> None:
        self.docs.append((doc_id, 0, len(ids) // 4, ids))
        self.held += len(ids) // 4

    def pieces(self, last: bool) -> list[tuple]:
        """(doc_id, start, length, crc32, doc_tokens, sequence, offset, ids) for what is cut now."""
        if not self.docs:
            return []
        raw = b"".join(d[3] for d in self.docs)
        ids = np.frombuffer(raw, "<u4")
        n = len(ids)
        begin = np.zeros(len(self.docs) + 1, np.int64)
        np.cumsum([len(d[3]) // 4 for d in self.docs], out=begin[1:])
        known = ids < len(self.sentence_ids)
        ends = begin[1:]
        closes = self.sentence_ids[np.where(known, ids, 0)] & known
        for mark in self.split_marks:
            at = np.flatnonzero(ids == mark[-1])
            for back, i in enumerate(reversed(mark)):
                at = at[(at >= back) & (ids[at - back] == i)]
            closes[at] = True
        sentences = np.flatnonzero(closes) + 1
        cuts = choose_cuts(ends, sentences, n, self.length, last, self.costs)
        stop = cuts[-1]
        edge = np.unique(np.concatenate(([0], cuts, begin[begin < stop])))
        starts, stops = edge[:-1], edge[1:]
        doc = np.searchsorted(begin, starts, side="right") - 1
        sequence = np.searchsorted(cuts, starts, side="right")
        seq_start = np.concatenate(([0], cuts))[sequence]
        out = []
        for a, b, d, s, o in zip(starts.tolist(), stops.tolist(), doc.tolist(), sequence.tolist(), (starts - seq_start).tolist()):
            doc_id, base, total, _ = self.docs[d]
            part = raw[4 * a : 4 * b]
            out.append((doc_id, base + a - int(begin[d]), b - a, zlib.crc32(part), total, self.sequence + s, o, part if self.with_ids else None))
        self.sequence += len(cuts)
        d = int(np.searchsorted(begin, stop, side="right") - 1)
        rest = []
        if stop < n:
            doc_id, base, total, b = self.docs[d]
            skip = stop - int(begin[d])
            rest = [(doc_id, base + skip, total, b[4 * skip :]), *self.docs[d + 1 :]]
        self.docs, self.held = rest, n - stop
        return out


def pack(
    docs: DataFrame, length: int = 2048, path: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, costs: Costs = Costs()
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document's tokens are its text's ids and then ``end_id``; null and empty texts have
    only that. Each partition is packed alone, in the order of its rows, and no row moves;
    its last sequence may be short. Memory is bounded by a chunk and the longest document.
    Repeated rows are packed each. Empty input, no rows; other columns are not read.
    """
    path = path or default_path()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        table = np.zeros(len(bpe.ends_word), bool)
        shown = {b: c for c, b in _byte_alphabet().items()}
        marks = tuple("".join(shown[b] for b in m.encode()) for m in SENTENCE_MARKS)
        table[[i for s, i in bpe.tokenizer.get_vocab(with_added_tokens=False).items() if s.removesuffix("</w>").endswith(marks)]] = True
        table &= bpe.ends_word
        alone = [tuple(bpe.tokenizer.encode(m, add_special_tokens=False).ids) for m in SENTENCE_MARKS]
        split = tuple(ids for ids in alone if len(ids) > 1 and not table[ids[-1]])
        packer = Packer(length, table, TaskContext.get().partitionId() << 33, with_ids, costs, split)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for i, ids in zip(b.column(0), bpe.encode(t.as_py() for t in b.column(1))):
                packer.add(i.as_py(), ids + end)
                if packer.held >= CHUNK:
                    yield rows(packer.pieces(False), b.schema.field(0).type)
            id_type = b.schema.field(0).type
        if packer.docs:
            yield rows(packer.pieces(True), id_type)

    def rows(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*pieces)) if pieces else [[] for _ in range(8)]
        arrays = [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
        names = [doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(p, "<i4") for p in cols[7]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(doc_id, text).mapInArrow(tidy(run), schema)
