"""Encoding by a SentencePiece BPE model in time linear in the text, and decoding.

Merge-type prefix table: in merge-type (BPE) vocabularies every prefix of a text ends, once
encoded, in exactly one token. An automaton names the vocabulary strings that end at each
character; of those the prefix's last token is the one that fits the last token before it.
Two tokens fit if merging their joined text gives the two again, which is decided by playing
the merges at their border alone. The ids are then read off the table backwards.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import tidy
from .common import set_apart

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: What an unknown id decodes to.
UNKNOWN_TEXT = " ⁇ "
#: Distinct chunks of a generation, of which a process remembers two, and the longest chunk that is remembered.
MEMO, LONGEST = 180_000, 64
#: Pairs of tokens whose fit is remembered.
PAIRS = 300_000
#: A text is split into chunks in parts of about so many characters.
PART = 1 << 20
NEVER = (float("inf"), 0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    """One replacement character for each byte that belongs to no character."""
    return "�" * (e.end - e.start), e.end


codecs.register_error("grainmill-each-byte", _each_byte)


class PieceBpe:
    """One model. Models with another normaliser, without byte fallback or with pieces across white space are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n, t = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if n.name != "identity" or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only the identity normaliser with a leading space is supported")
        if t.model_type != 2 or not t.byte_fallback or t.treat_whitespace_as_suffix or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE with byte fallback and without pieces of the user is supported")
        self.pieces = [p.piece for p in model.pieces]
        # ids of equal scores merge at the leftmost place first
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank):
            raise ValueError("pieces across white space are not supported")
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.begin, self.end = self.pieces.index(t.bos_piece or "<s>"), self.pieces.index(t.eos_piece or "</s>")
        special = {UNKNOWN: UNKNOWN_TEXT.encode(), CONTROL: b""}
        self.shown = [bytes([self.bytes.index(i)]) if k == BYTE else special.get(k, p.replace(SPACE, " ").encode()) for i, (p, k) in enumerate(zip(self.pieces, kinds))]
        self.control = np.array([k == CONTROL for k in kinds])
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(self.pieces, kinds)])
        self.normal = [k == NORMAL for k in kinds]
        self.ready = False

    def _prepare(self) -> None:
        """What encoding needs beside the pieces; a worker that only decodes goes without."""
        self.ready = True
        self.left, self.right = {}, {}  # a piece's symbols at its left and right end, each with the turn that ends it
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if self.normal[i] and self._prove(i, p):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.known = {p for p in self.rank if len(p) == 1}
        #: by the first token, then the second
        self.fits: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.n_fits = 0
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        #: neighbours that stand side by side in some piece: no merge goes across any others
        self.beside = {p[n : n + 2] for p in self.rank for n in range(len(p) - 1)}
        # a word is a chunk of its own before a mark that follows a letter in no piece
        marks = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and not any(p[1] == c and p[0].isalpha() for p in self.beside))
        self.chunks = re.compile(f"{SPACE}*[^\\W\\d_]+(?=[{SPACE}\n{re.escape(marks)}])|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
        self.gap = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|(?<=\n)|(?=\n)")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _prove(self, i: int, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece; if so, its symbols at both ends and when they end are noted.

        A turn is (rank, place): the least rank merges first and of equal ranks the leftmost.
        """
        parts = [(c, i) for i, c in enumerate(piece)]
        left, right, worst = [], [], -NEVER[0]
        while len(parts) > 1:
            turns = [(self.rank.get(a[0] + b[0], NEVER[0]), a[1], n) for n, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, place, n = min(turns)
            if rank == NEVER[0]:
                return False
            worst = max(worst, rank)  # a merge waits for those it is made of
            if n == 0:
                left.append((parts[0][0], (worst, place)))
            if n == len(parts) - 2:
                right.append((parts[-1][0], (worst, place), parts[-1][1]))
            parts[n : n + 2] = [(parts[n][0] + parts[n + 1][0], parts[n][1])]
        left.append((piece, NEVER))
        right.append((piece, NEVER, 0))
        self.left[i], self.right[i] = left, right
        return True

    def fit(self, a: int, b: int) -> bool:
        """Whether token ``b`` stays apart from token ``a`` before it: no merge across their border comes before those that make them."""
        if self.n_fits >= PAIRS:
            self.fits, self.n_fits = [{} for _ in self.pieces], 0
        found = self.fits[a][b] = self._fit(self.right[a], self.left[b], len(self.pieces[a]))
        self.n_fits += 1
        return found

    def _fit(self, right: list, left: list, border: int) -> bool:
        i = j = 0
        while True:
            (r, r_ends, at), (l, l_ends) = right[i], left[j]
            l_ends = (l_ends[0], border + l_ends[1])
            across = (self.rank.get(r + l, NEVER[0]), at)
            if across[0] != NEVER[0] and across < r_ends and across < l_ends:
                return False
            if r_ends[0] == l_ends[0] == NEVER[0]:
                return True
            if r_ends < l_ends:
                i += 1
            else:
                j += 1

    def _table(self, part: str) -> bytes:
        """The ids of a part, all of whose characters are known."""
        last = [0] * (len(part) + 1) if len(part) <= LONGEST else array("i", [0]) * (len(part) + 1)
        done = -1
        for at, (i, size) in self.automaton.iter(part):
            if at != done:
                before = at + 1 - size
                if before:
                    a = last[before]
                    fit = self.fits[a].get(i)
                    if not (self.fit(a, i) if fit is None else fit):
                        continue
                last[at + 1], done = i, at
        out, at = [], len(part)
        while at:
            i = last[at]
            out.append(i)
            at -= len(self.pieces[i])
        return b"".join(map(self.packed.__getitem__, out[::-1]))

    def _parts(self, chunk: str) -> list[str]:
        """The chunk, cut where no merge can go across."""
        pairs, cuts = list(map("".join, zip(chunk, chunk[1:]))), [0]
        if not self.beside.issuperset(pairs):
            cuts += [n for n, p in enumerate(pairs, 1) if p not in self.beside]
        return [chunk[a:b] for a, b in zip(cuts, [*cuts[1:], len(chunk)])]

    def _part(self, part: str) -> bytes:
        if len(part) == 1 and part not in self.known:  # merges with nothing
            return b"".join(self.packed[self.bytes[b]] for b in part.encode())
        return self._table(part)

    def _learn(self, chunk: str) -> bytes:
        """A chunk's ids, from the memo or by its parts, which most chunks share with others."""
        if chunk in self.old:
            return self.old[chunk]
        parts = self._parts(chunk)
        if len(parts) == 1:
            return self._part(chunk)
        out = []
        for p in parts:
            ids = self.young.get(p) or self.old.get(p) or self._part(p)
            if len(p) <= LONGEST:
                self.young[p] = ids
            out.append(ids)
        return b"".join(out)

    def _lookup(self, chunks: list[str]) -> bytes:
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young = self.young
        long: dict[str, bytes] = {}
        for c in set(chunks).difference(young):
            (long if len(c) > LONGEST else young)[c] = self._learn(c)
        if long:
            return b"".join([young[c] if c in young else long[c] for c in chunks])
        return b"".join(map(young.__getitem__, chunks))

    def encode(self, text: str | None) -> bytes:
        """The ids with begin and end, as little-endian unsigned 32-bit integers."""
        ends = np.array([self.begin, self.end], "<u4").tobytes()
        if not text:
            return ends
        if not self.ready:
            self._prepare()
        shown = SPACE + text.replace(" ", SPACE)
        out, low = [ends[:4]], 0
        while low < len(shown):
            high = len(shown)
            if high - low > PART:  # parts end where a chunk does
                gap = self.gap.search(shown, low + PART)
                high = gap.start() if gap else high
            out.append(self._lookup(self.chunks.findall(shown, low, high)))
            low = high
        return b"".join([*out, ends[4:]])

    def decode(self, ids: bytes) -> str:
        """The text of the ids: begin and end say nothing, the first piece loses its leading space, and bytes that make no character become U+FFFD each."""
        a = np.frombuffer(ids, "<u4")
        silent = np.flatnonzero(self.control[a])  # no character goes across these
        out = []
        for low, high in zip([0, *(silent + 1).tolist()], [*silent.tolist(), len(a)]):
            if low < high:
                raw = b"".join(map(self.shown.__getitem__, a[low:high].tolist()))
                out.append(raw[int(not out and self.spaced[a[low]]) :].decode("utf-8", "grainmill-each-byte"))
        return "".join(out)


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBpe:
    """One per process and model."""
    return PieceBpe(path)


def _rows(docs: DataFrame, read: str, made: list[tuple[str, T.DataType, pa.DataType]], work: Callable[[bytes | None], tuple]) -> DataFrame:
    """``docs`` with columns made from the column ``read``; rows never move. Columns of these names are replaced."""
    names = [n for n, _, _ in made]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t, _ in made)])
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [work(v.as_buffer().to_pybytes() if v.is_valid else None) for v in b.column(width)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), *(pa.array(c, t) for c, (_, _, t) in zip(zip(*each) if each else [[]] * len(made), made))], [*(f.name for f in kept), *names])

    apart, inner = set_apart(docs)
    return apart.select(*(inner[f.name] for f in kept), apart[inner[read]].alias("_read")).mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit integers, begin and end among them) and ``n_tokens``.

    Null and empty texts have the begin and end alone. Bytes that are no UTF-8 count as
    U+FFFD. Rows never move and each is encoded alone; a worker's memory is bounded by a batch, a
    text and the memo. Columns of these names are replaced; all others pass through.
    """
    path = path or default_path()

    def work(raw: bytes | None) -> tuple[bytes, int]:
        ids = piece_bpe(path).encode((raw or b"").decode("utf-8", "grainmill-each-byte"))
        return ids, len(ids) // 4

    return _rows(docs, text, [("ids", T.BinaryType(), pa.binary()), ("n_tokens", T.LongType(), pa.int64())], work)


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of ``ids``; null without ids. Ids beyond the vocabulary raise."""
    path = path or default_path()
    return _rows(docs, ids, [("decoded", T.StringType(), pa.string())], lambda raw: (None if raw is None else piece_bpe(path).decode(raw),))
