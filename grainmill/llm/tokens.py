"""Exact token counts and ids for the word-end BPE vocabulary, by pre-tokens.

Whole-token shortcut: every vocabulary string that ends a word is encoded alone once; those
that come back as the one token they are form a table that is proved, not assumed. A
pre-token in the table is one token; only the others are merged, and what a chunk of text
between white space comes to stays in a bounded memo of two generations. Texts with characters
for which the plain pre-tokenisation here is not proved equal to the library's go to the library
whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import tidy

#: Letters whose lower case, composition and class are the same for the library and for Python.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
#: Other characters of which that holds: ASCII, and marks that are neither letters, digits nor white space.
OTHERS = "\\t\\n\\r\\x20-\\x7e¡-©«¬®-±´¶-¸»¿×÷–—‘-”…€"
ODD = re.compile(f"[^{LETTERS}{OTHERS}]")
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
WORD_END = "</w>"
#: Distinct chunks of a generation; a process remembers the last two.
MEMO = 200_000
#: Code points of plain text that are looked up together.
TOGETHER = 1 << 20
WHITE = re.compile(r"\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The same merges for words that are already pre-tokens in the byte alphabet, one space apart.
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merger = Tokenizer.from_str(json.dumps(bare))
        self.shown = {b: c for c, b in _byte_alphabet().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocab.values(), default=0) + 64, bool)
        self.ends_word[[i for s, i in vocab.items() if s.endswith(WORD_END)]] = True
        self.whole = self._prove(vocab)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _prove(self, vocab: dict[str, int]) -> dict[str, bytes]:
        """Pre-token -> its only id, for the vocabulary strings that encode alone as themselves."""
        to_byte = _byte_alphabet()
        found: dict[str, int] = {}
        for s, i in vocab.items():
            if s.endswith(WORD_END) and all(c in to_byte for c in s[: -len(WORD_END)]):
                try:
                    word = bytes(to_byte[c] for c in s[: -len(WORD_END)]).decode()
                except UnicodeDecodeError:
                    continue
                if PRE_TOKEN.fullmatch(word) and not ODD.search(word) and word == word.lower():
                    found[word] = i
        words = list(found)
        alone = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, alone) if e.ids == [found[w]]}

    def plain(self, text: str) -> bool:
        """Whether the pre-tokens found here are proved to be the library's."""
        return not ODD.search(text) and not ("<|" in text and any(s in text for s in SPECIAL))

    def _merge(self, distinct: set[str]) -> dict[str, bytes]:
        """The ids of pre-tokens that are not whole tokens, from one call of the library."""
        words = list(distinct)
        shown = " ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.shown) for w in words])
        ids = np.array(self.merger.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        assert len(stops) == len(words), "each pre-token ends in one word-end token"
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *(stops * 4).tolist()], (stops * 4).tolist())}

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The young generation, with these white-space-separated chunks of lower-case plain text in it: pre-tokens never span white space."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old, whole = self.young, self.old, self.whole
        missing = chunks.difference(young)
        if not missing:
            return young
        again = missing.intersection(old)
        young.update(zip(again, map(old.__getitem__, again)))
        missing -= again
        # letters alone are one pre-token, and letters with a mark behind them two
        words = [c for c in missing if c.isalpha()]
        rest = missing.difference(words)
        ended = [c for c in rest if c[:-1].isalpha() and not c[-1].isalnum()]
        mixed = [(c, PRE_TOKEN.findall(c)) for c in rest.difference(ended)]
        parts = {*words, *(c[:-1] for c in ended), *(c[-1] for c in ended), *(w for _, ws in mixed for w in ws)}
        known = {w: young[w] if w in young else whole[w] for w in parts if w in young or w in whole}
        known.update(self._merge(parts.difference(known)))
        young.update(zip(words, map(known.__getitem__, words)))
        for c in ended:
            young[c] = known[c[:-1]] + known[c[-1]]
        for c, ws in mixed:
            young[c] = b"".join(map(known.__getitem__, ws))
        return young

    def _lookup(self, texts: list[str]) -> list[bytes]:
        chunks = [t.lower().split() for t in texts]
        known = self._learn(set().union(*chunks))
        return [b"".join(map(known.__getitem__, cs)) for cs in chunks]

    def _long(self, text: str) -> bytes:
        """A long plain text's ids, in parts that end at white space."""
        out, low = [], 0
        while low < len(text):
            gap = WHITE.search(text, low + TOGETHER)
            high = gap.start() if gap else len(text)
            out += self._lookup([text[low:high]])
            low = high
        return b"".join(out)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, in order. Short texts are looked up together."""
        held: list[str] = []
        size = 0
        for t in texts:
            odd = t is not None and not self.plain(t)
            if held and (odd or size + len(t or "") > TOGETHER):
                yield from self._lookup(held)
                held, size = [], 0
            if odd:
                yield np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4").tobytes()
            elif len(t or "") > TOGETHER:
                yield self._long(t)
            else:
                held.append(t or "")
                size += len(t or "")
        if held:
            yield from self._lookup(held)

    def ids(self, text: str | None) -> bytes:
        return next(self.encode([text]))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if printable, else the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per process and vocabulary."""
    return WordBpe(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Null and empty texts have 0 of both. Each row is counted alone, in batches, with memory
    bounded by a batch and the memo; rows never move. Special strings inside texts are what
    the library takes them for by default. Columns of these names are replaced.
    """
    path = path or default_path()
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = [f for f in docs.schema.fields if f.name not in (text, *made)]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            texts = b.column(len(names))
            counts = [len(ids) // 4 for ids in bpe.encode(t.as_py() for t in texts)]
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names))), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                [*names, *made],
            )

    return docs.select(*names, text).mapInArrow(tidy(run), schema)
