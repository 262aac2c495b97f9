"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed letter
trigrams (regularised least squares) says which of two groups of languages a text is
in; the language whose codeword loses least over all bits, each bit weighted by its margin
through an exponential loss, is the answer, and the answer is flagged when another
language comes near it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import tidy

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Hashed trigrams.
WIDTH = 2048


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte folding (A-Z to lower case, other ASCII that is no letter to a space) and three random tables of hash parts."""
    fold = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if 65 <= b <= 90:
            fold[b] = b + 32
        elif not 97 <= b <= 122:
            fold[b] = 32
    parts = np.random.default_rng(5).integers(0, 1 << 16, (3, 256), dtype=np.uint16)
    return fold, parts


FOLD, PARTS = _tables()


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed trigrams over the whole text."""
    x = FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    h = (PARTS[0][x[:-2]] + PARTS[1][x[1:-1]] + PARTS[2][x[2:]]) & np.uint16(WIDTH - 1) if len(x) > 2 else np.zeros(0, np.uint16)
    h = h[~((x[:-2] == 32) & (x[1:-1] == 32))] if len(h) else h
    n = np.bincount(h, minlength=WIDTH).astype(np.float32)
    return np.sqrt(n / max(1.0, n.sum()))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1: all distinct two-way groupings for up to five languages, else the random code, of many tried, whose rows are farthest apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        groupings = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(groupings, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (n, bits))
        c = c * c[:1]
        distance = (bits - c @ c.T) / 2 + np.eye(n) * bits
        if distance.min() > apart:
            best, apart = c, distance.min()
    return best


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray  # (WIDTH + 1) x bits

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score (0 to 1) and the runner-up's score, for rows of features."""
        margins = np.clip(x @ self.weights[:-1] + self.weights[-1], -3, 3)
        # the sum over bits of exp(-margin * bit), as two products
        loss = np.exp(-margins) @ (self.codes > 0).T + np.exp(margins) @ (self.codes < 0).T
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(p))
        second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
        return order[:, 0], p[rows, order[:, 0]], second


#: Sampled documents whose sums one task adds up.
SUMMED = 4096


def train(
    labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 1200, most_languages: int = 1000, ridge: float = 1e-3
) -> Model:
    """Fit on at most about ``per_language`` documents of each language, chosen by the hash of their id.

    Languages are counted over all rows; the ``most_languages`` commonest are learned.
    Rows with a null text or language are left out; no rows, no languages. Tasks sum the
    features' products, each over about SUMMED documents of the sample; the sums are added
    up in tasks too, and only the last one, of a size that neither the table nor the number
    of languages changes (34 MB), reaches the driver.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("fit"), F.col(doc_id)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    langs = tuple(sorted(counts))
    if not langs:
        return Model((), np.ones((0, 1)), np.zeros((WIDTH + 1, 1)))
    # a row's place in [0, 1), against its language's share
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    known = F.from_json(F.lit(json.dumps({k: min(1.0, per_language / counts[k]) for k in langs})), "map<string,double>")
    sample = rows.where(place < F.element_at(known, F.col("lang")))
    codes = codewords(len(langs))
    size = {k: min(counts[k], per_language) for k in langs}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_buffer().to_pybytes()).astype(np.float16).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], ["lang", "h", "x"])

    at = {k: i for i, k in enumerate(langs)}
    width = WIDTH + 1 + codes.shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH + 1, width))
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                x = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in part.column(2)]).astype(np.float64)
                x = np.hstack([x, np.ones((len(x), 1))])
                spoken = part.column(0).to_pylist()
                w = np.array([1.0 / size[k] for k in spoken])  # languages weigh the same
                total += (x * w[:, None]).T @ np.hstack([x, codes[[at[k] for k in spoken]]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(WIDTH + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "s"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(1)):
                sums[i] = sums.get(i, 0.0) + np.frombuffer(s.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["i", "s"])

    parts = -(-sum(size.values()) // SUMMED)
    # in the order of the hash, so that reruns add up alike
    dealt = sample.mapInArrow(tidy(featured), "lang string, h long, x binary").repartition(parts, F.pmod("h", F.lit(parts))).sortWithinPartitions("h", "lang", "x")
    sums = dealt.mapInArrow(tidy(summed), "i int, s binary").repartition("i").sortWithinPartitions("i", "s").mapInArrow(tidy(added), "i int, s binary")
    total = np.zeros((WIDTH + 1, width))
    for r in sums.toLocalIterator():
        total[r["i"]] = np.frombuffer(r["s"])
    if not total.any():
        return Model((), np.ones((0, 1)), np.zeros((WIDTH + 1, 1)))
    gram, aim = total[:, : WIDTH + 1], total[:, WIDTH + 1 :]
    gram[np.diag_indices_from(gram)] += ridge * np.trace(gram) / len(gram)
    return Model(langs, codes, np.linalg.solve(gram, aim))


def identify(docs: DataFrame, model: Model, text: str = "text", ambiguous_below: float = 0.6) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and lang_ambiguous.

    Whole texts count. A null text, or one without a letter, is ``und`` with score 0, and
    so is everything if the model has no language. lang_ambiguous is true where the score
    is under ``ambiguous_below``. Each row is judged alone; rows never move. Columns of
    these names are replaced.
    """
    made = ("lang_pred", "score", "lang_ambiguous")
    kept = [f for f in docs.schema.fields if f.name not in made]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            lang, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
            rows, x = [], []
            for i, t in enumerate(b.column(at)):
                if t.is_valid and model.langs and LETTER.search(t.as_py()):
                    rows.append(i)
                    x.append(features(t.as_buffer().to_pybytes()))
                if len(x) >= 512 or x and i == n - 1:
                    best, p, _ = model.predict(np.stack(x))
                    lang[rows], score[rows], unsure[rows] = np.array(model.langs, object)[best], p, p < ambiguous_below
                    rows, x = [], []
            if x:
                best, p, _ = model.predict(np.stack(x))
                lang[rows], score[rows], unsure[rows] = np.array(model.langs, object)[best], p, p < ambiguous_below
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [*names, *made])

    return docs.select(*names).mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    """The third of the documents that is never learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1
