"""Merkle fingerprints of documents: leaves, paragraphs, sections, root.

Only DataFrame functions. A section ends at an empty line, a paragraph at a line feed, and
a leaf is a sentence of it (or 200 code points, where no sentence ends). A node's digest
is the SHA-256 of its kind and its children's digests in order, so equal roots mean equal
texts, and where roots differ, the branches that differ show where.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import MIN_LONG, bucket_of, given_back, longs, set_apart

LEAF = r"[^.!?]{0,200}+[.!?]+ ?|[^.!?]{1,200}"


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaf digests (128 bits of SHA-256, hex). Null is as empty text."""
    leaf = lambda x: F.substring(F.sha2(x, 256), 1, 32)
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s)({LEAF})"), 1), leaf)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def section_digests(t: Column) -> Column:
    digest = lambda kind, parts: F.sha2(F.concat(F.lit(kind), F.array_join(parts, "")), 256)
    return F.transform(t, lambda s: digest("S", F.transform(s, lambda p: digest("P", p))))


def root(t: Column) -> Column:
    return F.sha2(F.concat(F.lit("R"), F.array_join(section_digests(t), "")), 256)


def leaves_of(t: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(t)))


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves that two trees have in common: 2 |A and B| / (|A| + |B|) over distinct leaves; two without leaves are alike."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def differing_sections(a: Column, b: Column) -> Column:
    """Positions (from 0) of sections whose digests differ or that only one tree has."""
    x, y = section_digests(a), section_digests(b)
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (the root) and ``sections`` (their digests). Null texts count as empty; columns of these two names are replaced, all others pass through."""
    apart, names = set_apart(docs)
    t = apart.withColumn("tree", tree(F.col(names[text])))
    return t.select(*given_back(names, ("fingerprint", "sections")), root(F.col("tree")).alias("fingerprint"), section_digests(F.col("tree")).alias("sections"))


#: Ranges of ids at most; their ends are held in the plan.
MOST_RANGES = 4096


def with_next(
    docs: DataFrame, columns: list[str], doc_id: str = "doc_id", ties: tuple[str, ...] = ("text",), rows_per_bucket: int = 4000, derive: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``docs`` with next_<column> of the row that follows in descending ``doc_id`` (null ids last); after the last, the first.

    Rows move once, to ranges of ids. The ends of the ranges are ids of the table
    (approximate percentiles), so each range's first row is known beforehand and is sent
    to the range above it as well; no window spans more than a range. Repeated ids follow
    one another by ``ties``. A single row follows itself. Ranges have about
    ``rows_per_bucket`` rows; beyond MOST_RANGES of them they get longer instead, and
    Spark sorts a range on disk where memory is short. ``derive`` makes a struct of a row,
    once and after the move; its fields are columns too, and ``columns`` may name them.
    Columns of the new names are replaced; all others pass through.
    """
    key = F.coalesce(F.col(doc_id), F.lit(MIN_LONG))
    n, top = docs.agg(F.count("*"), F.max(key)).first()
    cuts: list[int] = []
    if n:
        wanted = min(max(1, -(-n // rows_per_bucket)), MOST_RANGES)
        at = [k / wanted for k in range(1, wanted)]
        got = docs.agg(F.percentile_approx(key, at, 50_000)).first()[0] if at else []
        cuts = sorted({*(got or [])} - {top})
    ends = [*cuts, top if top is not None else 0]
    placed = docs.select(F.struct("*").alias("row"), key.alias("key"), bucket_of(key, cuts).alias("home"))
    is_end = F.get(longs(ends), F.col("home")) == F.col("key")
    stay = F.struct(F.col("home").alias("range"), F.lit(0).alias("guest"))
    visit = F.struct(((F.col("home") + 1) % F.lit(len(ends))).alias("range"), F.lit(1).alias("guest"))
    rows = placed.withColumn("to", F.explode(F.when(is_end, F.array(stay, visit)).otherwise(F.array(stay)))).select("row", "key", "to.range", "to.guest")
    made: list[str] = []
    if derive:
        rows = rows.repartition("range").withColumn("made", derive(F.col("row")))
        made = rows.schema["made"].dataType.names
    of = lambda c: F.col("made" if c in made else "row")[c]
    order = W.partitionBy("range").orderBy("guest", F.col("key").desc(), *[F.col("row")[c] for c in ties])
    out = rows.withColumn("next", F.lead(F.struct(*[of(c).alias(c) for c in columns])).over(order)).where("guest = 0")
    new = [*made, *[f"next_{c}" for c in columns]]
    return out.select(*[of(c).alias(c) for c in [*[c for c in docs.columns if c not in new], *made]], *[F.col("next")[c].alias(f"next_{c}") for c in columns])
