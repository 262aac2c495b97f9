"""Risk over the turns of a conversation: it decays, rises with what a turn adds, and escalates; over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from grainmill.functions.ranges import RANGES, cut_points, range_of
from grainmill.functions.store import settled

#: x -> min(hi, max(lo, a * x + b)), with ``a`` not negative: any run of turns is one such map.
Clamp = tuple[float, float, float, float]
PENDING = "next long, running double, turns array<long>, risks array<double>"


def _apply(f: Clamp, x: float) -> float:
    a, b, lo, hi = f
    return min(hi, max(lo, a * x + b))


@dataclass(frozen=True)
class Escalation:
    """At each turn ``decay`` of the risk so far is kept and the turn's own is added, up to ``most``; from ``alarm`` on a turn is escalated."""

    decay: float = 0.5
    most: float = 1.0
    alarm: float = 0.6

    def __post_init__(self) -> None:
        if not 0 <= self.decay <= 1 or self.most <= 0:
            raise ValueError("decay must be from 0 to 1, and most above 0")

    def turn(self, risk: float) -> Clamp:
        return (self.decay, risk, 0.0, self.most)

    def step(self, before: float, risk: float) -> float:
        return _apply(self.turn(risk), before)

    def then(self, f: Clamp, risk: float) -> Clamp:
        """The map of some turns, and one more."""
        g = self.turn(risk)
        return (g[0] * f[0], g[0] * f[1] + g[1], _apply(g, f[2]), _apply(g, f[3]))


def _runs(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[bool, tuple, float | None, float]]:
    """(whether a new run begins, its key, turn or None, value) of rows in order, across batches."""
    last = None
    for f in frames:
        columns = [f[k].astype(object).where(f[k].notna(), None).tolist() for k in keys]
        turns = f["at"].astype(object).where(f["at"].notna(), None).tolist()
        for *key, at, value in zip(*columns, turns, f["value"].tolist()):
            key = tuple(key)
            yield key != last, key, at, value
            last = key


def escalate(turns: DataFrame, rule: Escalation = Escalation(), keys: tuple[str, ...] = ("conv_id",), turn: str = "turn", risk: str = "risk", ranges: int = RANGES) -> DataFrame:
    """(keys, turn, risk, running, escalated) of every turn of a table, in order of ``turn``.

    Rows of one turn (repeats, or several messages) are one turn of the greatest risk; a
    null risk is none. Rows with a null turn are left out; null keys are keys like others.

    One conversation may have any number of turns: it is cut by quantiles of the turns, each
    range is one clamped map, and what the maps before a range make of nothing is where that
    range begins. A task reads its rows in order and holds one number.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = turns.where(F.col(turn).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(keys, names)], F.col(turn).cast("long").alias("at"), F.coalesce(F.col(risk).cast("double"), F.lit(0.0)).alias("value"))
    rows = settled(rows.groupBy(*names, "at").agg(F.max("value").alias("value")))
    cuts = cut_points(rows.select("at"), "at", ranges)
    placed = rows.withColumn("part", range_of(F.col("at"), cuts))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)
    group = [*names, "part"]
    in_order = lambda df: df.repartition(*group).sortWithinPartitions(*group, F.col("at").asc_nulls_first())

    def maps(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, f, out = None, None, []
        for new, k, _, value in _runs(frames, group):
            if new:
                if f is not None:
                    out.append((*key, *f))
                key, f = k, (1.0, 0.0, 0.0, rule.most)
            f = rule.then(f, value)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=[*group, "a", "b", "lo", "hi"])
                out = []
        if f is not None:
            out.append((*key, *f))
        yield pd.DataFrame(out, columns=[*group, "a", "b", "lo", "hi"])

    def fold(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, out = 0.0, []
        for new, k, at, value in _runs(frames, group):
            if new:
                x = 0.0
            if at is None:  # where the range begins
                x = value
                continue
            x = rule.step(x, value)
            out.append((*k[:-1], at, value, x))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=[*names, "at", "value", "running"])
                out = []
        yield pd.DataFrame(out, columns=[*names, "at", "value", "running"])

    if cuts:
        made = in_order(placed).mapInPandas(maps, f"{kinds}, part int, a double, b double, lo double, hi double")
        # at most as many maps a key as there are ranges
        before = F.array_sort(F.collect_list(F.struct("part", "a", "b", "lo", "hi")).over(W.partitionBy(*names).orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
        start = F.aggregate(before, F.lit(0.0), lambda x, f: F.least(f["hi"], F.greatest(f["lo"], f["a"] * x + f["b"])))
        placed = placed.unionByName(made.select(*group, start.alias("value")), allowMissingColumns=True)
    told = in_order(placed).mapInPandas(fold, f"{kinds}, at long, value double, running double")
    return told.select(*[F.col(k).alias(c) for c, k in zip(keys, names)], F.col("at").alias(turn), F.col("value").alias(risk), "running", (F.col("running") >= rule.alarm).alias("escalated"))


def escalate_stream(stream: DataFrame, rule: Escalation = Escalation(), keys: tuple[str, ...] = ("conv_id",), turn: str = "turn", risk: str = "risk", at: str = "at", late: str = "5 minutes", wait: int = 100, first: int = 0) -> DataFrame:
    """(keys, turn, risk, running, escalated, late) as turns arrive, the same as ``escalate`` of all of them.

    Turns are numbered from ``first``. A turn that comes before its predecessors waits for
    them, until more than ``wait`` turns do, or the watermark of ``at`` has passed the newest of them: then the missing ones
    are taken as never spoken. A turn at or before one already told comes out with ``late``
    set and no running risk: nothing vanishes. Rows with a null turn or time are left out; a
    null risk is none. Use the append mode.
    """
    rows = stream.where(F.col(turn).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    rows = rows.select(*keys, F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(risk).cast("double"), F.lit(0.0)).alias("risk"), F.col(at).alias("at"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    names = [*keys, turn, risk, "running", "escalated", "late"]

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, x, turns, risks = state.get if state.exists else (first, 0.0, [], [])
        pending, out, newest = dict(zip(turns, risks)), [], None
        for f in () if state.hasTimedOut else frames:
            newest = max(filter(None, (newest, f["at"].max())))
            for t, r in zip(f["turn"].tolist(), f["risk"].tolist()):
                if t < due:
                    out.append((*key, t, r, None, None, True))
                else:
                    pending[t] = max(r, pending.get(t, r))
        for t in sorted(pending):
            if t != due and len(pending) <= wait and not state.hasTimedOut:
                break
            r = pending.pop(t)
            x, due = rule.step(x, r), t + 1
            out.append((*key, t, r, x, x >= rule.alarm, False))
        state.update((due, x, list(pending), list(pending.values())))
        if pending:
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names).astype({"running": "float64"})

    return rows.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, `{turn}` long, `{risk}` double, running double, escalated boolean, late boolean", PENDING, "append", GroupStateTimeout.EventTimeTimeout)
