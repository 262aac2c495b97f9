"""A live collector of analyses: counters that never expire, and samples that do, as state of a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# How long and how many samples are kept, and when those beyond that are cleared away.
KEPT_MS, KEPT = 60 * 60 * 1000, 10_000
EVERY_MS, EVERY_RECORDS = 60 * 1000, 1_000
PERCENTS = (50, 90, 95, 99)

STATE = (
    "total long, injections long, total_ms long, min_ms long, max_ms long, since long, due_ms long, next_id long, "
    "ids array<long>, at array<long>, ms array<long>, confidence array<double>, positive array<boolean>"
)
FIGURES = (
    "at timestamp, total_analyzed long, injections_detected long, total_ms long, min_ms long, max_ms long, samples long, "
    + ", ".join(f"p{p} long" for p in PERCENTS) + ", avg_positive double, avg_negative double, std_dev double"
)


@dataclass
class Collector:
    """Counters and a ring of samples (id, time, duration, confidence, detected), a record at a time.

    Samples are cleared when ``EVERY_RECORDS`` records or ``EVERY_MS`` have passed since the last time, or there are
    more than ``kept``: those beyond the newest ``kept`` go, and those older than ``KEPT_MS``.
    """

    total: int = 0
    injections: int = 0
    total_ms: int = 0
    min_ms: int | None = None
    max_ms: int = 0
    since: int = 0
    due_ms: int | None = None
    next_id: int = 0
    samples: deque = field(default_factory=deque)
    kept: int = KEPT

    def record(self, at: int, ms: int, confidence: float, positive: bool) -> None:
        if self.due_ms is None:
            self.due_ms = at + EVERY_MS
        self.total += 1
        self.injections += positive
        self.total_ms += ms
        self.min_ms = ms if self.min_ms is None else min(self.min_ms, ms)
        self.max_ms = max(self.max_ms, ms)
        self.samples.append((self.next_id, at, ms, confidence, positive))
        self.next_id += 1
        self.since += 1
        if self.since >= EVERY_RECORDS or at >= self.due_ms or len(self.samples) > self.kept:
            self.clear(at)

    def clear(self, now: int) -> None:
        least, since = self.next_id - self.kept, now - KEPT_MS
        while self.samples and self.samples[0][0] < least:
            self.samples.popleft()
        if any(s[1] < since for s in self.samples):
            self.samples = deque(s for s in self.samples if s[1] >= since)
        self.since, self.due_ms = 0, now + EVERY_MS

    def figures(self, now: int) -> tuple:
        """As of ``now``; what is due is cleared first."""
        if self.due_ms is not None and now >= self.due_ms:
            self.clear(now)
        ms = sorted(s[2] for s in self.samples)
        conf, hit = np.array([s[3] for s in self.samples], float), np.array([s[4] for s in self.samples], bool)
        mean = lambda a: float(a.mean()) if len(a) else 0.0
        places = [ms[min(len(ms) * p // 100, len(ms) - 1)] if ms else 0 for p in PERCENTS]
        return (pd.Timestamp(now, unit="ms"), self.total, self.injections, self.total_ms, self.min_ms or 0, self.max_ms, len(ms), *places, mean(conf[hit]), mean(conf[~hit]), float(conf.std()) if len(conf) else 0.0)

    def dump(self) -> tuple:
        columns = [list(c) for c in zip(*self.samples)] or [[] for _ in range(5)]
        return (self.total, self.injections, self.total_ms, self.min_ms or 0, self.max_ms, self.since, self.due_ms or 0, self.next_id, *columns)

    @staticmethod
    def load(s: tuple, kept: int = KEPT) -> Collector:
        return Collector(*s[:3], s[3] if s[0] else None, s[4], s[5], s[6] if s[0] else None, s[7], deque(zip(*s[8:])), kept)


def collect(stream: DataFrame, keys: tuple[str, ...], at: str = "recorded_at", seq: str = "seq", duration: str = "duration_ms", confidence: str = "confidence", injection: str = "injection_detected", late: str = "5 minutes", kept: int = KEPT) -> DataFrame:
    """A row of figures a key whenever a trigger brought records for it, or its samples fell due with the watermark.

    Each key is a collector of its own: its counters never expire, its samples do by the
    time of the records. A trigger's records of a key are taken in order of time and
    ``seq``; they are held as numbers, so a trigger should be bounded at the source
    (``maxFilesPerTrigger``). Rows with an error, or a null time, duration or confidence,
    count nowhere. Use the update mode; the state is in the query's checkpoint.
    """
    ok = stream.where(F.col("error").isNull()) if "error" in stream.columns else stream
    ok = ok.where(F.col(at).isNotNull() & F.col(duration).isNotNull() & F.col(confidence).isNotNull())
    rows = ok.withWatermark(at, late).select(*keys, F.col(at).alias("at"), F.col(seq).cast("long").alias("seq"), F.col(duration).cast("long").alias("ms"), F.col(confidence).cast("double").alias("conf"), F.coalesce(F.col(injection), F.lit(False)).alias("hit"))
    names = [*keys, *(f.split()[0] for f in FIGURES.split(", "))]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Collector.load(state.get, kept) if state.exists else Collector(kept=kept)
        if state.hasTimedOut:
            now = c.due_ms
        else:
            f = pd.concat(frames, ignore_index=True).sort_values(["at", "seq"])
            times = f["at"].to_numpy().astype("datetime64[ms]").astype(np.int64)
            for r in zip(times.tolist(), f["ms"].tolist(), f["conf"].tolist(), f["hit"].tolist()):
                c.record(*r)
            now = int(times[-1])
        out = c.figures(now)
        state.update(c.dump())
        if c.samples:
            state.setTimeoutTimestamp(max(c.due_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, *out)], columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, {FIGURES}", STATE, "update", GroupStateTimeout.EventTimeTimeout)
