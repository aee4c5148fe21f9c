"""Stream operators that keep event-time order: rows wait until the watermark passes, timers fold them, idle keys end.

State and timers belong to buckets of keys (``buckets``), not to single keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cutlake.operators.ledger import OPEN_STATES, WAITING
from cutlake.streaming.buckets import BUCKET, BUCKETS, dealt, pack, unpack, whole
from cutlake.streaming.jobs import transitions

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


class InOrder(StatefulProcessor):
    """Folds each key's rows in (event time, tie) order, once no earlier row can come.

    Keys come in buckets. A bucket's rows are held in list state, a block for each micro-batch. A timer at the
    earliest held time fires when the watermark is past it; all rows up to the watermark are then sorted by key and
    time and folded one after another. ``fold(memory, row)`` returns the key's new memory and an output row or
    None; ``last`` keeps only a key's newest output of a firing. A key that folded nothing
    for ``idle_ms`` of event time loses its memory. Rows behind the watermark, or without a time, are not folded:
    they are counted per key, and ``late(row)`` may give an output row for each;
    where only the newest output is kept it carries the count. Times in outputs are microseconds.
    """

    def __init__(self, key: str, row: str, memory: str, out: str, fold: Callable, last: bool, idle_ms: int | None, late: Callable | None = None):
        self.names = [key, "at_us", *(c.split()[0] for c in row.split(", "))]
        self.row, self.memory = f"key long, at long, {row}", f"key long, seen long, {memory}"
        self.out = [c.split() for c in out.split(", ")]
        self.fold, self.last, self.idle_ms, self.late = fold, last, idle_ms, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.held = handle.getValueState("held", "block binary")
        self.missed = handle.getListState("missed", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limit, first, late = timerValues.getCurrentWatermarkInMs() * 1000, None, []
        for batch in rows:
            own = list(zip(*[whole(batch[n]) for n in self.names]))
            late += [r for r in own if r[1] is None or 0 < limit >= r[1]]
            if fresh := [r for r in own if r[1] is not None and (limit <= 0 or r[1] > limit)]:
                self.waiting.appendValue((pack(self.row, fresh),))
                earliest = min(r[1] for r in fresh)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        if late:
            self.missed.appendValue((pack("key long, n long", Counter(r[0] for r in late).items()),))
            if self.late:
                yield self._frame([(r[0], *self.late(r[1:])) for r in late])

    def _missed(self) -> Counter:
        counts: Counter = Counter()
        for (block,) in self.missed.get():
            for own, n in unpack(block):
                counts[own] += n
        return counts

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for (block,) in self.waiting.get() for r in unpack(block)]
        ready, left = [r for r in rows if r[1] <= limit], [r for r in rows if r[1] > limit]
        kept = self.held.get()
        held = {r[0]: r[1:] for r in unpack(kept[0] if kept else None)}
        out: list[tuple] = []
        newest: dict = {}
        for row in _sorted(ready):
            own = row[0]
            seen, *memory = held.get(own, (None,))
            if not memory or (self.idle_ms is not None and row[1] - seen > self.idle_ms * 1000):
                memory = None
            memory, made = self.fold(memory, row[1:])
            held[own] = (row[1], *memory)
            if made is not None and self.last:
                newest[own] = made
            elif made is not None:
                out.append((own, *made))
        if ready:
            self.waiting.clear()
            if left:
                self.waiting.put([(pack(self.row, left),)])
        if left:
            self.handle.registerTimer(-(-min(r[1] for r in left) // 1000))
        before = len(held)
        if self.idle_ms is not None:
            busy = {r[0] for r in left}
            held = {own: m for own, m in held.items() if own in busy or limit - m[0] <= self.idle_ms * 1000}
            if idle := [m[0] for own, m in held.items() if own not in busy]:
                self.handle.registerTimer(min(idle) // 1000 + self.idle_ms + 1)
        if not held:
            self.held.clear()
        elif ready or len(held) < before:
            self.held.update((pack(self.memory, [(own, *m) for own, m in held.items()]),))
        if newest:
            missed = self._missed()
            out = [(own, *made, missed[own]) for own, made in newest.items()]
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        made = {}
        for (name, kind), values in zip(self.out, zip(*rows)):
            made[name] = np.array(values, dtype="datetime64[us]") if kind.startswith("timestamp") else pd.Series(values, dtype="object") if None in values else list(values)
        return pd.DataFrame(made)

    def close(self) -> None:
        pass


def _sorted(rows: list[tuple]) -> list[tuple]:
    """Rows by their values from left to right, nulls first."""
    try:
        return sorted(rows)
    except TypeError:
        return sorted(rows, key=lambda r: [(v is not None, v) if v is not None else (False, 0) for v in r])


def _ordered(rows: DataFrame, key: str, ts: str, delay: str, columns: str, memory: str, out: str, fold: Callable, last: bool = False, idle_seconds: int | None = None, late: Callable | None = None, buckets: int = BUCKETS) -> DataFrame:
    rows.sparkSession.conf.set(STORE, PROVIDER)  # list state and timers need it
    seen = dealt(rows, key, buckets).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    seen = seen.select(BUCKET, key, ts, F.unix_micros(ts).alias("at_us"), *(c.split()[0] for c in columns.split(", ")))
    processor = InOrder(key, columns, memory, out, fold, last, None if idle_seconds is None else idle_seconds * 1000, late)
    return seen.groupBy(BUCKET).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventTime")


def leases_in_order(beats: DataFrame, ttl_seconds: int = 900, delay: str = "10 minutes", idle_seconds: int | None = None) -> DataFrame:
    """:func:`cutlake.streaming.bus.leases` of a stream of (project, owner, ts, event_id), whatever the order of arrival.

    A heartbeat is judged when the watermark (``delay`` behind the newest time) passes
    it; one that comes later than that is returned with ``granted`` null. A project silent for ``idle_seconds`` (at least the time-to-live) is forgotten;
    its lease has run out by then, so the result is the same.
    """
    ttl = ttl_seconds * 1_000_000

    def fold(memory, row):
        at, event_id, who = row
        owner, since = memory or (None, None)
        free = owner is None or owner == who or at - since >= ttl
        return ((who, at) if free else (owner, since)), (who, event_id, free)

    idle = ttl_seconds if idle_seconds is None else max(idle_seconds, ttl_seconds)
    return _ordered(beats, "project", "ts", delay, "event_id long, owner string", "owner string, since long", "project long, owner string, event_id long, granted boolean", fold, idle_seconds=idle, late=lambda row: (row[2], row[1], None))


def job_state_in_order(events: DataFrame, max_attempts: int = 2, delay: str = "10 minutes") -> DataFrame:
    """Status per project of a stream of (project, seq, action, ts), in (ts, seq) order; each firing gives the newest status, the events behind it and how many came too late."""
    table = transitions(max_attempts)

    def fold(memory, row):
        code, seen = memory or ("NONE:0", 0)
        code = table.get(f"{code}|{row[2]}", code)
        status, attempt = code.split(":")
        return (code, seen + 1), (status, int(attempt), seen + 1)

    return _ordered(events, "project", "ts", delay, "seq long, action string", "code string, seen long", "project long, status string, attempt int, events long, late long", fold, last=True)


def live_status_in_order(blocks: DataFrame, delay: str = "10 minutes", idle_seconds: int | None = None) -> DataFrame:
    """Effective state per receipt of a stream of (receipt, seq, ts, state), in (ts, seq) order; each firing gives the newest.

    A receipt without blocks for ``idle_seconds`` of event time is forgotten; its next
    block opens a new run.
    """
    opened, waiting = set(OPEN_STATES), set(WAITING)

    def fold(memory, row):
        us, _, now = row
        started, work, effective, version = memory or (None, None, None, 0)
        if now not in opened:
            started = work = effective = None
        else:
            started = us if started is None else started
            work = None if now in waiting else (us if work is None else work)
            effective = now if now != "progress" or effective in (None, "progress") else effective
        return (started, work, effective, version + 1), (effective, started, started if work is None else work, version + 1)

    return _ordered(blocks, "receipt", "ts", delay, "seq long, state string", "started long, work long, effective string, version long",
                    "receipt long, state string, started timestamp_ntz, working_since timestamp_ntz, version long, late long", fold, last=True, idle_seconds=idle_seconds)


class Due(StatefulProcessor):
    """Emits each stored schedule of a bucket once, when its time has come, by a timer that needs no input."""

    PLANS = "id long, due long, open boolean, touched long"

    def __init__(self, event_time: bool, keep_ms: int):
        self.event_time, self.keep_ms = event_time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plans = handle.getValueState("plans", "block binary")

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()

    def _load(self) -> dict:
        kept = self.plans.get()
        return {own: (due, open_, touched) for own, due, open_, touched in unpack(kept[0] if kept else None)}

    def _store(self, plans: dict, now: int) -> None:
        # a fired schedule is remembered, for a while where the wall clock decides, so that a repeated row does not fire again
        rows = [(own, *p) for own, p in plans.items() if p[1] or self.event_time or p[2] + self.keep_ms > now]
        if rows:
            self.plans.update((pack(self.PLANS, rows),))
        else:
            self.plans.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict = {}
        for batch in rows:
            for own, at, done in zip(whole(batch["id"]), batch["due_us"].tolist(), batch["was_fired"].tolist()):
                came[own] = (at, done or (own in came and came[own][1]))
        plans, now, first = self._load(), self._now(timerValues), None
        for own, (due, fired) in came.items():
            if fired:
                plans[own] = (due, False, now)
            elif own not in plans:
                plans[own] = (due, True, now)
                first = due if first is None else min(first, due)
        self._store(plans, now)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        plans, now = self._load(), self._now(timerValues)
        ready = [(own, due) for own, (due, open_, _) in plans.items() if open_ and due <= now * 1000]
        if ready:
            for own, due in ready:
                plans[own] = (due, False, now)
            self._store(plans, now)
        if left := [due for due, open_, _ in plans.values() if open_]:
            self.handle.registerTimer(-(-min(left) // 1000))
        if ready:
            own, due = zip(*ready)
            yield pd.DataFrame({"id": list(own), "due_at": np.array(due, dtype="datetime64[us]"), "late_seconds": [(now * 1000 - d) // 1_000_000 for d in due]})

    def close(self) -> None:
        pass


def due_stream(schedules: DataFrame, clock: str | None = None, delay: str = "0 seconds", keep_days: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """:func:`cutlake.streaming.bus.due_schedules` of a stream of (id, due_at, fired_at): each open schedule once, when due, with its lateness.

    Without ``clock`` the wall clock decides and a timer fires in a later micro-batch even if
    nothing arrives. With the name of a timestamp column the watermark of that
    column decides. A row with ``fired_at`` cancels its schedule.
    """
    spark = schedules.sparkSession
    spark.conf.set(STORE, PROVIDER)
    rows = schedules if clock is None else schedules.withColumn(clock, F.col(clock).cast("timestamp")).withWatermark(clock, delay)
    rows = dealt(rows, "id", buckets).select(BUCKET, "id", *([clock] if clock else []), F.unix_micros(F.col("due_at").cast("timestamp")).alias("due_us"), F.col("fired_at").isNotNull().alias("was_fired")).where("due_us IS NOT NULL")
    return rows.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=Due(clock is not None, keep_days * 86_400_000), outputStructType="id long, due_at timestamp_ntz, late_seconds long", outputMode="append", timeMode="processingTime" if clock is None else "eventTime",
    )
