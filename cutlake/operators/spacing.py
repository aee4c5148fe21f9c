"""Keep an event only when the last *kept* one is far enough behind.

The rule is sequential: whether a row stays depends on which earlier rows
stayed. It becomes parallel because a stretch of time acts on the state only
through a small step function "last kept before -> last kept after": stretches
are summarised by many tasks, runs of ``FAN`` summaries are composed into one of
the same form, level by level, the few that are left of a key are chained, and
the entry states go down the levels again until every stretch is walked from its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 64  # windows in a stretch
FAN, LEVELS = 1024, 1  # summaries that one of the next level stands for; levels of them


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _steps(times: np.ndarray, window: int, start: int) -> tuple[list[int], list[int]]:
    """For each instant that can be the first kept one of a stretch, the last one kept after it; equal outcomes once."""
    after = np.searchsorted(times, times + window, side="right").tolist()
    exits = times.tolist()
    for i in range(len(exits) - 1, -1, -1):
        if after[i] < len(exits):
            exits[i] = exits[after[i]]
    # an earlier kept instant can hide those up to one window into the stretch
    entries = 1 + int(np.searchsorted(times[:-1], start + window, side="right"))
    first, last = times[:entries].tolist(), exits[:entries]
    edge = [i for i in range(entries) if i + 1 == entries or last[i] != last[i + 1]]
    return [first[i] for i in edge], [last[i] for i in edge]


def _through(state: int | None, steps: list[int], outs: list[int], window: int) -> int | None:
    """The last kept instant after a stretch that is entered with ``state``."""
    spot = 0 if state is None else bisect_right(steps, state + window)
    return outs[spot] if spot < len(steps) else state


def _composed(parts: list[tuple[list[int], list[int]]], window: int) -> tuple[list[int], list[int]]:
    """One step function for stretches in a row.

    An entry reaches at most one window into the first stretch. Where it hides all
    of it, the second stretch begins with nothing hidden.
    """
    steps, outs = parts[0]
    if len(parts) > 1:
        steps, outs = [*steps, parts[1][0][0]], [*outs, None]
    for own in parts[1:]:
        moved = {o: _through(o, *own, window) for o in set(outs)}
        outs = [moved[o] for o in outs]
        edge = [i for i in range(len(outs)) if i + 1 == len(outs) or outs[i] != outs[i + 1]]
        steps, outs = [steps[i] for i in edge], [outs[i] for i in edge]
    return steps, outs


def keep_spaced(df: DataFrame, keys: list[str], at: str, tie: list[str], window_us: int, stretch: int = STRETCH, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Rows that survive the rule: drop when a kept row lies at most ``window_us`` before.

    ``at`` is a timestamp, ``tie`` orders rows of one instant. Null key parts
    form their own group, rows without a time are dropped. ``stretch`` (in windows), ``fan`` and ``levels`` change the
    spread of work only: a task composes or chains ``fan`` summaries at a time, and what is left of a key at the
    top is one row for each ``fan ** levels`` stretches.
    """
    span = stretch * window_us
    us = F.unix_micros(F.col(at).cast("timestamp"))
    key = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    rows = df.select(F.struct(*df.columns).alias("_row"), F.struct(*tie).alias("_tie"), key.alias("g"), us.alias("us"))
    part = ((F.col("us") - F.pmod("us", F.lit(span))) / F.lit(span)).cast("long")
    points = rows.where("us IS NOT NULL").select("g", part.alias("stretch"), "us").repartition("g", "stretch").sortWithinPartitions("g", "stretch", "us")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"g": [], "stretch": [], "steps": [], "outs": []}
        now, held = None, []

        def close():
            steps, outs = _steps(np.unique(np.array(held, dtype=np.int64)), window_us, now[1] * span)
            for name, value in zip(out, (*now, steps, outs)):
                out[name].append(value)

        for batch in batches:
            for g, part, t in zip(_column(batch, "g"), _column(batch, "stretch"), _column(batch, "us")):
                if (g, part) != now:
                    if now is not None:
                        close()
                    now, held = (g, part), []
                held.append(t)
            if len(out["g"]) > 4096:
                yield pa.RecordBatch.from_pydict(out, schema=summary)
                out = {n: [] for n in out}
        if now is not None:
            close()
            yield pa.RecordBatch.from_pydict(out, schema=summary)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, *_composed(held, window_us)), summary.types)], schema=summary)

        for batch in batches:
            for g, block, steps, outs in zip(*(_column(batch, n) for n in ("g", "block", "steps", "outs"))):
                if (g, block) != now:
                    if now is not None:
                        yield close()
                    now, held = (g, block), []
                held.append((steps, outs))
        if now is not None:
            yield close()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            entries = []
            for g, block, steps, outs, entry in zip(*(_column(batch, n) for n in ("g", "block", "steps", "outs", "entry"))):
                if (g, block) != now:
                    now, state = (g, block), entry
                entries.append(state)
                state = _through(state, steps, outs, window_us)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64())], names=["g", "stretch", "entry"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            kept: list[tuple[str, int]] = []
            for g, part, t, entry in zip(*(_column(batch, n) for n in ("g", "stretch", "us", "entry"))):
                if (g, part) != now:
                    now, last = (g, part), entry
                if last is None or t - last > window_us:
                    kept.append((g, t))
                    last = t
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in kept], pa.string()), pa.array([t for _, t in kept], pa.int64())], names=["g", "us"])

    numbers = pa.list_(pa.int64())
    summary = pa.schema([("g", pa.string()), ("stretch", pa.int64()), ("steps", numbers), ("outs", numbers)])
    row, order = "g string, stretch long, steps array<long>, outs array<long>", ["g", "block", "stretch"]
    own = [points.mapInArrow(summarise, row)]
    for _ in range(levels):
        blocks = own[-1].withColumn("block", F.floor(F.col("stretch") / fan).cast("long")).repartition("g", "block")
        own[-1] = blocks
        own.append(blocks.sortWithinPartitions(*order).mapInArrow(compose, row))
    top = own.pop().withColumns({"block": F.lit(0).cast("long"), "entry": F.lit(None).cast("long")})
    entry = top.repartition("g").sortWithinPartitions(*order).mapInArrow(chain, "g string, stretch long, entry long")
    for blocks in reversed(own):
        starts = entry.select("g", F.col("stretch").alias("block"), "entry")
        met = blocks.join(starts, ["g", "block"]).select("g", "stretch", "block", "steps", "outs", "entry")
        entry = met.repartition("g", "block").sortWithinPartitions(*order).mapInArrow(chain, "g string, stretch long, entry long")
    kept = points.join(entry, ["g", "stretch"]).sortWithinPartitions("g", "stretch", "us").mapInArrow(walk, "g string, us long")
    # one row per kept instant: the first in tie order, found by a map-side minimum
    firsts = rows.groupBy("g", "us").agg(F.min_by("_row", "_tie").alias("_row"))
    return firsts.join(kept, ["g", "us"]).select("_row.*")
