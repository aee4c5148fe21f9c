"""Job state as a finite automaton: a batch fold that scales, and the same table in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.operators import scan as S
from cutlake.streaming.buckets import BUCKET, BUCKETS, dealt, pack, unpack, whole

ACTIVE = ["QUEUED", "CLAIMED", "RUNNING"]
BACKOFF = [60, 300, 900]


def transitions(max_attempts: int = 2) -> dict[str, str]:
    """``status:attempt|action`` to the next ``status:attempt``; whatever is missing changes nothing.

    A project holds one active job, so an enqueue counts only when none is.
    Defer returns the job without spending an attempt; fail spends one and is
    terminal at the maximum.
    """
    table = {}
    for idle in ("NONE:0", *[f"{s}:{n}" for s in ("DONE", "FAILED") for n in range(max_attempts + 1)]):
        table[f"{idle}|enqueue"] = "QUEUED:0"
    for n in range(max_attempts):
        table[f"QUEUED:{n}|claim"] = f"CLAIMED:{n}"
        table[f"CLAIMED:{n}|start"] = f"RUNNING:{n}"
        for status in ACTIVE:
            table[f"{status}:{n}|finish"] = f"DONE:{n}"
            table[f"{status}:{n}|defer"] = f"QUEUED:{n}"
            table[f"{status}:{n}|fail"] = f"FAILED:{n + 1}" if n + 1 >= max_attempts else f"QUEUED:{n + 1}"
    return table


def codes(table: dict[str, str]) -> list[str]:
    return sorted({k.split("|")[0] for k in table} | set(table.values()))


def job_state(events: DataFrame, key: str = "project", order: tuple[str, ...] = ("ts", "seq"), max_attempts: int = 2, width: float | None = None) -> DataFrame:
    """Final status and attempt per project.

    The automaton has few states, so a chunk of a project's events is folded
    once for every possible entry state into a small table; the tables of a
    project's chunks are then composed in order. A project with very many
    events is spread over its chunks.
    """
    table = transitions(max_attempts)
    states = codes(table)
    moves = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    every = F.array(*[F.lit(s) for s in states])
    rows = events.select(key, *order, "action", S.chunk_of(events, order[0], width).alias("_chunk"))
    listed = rows.groupBy(key, "_chunk").agg(
        F.array_sort(F.collect_list(F.struct(*order, "action"))).alias("es"), F.count("*").alias("_n"), F.max(order[0]).alias("_ts")
    )
    move = lambda code, action: F.coalesce(F.try_element_at(moves, F.concat(code, F.lit("|"), action)), code)
    effect = F.aggregate("es", every, lambda acc, e: F.transform(acc, lambda s: move(s, e["action"])))
    parts = listed.select(key, "_chunk", "_n", "_ts", effect.alias("_map"))
    chained = parts.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "_map"))).alias("ms"), F.sum("_n").alias("events"), F.max("_ts").alias("updated_at")
    )
    follow = lambda code, m: F.element_at(m["_map"], F.array_position(every, code).cast("int"))
    final = F.aggregate("ms", F.lit("NONE:0"), follow)
    return chained.select(key, *_split(final), "events", "updated_at")


def _split(code: Column) -> list[Column]:
    return [F.substring_index(code, ":", 1).alias("status"), F.substring_index(code, ":", -1).cast("int").alias("attempt")]


def retry_after(attempt: Column, failed_at: Column) -> Column:
    """When a job that failed at a time may run again."""
    wait = F.element_at(F.array(*[F.lit(b) for b in BACKOFF]), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(BACKOFF))))
    return F.timestamp_micros(F.unix_micros(failed_at.cast("timestamp")) + wait * 1_000_000)


def job_state_stream(events: DataFrame, max_attempts: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """Running status per project of a stream of job events (columns of ``JOB_EVENT``); update mode.

    Events of one micro-batch are applied in (ts, seq) order.
    """
    table = transitions(max_attempts)
    memory = "project long, code string, seen long"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {own: (code, seen) for own, code, seen in unpack(state.get[0] if state.exists else None)}
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        touched = {}
        for own, action in zip(whole(rows["project"]), rows["action"].tolist()):
            code, seen = held.get(own, ("NONE:0", 0))
            held[own] = touched[own] = (table.get(f"{code}|{action}", code), seen + 1)
        state.update((pack(memory, [(own, *m) for own, m in held.items()]),))
        status, attempt = zip(*[code.split(":") for code, _ in touched.values()])
        yield pd.DataFrame({"project": pd.Series(list(touched), dtype="object" if None in touched else "int64"), "status": status, "attempt": [int(a) for a in attempt], "events": [seen for _, seen in touched.values()]})

    return dealt(events, "project", buckets).groupBy(BUCKET).applyInPandasWithState(
        fold, "project long, status string, attempt int, events long", "block binary", "update", "NoTimeout"
    )
