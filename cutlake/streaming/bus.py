"""Event streams: cursors, debounce, leases, live status, schedules and reconciliation.

Each operator takes a DataFrame. Where the result of a stream can be compared
with a batch over the same rows, both forms are here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.operators import scan as S
from cutlake.operators.ledger import OPEN_STATES, WAITING
from cutlake.streaming.buckets import BUCKET, BUCKETS, dealt, micros, pack, unpack, whole

CHUNK_US = S.DAY_US // 24  # the stretch of microseconds that one task scans


def events_stream(spark: SparkSession, path: str, schema, after_id: int = 0, id_col: str = "event_id", files_per_batch: int = 100, fmt: str = "parquet") -> DataFrame:
    """A stream of an event folder's rows after a cursor; the checkpoint keeps the place between runs."""
    rows = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.where(F.col(id_col) > after_id)


def events_since(events: DataFrame, after_id: int, limit: int, id_col: str = "event_id") -> DataFrame:
    """The next page of events after a cursor, in id order."""
    return events.where(F.col(id_col) > after_id).orderBy(id_col).limit(limit)


def debounce_bundles(notes: DataFrame, now: Column, keys: tuple[str, ...] = ("row",), ts: str = "ts", tie: str = "event_id", gap_seconds: int = 120) -> DataFrame:
    """Bundles of notes of one row less than ``gap`` apart, once the newest is at least ``gap`` old."""
    gap = gap_seconds * 1_000_000
    rows = notes.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    runs = S.islands(rows, list(keys), ["_us", tie], ["_us"], lambda b, r: r["_us"] - b["_us"] >= gap, CHUNK_US, "_run")
    bundles = runs.groupBy(*keys, "_run").agg(F.min(ts).alias("first"), F.max(ts).alias("newest"), F.count("*").alias("notes"), F.max("_us").alias("_last"))
    settled = F.unix_micros(now.cast("timestamp")) - F.col("_last") >= gap
    return bundles.where(settled).drop("_run", "_last")


def debounce_stream(notes: DataFrame, keys: tuple[str, ...] = ("row",), ts: str = "ts", gap_seconds: int = 120, delay: str = "0 seconds") -> DataFrame:
    """The same bundles from a stream: a session window, emitted when the watermark passes its end (append mode)."""
    late = notes.withWatermark(ts, delay)
    sessions = late.groupBy(*keys, F.session_window(ts, f"{gap_seconds} seconds")).agg(F.min(ts).alias("first"), F.max(ts).alias("newest"), F.count("*").alias("notes"))
    return sessions.drop("session_window")


def counts_over_time(events: DataFrame, keys: list[str], ts: str, width: str, slide: str | None = None) -> DataFrame:
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("events")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def leases(beats: DataFrame, ttl_seconds: int = 900, key: str = "project", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each heartbeat with whether it holds the lease and from whom it took over.

    After a silence of the whole time-to-live any owner is taken, so the
    history falls into runs that are walked on their own, the holder being all
    that is remembered.
    """
    ttl = ttl_seconds * 1_000_000
    rows = beats.select(key, "owner", ts, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    runs = S.islands(rows, [key], ["_us", tie], ["_us"], lambda b, r: r["_us"] - b["_us"] >= ttl, CHUNK_US, "_run")
    rows = runs.select(key, F.to_json("_run").alias("_run"), "_us", tie, "owner", ts)

    def fold():
        held: list[tuple] = []

        def row(values: tuple) -> list[tuple]:
            own, _, us, mark, owner, at = values
            free = not held or held[0][0] == owner or us - held[0][1] >= ttl
            if free:
                held[:] = [(owner, us)]
            return [(own, owner, at, mark, free)]

        return row, list

    kinds = dict(rows.dtypes)
    schema = f"`{key}` {kinds[key]}, owner {kinds['owner']}, `{ts}` {kinds[ts]}, `{tie}` {kinds[tie]}, granted boolean"
    return S.walk(rows, [key, "_run"], ["_us", tie], fold, schema)


def leases_stream(beats: DataFrame, ttl_seconds: int = 900, buckets: int = BUCKETS) -> DataFrame:
    """The same rule on a stream of (project, owner, ts, event_id); append mode."""
    ttl, memory = ttl_seconds * 1_000_000, "project long, owner string, at long"

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {own: (owner, at) for own, owner, at in unpack(state.get[0] if state.exists else None)}
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        granted = []
        for own, who, us in zip(whole(rows["project"]), rows["owner"].tolist(), micros(rows["ts"])):
            owner, at = held.get(own, (None, None))
            free = owner is None or owner == who or us - at >= ttl
            if free:
                held[own] = (who, us)
            granted.append(free)
        state.update((pack(memory, [(own, *m) for own, m in held.items()]),))
        yield pd.DataFrame({"project": rows["project"].to_numpy(), "owner": rows["owner"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "granted": granted})

    return dealt(beats, "project", buckets).groupBy(BUCKET).applyInPandasWithState(hold, "project long, owner string, event_id long, granted boolean", "block binary", "append", "NoTimeout")


def live_status_stream(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Running effective state per receipt (columns of ``BUS_EVENT``); update mode.

    Keeps only the open run's start, its last working stretch and the newest
    block that is not progress, so a receipt's state does not grow with the log.
    """
    opened, waiting = set(OPEN_STATES), set(WAITING)
    memory = "receipt long, started long, work long, effective string, version long"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {own: rest for own, *rest in unpack(state.get[0] if state.exists else None)}
        rows = pd.concat(list(batches)).sort_values("seq")
        touched = {}
        for own, us, now in zip(whole(rows["receipt"]), micros(rows["ts"]), rows["state"].tolist()):
            started, work, effective, version = held.get(own, (None, None, None, 0))
            if now not in opened:
                started = work = effective = None
            else:
                started = us if started is None else started
                work = None if now in waiting else (us if work is None else work)
                if now != "progress" or effective is None or effective == "progress":
                    effective = now
            held[own] = touched[own] = (started, work, effective, version + 1)
        state.update((pack(memory, [(own, *m) for own, m in held.items()]),))
        stamps = lambda us: np.array(us, dtype="datetime64[us]")
        newest = list(touched.values())
        yield pd.DataFrame(
            {
                "receipt": pd.Series(list(touched), dtype="object" if None in touched else "int64"), "state": pd.Series([m[2] for m in newest], dtype="object"),
                "started": stamps([m[0] for m in newest]), "working_since": stamps([m[0] if m[1] is None else m[1] for m in newest]), "version": [m[3] for m in newest],
            }
        )

    return dealt(blocks, "receipt", buckets).groupBy(BUCKET).applyInPandasWithState(
        fold, "receipt long, state string, started timestamp_ntz, working_since timestamp_ntz, version long", "block binary", "update", "NoTimeout"
    )


def due_schedules(schedules: DataFrame, now: Column) -> DataFrame:
    """Unfired schedules that are due, oldest first, with their lateness in seconds."""
    late = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("due_at").cast("timestamp"))
    due = schedules.where(F.col("fired_at").isNull() & (late >= 0))
    return due.withColumn("late_seconds", F.floor(late / 1_000_000)).orderBy("due_at", "id")


def capture_schedule(publications: DataFrame, existing: DataFrame, hours: tuple[int, ...] = (24, 72)) -> DataFrame:
    """Capture rows after each publication, none twice; a publication without a time yields a reason instead.

    A project that already has capture rows gets none.
    """
    fresh = publications.join(existing.select("project").distinct(), "project", "left_anti")
    listed = F.when(F.col("published_at").isNotNull(), F.array(*[F.lit(h) for h in hours])).otherwise(F.array(F.lit(None).cast("int")))
    rows = fresh.select("project", "published_at", F.explode(listed).alias("hours"))
    due = F.col("published_at") + F.make_dt_interval(hours=F.col("hours"))
    return rows.select("project", "hours", due.alias("due_at"), F.when(F.col("published_at").isNull(), "no published time").alias("reason"))


def unanswered(orders: DataFrame, answers: DataFrame, now: Column, wait_seconds: int = 300, lookback_hours: int = 48) -> DataFrame:
    """Orders older than the wait, younger than the lookback, with no answer, oldest first."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("sent").cast("timestamp"))) / 1_000_000
    waiting = orders.withColumn("age_s", age).where((F.col("age_s") >= wait_seconds) & (F.col("age_s") <= lookback_hours * 3600))
    return waiting.join(answers.select("receipt").distinct(), "receipt", "left_anti").orderBy(F.col("age_s").desc(), "receipt")


def unanswered_stream(orders: DataFrame, answers: DataFrame, wait_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Orders that get no answer within the wait: a stream-stream outer join bounded in time.

    ``orders``: receipt, sent. ``answers``: receipt, answered. Rows later than
    ``delay`` are not waited for.
    """
    left = orders.withWatermark("sent", delay)
    right = answers.withColumnRenamed("receipt", "_r").withWatermark("answered", delay)
    within = (F.col("receipt") == F.col("_r")) & (F.col("answered") >= F.col("sent")) & (F.col("answered") <= F.col("sent") + F.expr(f"INTERVAL {wait_seconds} SECONDS"))
    return left.join(right, within, "left_outer").where("_r IS NULL").select(*orders.columns)


def reconcile(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Active jobs to drop, with the reason: project gone, nothing left, stage moved, or inputs changed."""
    known = projects.select("project", F.col("next_stage").alias("_next"), F.col("fingerprint").alias("_print"), F.lit(True).alias("_known"))
    active = jobs.where(F.col("status").isin("QUEUED", "CLAIMED", "RUNNING"))
    reason = (
        F.when(F.col("_known").isNull(), "project is gone")
        .when(F.col("_next").isNull(), "no stage left")
        .when(F.col("_next") != F.col("stage"), "stage moved")
        .when(F.col("input_hash").isNotNull() & (F.col("input_hash") != F.col("_print")), "inputs changed")
    )
    return active.join(known, "project", "left").select("job_id", "project", "stage", reason.alias("reason")).where("reason IS NOT NULL")
