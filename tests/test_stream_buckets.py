"""Streams keep state and timers by bucket of keys, with the result of one group per key."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from cutlake.streaming import bus, jobs, ordered
from cutlake.streaming.run import drain

BASE = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, per_file):
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i : i + per_file], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def states(frame, mode, tmp_path):
    """The most state rows any micro-batch kept."""
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: df.count()).start()
    query.awaitTermination()
    return max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])


JOBS = [(k if k else None, i, a, BASE + dt.timedelta(seconds=100 * i + k)) for i, a in enumerate(["enqueue", "claim", "fail", "claim"]) for k in range(60)]
JOB = "project long, seq long, action string, ts timestamp"


def test_few_state_rows_for_many_keys(spark, tmp_path):
    rows = stream(spark, tmp_path, JOBS, JOB, 240)
    assert states(jobs.job_state_stream(rows, buckets=3), "update", tmp_path) <= 4  # a bucket more for rows without a key


@pytest.mark.parametrize("buckets", [1, 7])
def test_job_state_by_buckets(spark, tmp_path, buckets):
    out = drain(jobs.job_state_stream(stream(spark, tmp_path, JOBS, JOB, 100), buckets=buckets), "update")
    last = out.groupBy("project").agg(F.max_by(F.struct("status", "attempt", "events"), "batch").alias("r")).select("project", "r.*")
    assert sorted(map(tuple, last.collect()), key=repr) == sorted(((k or None, "CLAIMED", 1, 4) for k in range(60)), key=repr)


def test_leases_and_status_share_a_bucket(spark, tmp_path):
    beats = [(k, o, BASE + dt.timedelta(seconds=s), 10 * k + i) for k in range(5) for i, (o, s) in enumerate([("a", 0), ("b", 10), ("a", 20 + k), ("b", 200)])]
    out = drain(bus.leases_stream(stream(spark, tmp_path, beats, "project long, owner string, ts timestamp, event_id long", 20), ttl_seconds=60, buckets=1), "append")
    assert sorted((r.project, r.event_id - 10 * r.project, r.granted) for r in out.collect()) == [(k, i, g) for k in range(5) for i, g in enumerate([True, False, True, True])]


def test_schedules_of_a_bucket_fire_each_once(spark, tmp_path):
    at = lambda h: BASE + dt.timedelta(hours=h)
    rows = [(i, at(0), at(5 + i % 3), None) for i in range(40)] + [(1, at(1), at(6), at(1)), (2, at(2), at(7), None), (99, at(7), at(500), None), (98, at(50), at(500), None)]
    made = stream(spark, tmp_path, rows, "id long, made timestamp, due_at timestamp, fired_at timestamp", 41)
    frame = ordered.due_stream(made, clock="made", buckets=2)
    out = drain(frame, "append")
    assert sorted((r.id, r.due_at) for r in out.collect()) == [(i, at(5 + i % 3)) for i in range(40) if i != 1]
