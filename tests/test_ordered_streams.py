"""Streams whose rows come out of order give the batch result."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from cutlake.streaming import bus, jobs, ordered
from cutlake.streaming.run import drain

BASE = dt.datetime(2024, 1, 1)


def written(spark, tmp_path, rows, schema, per_file=40):
    """Rows as files of one micro-batch each, in the given order."""
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i : i + per_file], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def shuffled(seed, n, keys, minutes):
    """(key, event_id, ts) nearly in time order: each row at most half a minute late."""
    rng = random.Random(seed)
    rows = [(rng.randrange(keys), i, BASE + dt.timedelta(seconds=rng.randrange(minutes * 60))) for i in range(n)]
    return sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(30)))


def test_leases_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.choice("abc"), ts, i) for k, i, ts in shuffled(1, 240, 3, 60)]
    rows.append((9, "z", BASE + dt.timedelta(days=1), 9999))  # moves the watermark past the rest
    schema = "project long, owner string, ts timestamp, event_id long"
    out = drain(ordered.leases_in_order(written(spark, tmp_path, rows, schema), ttl_seconds=60, delay="1 minute"), "append")
    want = bus.leases(spark.createDataFrame(rows[:-1], schema), ttl_seconds=60).select("project", "owner", "event_id", "granted")
    assert sorted(map(tuple, out.where("project < 9").drop("batch").collect())) == sorted(map(tuple, want.collect()))
    assert out.select("batch").distinct().count() > 2


def test_job_state_out_of_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, i, rng.choice(["enqueue", "claim", "start", "finish", "fail"]), ts) for k, i, ts in shuffled(2, 240, 5, 60)]
    rows.append((9, 9999, "enqueue", BASE + dt.timedelta(days=1)))
    schema = "project long, seq long, action string, ts timestamp"
    out = drain(ordered.job_state_in_order(written(spark, tmp_path, rows, schema), delay="1 minute"), "append")
    last = out.groupBy("project").agg(F.max_by(F.struct("status", "attempt", "events"), "batch").alias("r")).select("project", "r.*")
    want = jobs.job_state(spark.createDataFrame(rows[:-1], schema)).select("project", "status", "attempt", "events")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_counted_and_idle_keys_end(spark, tmp_path):
    at = lambda minutes: BASE + dt.timedelta(minutes=minutes)
    rows = [(1, 1, at(0), "queued"), (2, 2, at(100), "running"), (1, 3, at(1), "running"), (2, 4, at(300), "progress"), (1, 5, at(899), "running"), (3, 6, at(2000), "running")]
    schema = "receipt long, seq long, ts timestamp, state string"
    stream = ordered.live_status_in_order(written(spark, tmp_path, rows, schema, per_file=1), delay="1 minute", idle_seconds=3600)
    got = sorted((r.receipt, r.state, r.started, r.version, r.late) for r in drain(stream, "append").collect())
    # the row of minute 1 comes behind the watermark; after an hour of silence a run is a new one
    assert got == [(1, "queued", at(0), 1, 1), (1, "running", at(899), 1, 1), (2, "progress", at(300), 1, 0), (2, "running", at(100), 1, 0)]


def test_a_schedule_fires_once_without_input(spark, tmp_path):
    soon = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(seconds=6)
    rows = [(1, soon, None), (2, BASE, BASE), (3, soon + dt.timedelta(days=3), None)]
    stream = written(spark, tmp_path, rows, "id long, due_at timestamp_ntz, fired_at timestamp_ntz", per_file=3)
    out = str(tmp_path / "out")
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    query = ordered.due_stream(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").foreachBatch(write).start()
    end = time.time() + 60
    while time.time() < end and not (query.lastProgress and query.lastProgress["batchId"] > 3 and spark.read.parquet(out).count()):
        time.sleep(1)
    time.sleep(3)
    query.stop()
    got = spark.read.parquet(out).collect()
    assert [(r.id, r.due_at) for r in got] == [(1, soon)] and got[0].batch > 0 and 0 <= got[0].late_seconds < 40
