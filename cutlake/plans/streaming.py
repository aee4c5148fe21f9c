"""Stream and queue queries (T1-T9): batch forms, and streams drained over the given tables."""

from pyspark.sql import functions as F

from cutlake.operators import ledger as L
from cutlake.plans.base import Dialect, query, view
from cutlake.streaming import bus as B
from cutlake.streaming import jobs as J
from cutlake.streaming import ordered as O
from cutlake.streaming.run import drain

c = F.col


def _stream(t, name: str):
    """A table's file as a stream source; the pattern makes the one file a listing."""
    schema = t.spark.read.parquet(f"{t.folder}/{name}.parquet").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}.parque[t]")


@query("t1_events_since", "SELECT event_id, ts, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def _(t):
    return B.events_since(t.events.select("event_id", "ts", "event_type"), 500, 100)


@query("t1_events_stream", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def _(t):
    schema = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    rows = B.events_stream(t.spark, f"{t.folder}/events.parque[t]", schema, after_id=500)
    return drain(rows.select("event_id", "event_type"), "append").drop("batch")


BUNDLES = """nt AS (SELECT user_id AS row, ts, event_id FROM events WHERE event_type IN ('click', 'view')), lg AS (SELECT *, lag(ts) OVER (PARTITION BY row ORDER BY ts, event_id) AS p FROM nt),
sn AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY ts, event_id) AS s FROM lg), bd AS (SELECT row, min(ts) AS first, max(ts) AS newest, count(*) AS notes FROM sn GROUP BY row, s)"""


@query("t2_debounce_bundles", f"WITH {BUNDLES} SELECT * FROM bd WHERE (SELECT max(ts) FROM events) - newest >= INTERVAL 6 HOUR")
def _(t):
    notes = t.events.where("event_type IN ('click', 'view')").select(c("user_id").alias("row"), "ts", "event_id")
    return B.debounce_bundles(notes, t.events.select(F.max("ts")).scalar(), gap_seconds=21_600)


@query("t2_debounce_stream", f"WITH {BUNDLES} SELECT * FROM bd WHERE (SELECT max(ts) FROM nt) - newest >= INTERVAL 6 HOUR")
def _(t):
    notes = _stream(t, "events").where("event_type IN ('click', 'view')").select(c("user_id").alias("row"), c("ts").cast("timestamp").alias("ts"))
    out = drain(B.debounce_stream(notes, gap_seconds=21_600), "append").drop("batch")
    return out.withColumns({"first": c("first").cast("timestamp_ntz"), "newest": c("newest").cast("timestamp_ntz")})


@query("t2_counts_over_time", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS events FROM events GROUP BY 1, 2")
def _(t):
    return B.counts_over_time(t.events.select("event_type", c("ts").cast("timestamp").alias("ts")), ["event_type"], "ts", "1 day").select("event_type", c("start").cast("timestamp_ntz").alias("start"), "events")


LEASES = """WITH RECURSIVE b AS (SELECT user_id AS project, event_type AS owner, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT project, owner, ts, event_id, rn, owner AS holder, ts AS held, true AS granted FROM b WHERE rn = 1
  UNION ALL
  SELECT b.project, b.owner, b.ts, b.event_id, b.rn, CASE WHEN b.owner = f.holder OR b.ts - f.held >= INTERVAL 12 HOUR THEN b.owner ELSE f.holder END, CASE WHEN b.owner = f.holder OR b.ts - f.held >= INTERVAL 12 HOUR THEN b.ts ELSE f.held END,
    b.owner = f.holder OR b.ts - f.held >= INTERVAL 12 HOUR FROM f JOIN b ON b.project = f.project AND b.rn = f.rn + 1)
SELECT project, owner, event_id, granted FROM f"""


@query("t3_leases", LEASES)
def _(t):
    beats = t.events.select(c("user_id").alias("project"), c("event_type").alias("owner"), "ts", "event_id")
    return B.leases(beats, ttl_seconds=43_200).select("project", "owner", "event_id", "granted")


@query("t3_leases_stream", LEASES)
def _(t):
    beats = _stream(t, "events").select(c("user_id").alias("project"), c("event_type").alias("owner"), "ts", "event_id")
    return drain(B.leases_stream(beats, ttl_seconds=43_200), "append").drop("batch")


# What a watermark ten minutes behind the newest event has passed.
PASSED = "epoch_us(ts) <= ((SELECT max(epoch_us(ts)) FROM events) // 1000 - 600000) * 1000"


@query("t3_leases_in_order", LEASES.replace("AS rn FROM events)", f"AS rn FROM events WHERE {PASSED})"))
def _(t):
    beats = _stream(t, "events").select(c("user_id").alias("project"), c("event_type").alias("owner"), "ts", "event_id")
    return drain(O.leases_in_order(beats, ttl_seconds=43_200), "append").drop("batch")


@view
def job_events(q: Dialect) -> str:
    return f"""SELECT o_custkey AS project, o_orderkey AS seq, o_orderdate AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 'enqueue' WHEN '2-HIGH' THEN 'claim' WHEN '3-MEDIUM' THEN 'start'
      WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'finish' WHEN 'O' THEN 'defer' ELSE 'fail' END ELSE CASE o_orderstatus WHEN 'F' THEN 'enqueue' ELSE 'fail' END END AS action FROM {q.t('orders')}"""


MOVES = ", ".join(f"'{k}': '{v}'" for k, v in J.transitions(2).items())
JOBS = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts, seq) AS rn FROM job_events),
f AS (SELECT project, rn, ts, coalesce((MAP {{{MOVES}}})['NONE:0|' || action], 'NONE:0') AS code FROM e WHERE rn = 1
  UNION ALL SELECT e.project, e.rn, e.ts, coalesce((MAP {{{MOVES}}})[f.code || '|' || e.action], f.code) FROM f JOIN e ON e.project = f.project AND e.rn = f.rn + 1),
l AS (SELECT project, arg_max(code, rn) AS code, count(*) AS events, max(ts) AS updated_at FROM f GROUP BY 1)"""


@query("t4_job_state", f"{JOBS} SELECT project, split_part(code, ':', 1) AS status, split_part(code, ':', 2)::INTEGER AS attempt, events, updated_at FROM l")
def _(t):
    return J.job_state(t.job_events, width=365 * 86_400_000_000)


def _job_stream(t):
    p, s = c("o_orderpriority"), c("o_orderstatus")
    action = (
        F.when(p == "1-URGENT", "enqueue").when(p == "2-HIGH", "claim").when(p == "3-MEDIUM", "start")
        .when(p == "4-NOT SPECIFIED", F.when(s == "F", "finish").when(s == "O", "defer").otherwise("fail")).otherwise(F.when(s == "F", "enqueue").otherwise("fail"))
    )
    return _stream(t, "orders").select(c("o_custkey").alias("project"), c("o_orderkey").alias("seq"), action.alias("action"), c("o_orderdate").alias("ts"))


@query(
    "t4_job_state_in_order",
    JOBS.replace("FROM job_events)", "FROM job_events WHERE ts <= (SELECT max(ts) FROM job_events) - INTERVAL 36 HOUR)") + " SELECT project, split_part(code, ':', 1) AS status, split_part(code, ':', 2)::INTEGER AS attempt, events FROM l",
)
def _(t):
    out = drain(O.job_state_in_order(_job_stream(t), delay="36 hours"), "append")
    return out.groupBy("project").agg(F.max_by(F.struct("status", "attempt", "events"), "events").alias("r")).select("project", "r.*")


@query("t4_job_state_stream", f"{JOBS} SELECT project, split_part(code, ':', 1) AS status, split_part(code, ':', 2)::INTEGER AS attempt, events FROM l")
def _(t):
    out = drain(J.job_state_stream(_job_stream(t)), "update")
    rest = F.struct("status", "attempt", "events")
    return out.groupBy("project").agg(F.max_by(rest, "batch").alias("r")).select("project", "r.*")


@query(
    "t5_due_schedules",
    """SELECT o_orderkey AS id, o_orderdate AS due_at, (epoch(TIMESTAMP '2000-01-01' - o_orderdate))::BIGINT AS late_seconds FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '2000-01-01'""",
)
def _(t):
    plans = t.orders.select(c("o_orderkey").alias("id"), c("o_orderdate").alias("due_at"), F.when(c("o_orderstatus") == "F", c("o_orderdate")).alias("fired_at"))
    return B.due_schedules(plans, F.lit("2000-01-01").cast("timestamp")).select("id", "due_at", "late_seconds")


@query(
    "t5_due_stream",
    """SELECT o_orderkey AS id, o_orderdate + INTERVAL 252 HOUR AS due_at FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 252 HOUR <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 36 HOUR""",
)
def _(t):
    made = c("o_orderdate")
    plans = _stream(t, "orders").select(c("o_orderkey").alias("id"), made.alias("made"), (made + F.make_dt_interval(hours=F.lit(252))).alias("due_at"), F.when(c("o_orderstatus") == "F", made).alias("fired_at"))
    return drain(O.due_stream(plans, clock="made", delay="36 hours"), "append").select("id", "due_at")


@query(
    "t6_capture_schedule",
    """WITH p AS (SELECT o_orderkey AS project, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS published_at FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax = 0.08))
    SELECT project, h AS hours, published_at + to_hours(h::BIGINT) AS due_at, NULL::VARCHAR AS reason FROM p, (VALUES (24), (72)) v(h) WHERE published_at IS NOT NULL UNION ALL SELECT project, NULL, NULL, 'no published time' FROM p WHERE published_at IS NULL""",
)
def _(t):
    published = t.orders.select(c("o_orderkey").alias("project"), F.when(c("o_orderstatus") != "P", c("o_orderdate")).alias("published_at"))
    return B.capture_schedule(published, t.lineitem.where("l_tax = 0.08").select(c("l_orderkey").alias("project")))


@query(
    "t7_unanswered",
    """SELECT event_id AS receipt, ts AS sent, round(epoch_us((SELECT max(ts) FROM events) - ts) / 1000000.0, 6)::DOUBLE AS age_s FROM events WHERE event_type = 'click' AND (SELECT max(ts) FROM events) - ts BETWEEN INTERVAL 300 SECOND AND INTERVAL 240 HOUR
    AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'view')""",
)
def _(t):
    orders = t.events.where("event_type = 'click'").select(c("event_id").alias("receipt"), c("ts").alias("sent"))
    answers = t.events.where("event_type = 'view'").select((c("event_id") - 1).alias("receipt"))
    out = B.unanswered(orders, answers, t.events.select(F.max("ts")).scalar(), lookback_hours=240)
    return out.withColumn("age_s", F.round("age_s", 6)).select("receipt", "sent", "age_s")


@query(
    "t7_unanswered_stream",
    """WITH o AS (SELECT event_id AS receipt, user_id, ts AS sent FROM events WHERE event_type = 'click'), a AS (SELECT user_id, ts FROM events WHERE event_type = 'view'), m AS (SELECT least((SELECT max(sent) FROM o), (SELECT max(ts) FROM a)) - INTERVAL 10 MINUTE AS w)
    SELECT receipt, sent FROM o, m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = o.user_id AND a.ts >= sent AND a.ts <= sent + INTERVAL 48 HOUR) AND date_trunc('milliseconds', sent) + INTERVAL 48 HOUR < date_trunc('milliseconds', w)""",
)
def _(t):
    rows = _stream(t, "events").select("event_id", "user_id", "event_type", c("ts").cast("timestamp").alias("ts"))
    orders = rows.where("event_type = 'click'").select(c("user_id").alias("receipt"), c("ts").alias("sent"), "event_id")
    answers = _stream(t, "events").where("event_type = 'view'").select(c("user_id").alias("receipt"), c("ts").cast("timestamp").alias("answered"))
    out = drain(B.unanswered_stream(orders, answers, wait_seconds=172_800), "append")
    return out.select(c("event_id").alias("receipt"), c("sent").cast("timestamp_ntz").alias("sent"))


@query(
    "t8_live_status_stream",
    """WITH s AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'picked_up' WHEN '2-HIGH' THEN 'queued' WHEN '3-MEDIUM' THEN 'progress' WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END ELSE CASE WHEN o_orderstatus = 'F' THEN 'called' ELSE 'blocked' END END AS state FROM orders),
    e AS (SELECT o_custkey AS receipt, o_orderkey AS seq, o_orderdate AS ts, state, state IN ('picked_up', 'running', 'progress', 'queued', 'blocked') AS op FROM s),
    x AS (SELECT receipt, coalesce(max(seq) FILTER (NOT op), -1) AS closed, coalesce(max(seq) FILTER (NOT op OR state IN ('queued', 'blocked')), -1) AS waited FROM e GROUP BY 1),
    r AS (SELECT receipt, arg_min(ts, seq) AS started, arg_min(ts, seq) FILTER (seq > waited) AS work, coalesce(arg_max(state, seq) FILTER (state <> 'progress'), arg_max(state, seq)) AS state FROM e JOIN x USING (receipt) WHERE seq > closed GROUP BY 1)
    SELECT receipt, state, started, coalesce(work, started) AS working_since FROM r""",
)
def _(t):
    out = drain(B.live_status_stream(_blocks(t)), "update")
    now = out.groupBy("receipt").agg(F.max_by(F.struct("state", "started", "working_since"), "batch").alias("r")).select("receipt", "r.*")
    return now.where("state IS NOT NULL")


def _blocks(t):
    p, s = c("o_orderpriority"), c("o_orderstatus")
    state = (
        F.when(p == "1-URGENT", "picked_up").when(p == "2-HIGH", "queued").when(p == "3-MEDIUM", "progress")
        .when(p == "4-NOT SPECIFIED", F.when(s == "F", "finished").otherwise("running")).otherwise(F.when(s == "F", "called").otherwise("blocked"))
    )
    return _stream(t, "orders").select(c("o_custkey").alias("receipt"), c("o_orderkey").alias("seq"), c("o_orderdate").alias("ts"), state.alias("state"))


@query(
    "t8_live_status_in_order",
    """WITH s AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'picked_up' WHEN '2-HIGH' THEN 'queued' WHEN '3-MEDIUM' THEN 'progress' WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END ELSE CASE WHEN o_orderstatus = 'F' THEN 'called' ELSE 'blocked' END END AS state FROM orders),
    e AS (SELECT o_custkey AS receipt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderdate AS ts, state, state IN ('picked_up', 'running', 'progress', 'queued', 'blocked') AS op FROM s WHERE o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 36 HOUR),
    x AS (SELECT receipt, coalesce(max(seq) FILTER (NOT op), -1) AS closed, coalesce(max(seq) FILTER (NOT op OR state IN ('queued', 'blocked')), -1) AS waited FROM e GROUP BY 1),
    r AS (SELECT receipt, arg_min(ts, seq) AS started, arg_min(ts, seq) FILTER (seq > waited) AS work, coalesce(arg_max(state, seq) FILTER (state <> 'progress'), arg_max(state, seq)) AS state FROM e JOIN x USING (receipt) WHERE seq > closed GROUP BY 1)
    SELECT receipt, state, started, coalesce(work, started) AS working_since FROM r""",
)
def _(t):
    out = drain(O.live_status_in_order(_blocks(t), delay="36 hours"), "append")
    now = out.groupBy("receipt").agg(F.max_by(F.struct("state", "started", "working_since"), "version").alias("r")).select("receipt", "r.*")
    return now.where("state IS NOT NULL")


@query(
    "t9_reconcile",
    """WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS project, substr(o_orderpriority, 1, 1) AS stage, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS status, CASE WHEN o_totalprice > 100000 THEN CAST(o_custkey % 9 AS VARCHAR) END AS h FROM orders),
    p AS (SELECT c_custkey AS project, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN '2' ELSE '1' END AS nx, CAST(c_nationkey % 9 AS VARCHAR) AS fp FROM customer WHERE c_mktsegment <> 'FURNITURE')
    SELECT job_id, j.project, stage, CASE WHEN p.project IS NULL THEN 'project is gone' WHEN nx IS NULL THEN 'no stage left' WHEN nx <> stage THEN 'stage moved' WHEN h <> fp THEN 'inputs changed' END AS reason FROM j LEFT JOIN p USING (project) WHERE status <> 'DONE' AND reason IS NOT NULL""",
)
def _(t):
    jobs = t.orders.select(
        c("o_orderkey").alias("job_id"), c("o_custkey").alias("project"), F.substring("o_orderpriority", 1, 1).alias("stage"), F.when(c("o_orderstatus") == "F", "DONE").when(c("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING").alias("status"),
        F.when(c("o_totalprice") > 100000, (c("o_custkey") % 9).cast("string")).alias("input_hash"),
    )
    nxt = F.when(c("c_mktsegment") == "MACHINERY", "2").when(c("c_mktsegment") != "BUILDING", "1")
    projects = t.customer.where("c_mktsegment <> 'FURNITURE'").select(c("c_custkey").alias("project"), nxt.alias("next_stage"), (c("c_nationkey") % 9).cast("string").alias("fingerprint"))
    return B.reconcile(jobs, projects)
