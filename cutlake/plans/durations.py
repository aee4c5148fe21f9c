"""Event-gap queries: W1, W2, G21, G22, G23, U2."""

from pyspark.sql import functions as F

from cutlake.operators import durations as D
from cutlake.plans.base import Dialect, query, view
from cutlake.session import cut_lineage


@view
def phase_events(q: Dialect) -> str:
    return f"""SELECT user_id AS row, ts, event_id,
      CASE event_type WHEN 'signup' THEN 'feasibility' WHEN 'click' THEN 'build' WHEN 'view' THEN 'audit'
        WHEN 'error' THEN 'fix' ELSE 'deliver' END AS phase,
      CASE WHEN event_type = 'error' THEN 1 + {q.div(q.json_int('props', 'k'), '34')} END AS fix_round
      FROM {q.t('events')}"""


KEPT = """e AS (SELECT *, row_number() OVER (PARTITION BY row, phase, fix_round ORDER BY ts, event_id) AS rn FROM phase_events),
k AS (SELECT row, phase, fix_round, event_id, rn, ts, ts AS last_kept, true AS keep FROM e WHERE rn = 1
  UNION ALL
  SELECT e.row, e.phase, e.fix_round, e.event_id, e.rn, e.ts,
    CASE WHEN e.ts - k.last_kept > INTERVAL {m} MINUTE THEN e.ts ELSE k.last_kept END,
    e.ts - k.last_kept > INTERVAL {m} MINUTE
  FROM k JOIN e ON e.row = k.row AND e.phase = k.phase AND e.fix_round IS NOT DISTINCT FROM k.fix_round AND e.rn = k.rn + 1),
kept AS (SELECT row, phase, fix_round, event_id, ts FROM k WHERE keep)"""
GAPS = """g AS (SELECT *, lag(phase) OVER w AS previous_phase, epoch_us(ts - lag(ts) OVER w) / 3600000000.0 AS hours
  FROM {src} WINDOW w AS (PARTITION BY row ORDER BY ts, event_id)),
samples AS (SELECT * FROM g WHERE phase <> 'feasibility' AND previous_phase <> 'deliver' AND hours > 0 AND hours <= 48),
priors(phase, prior) AS (VALUES ('feasibility', 0.75e0), ('cast', 1.5e0), ('build', 3.5e0), ('audit', 1.5e0),
  ('fix', 4.0e0), ('deliver', 0.75e0), ('intake', 0.15e0), ('study', 1.0e0)),
q AS (SELECT phase, count(*) AS n, quantile_cont(hours, 0.25) AS a, quantile_cont(hours, 0.5) AS b, quantile_cont(hours, 0.75) AS c
  FROM samples GROUP BY phase),
stats AS (SELECT p.phase, coalesce(q.n, 0) AS n,
  CASE WHEN q.n >= 3 THEN round(a, 3) ELSE prior * 0.6e0 END AS p25_h,
  CASE WHEN q.n >= 3 THEN round(b, 3) ELSE prior END AS median_h,
  CASE WHEN q.n >= 3 THEN round(c, 3) ELSE prior * 1.6e0 END AS p75_h,
  CASE WHEN q.n >= 3 THEN 'history' ELSE 'prior' END AS source
  FROM priors p LEFT JOIN q USING (phase))"""
FACTS = """facts AS (SELECT row, count(*) AS events,
    count(DISTINCT CASE WHEN phase = 'fix' AND fix_round <> 0 THEN fix_round END) AS fix_rounds,
    max(CASE WHEN phase = 'deliver' THEN ts END) AS done,
    min(CASE WHEN phase IN ('feasibility', 'cast', 'build') THEN ts END) AS opened
  FROM {src} GROUP BY row),
runs AS (SELECT *, epoch_us(done - opened) / 3600000000.0 AS h FROM facts WHERE events >= 2),
model AS (
  SELECT 'phase' AS part, * FROM stats
  UNION ALL
  SELECT 'fix_rounds', 'fix', count(*), NULL, CASE WHEN count(*) >= 2 THEN round(quantile_cont(fix_rounds::DOUBLE, 0.5), 2) ELSE 3.0 END, NULL,
    CASE WHEN count(*) >= 2 THEN 'history' ELSE 'prior' END FROM runs WHERE fix_rounds > 0
  UNION ALL
  SELECT 'total_hours', 'run', count(*), round(quantile_cont(h, 0.25), 2), round(quantile_cont(h, 0.5), 2), round(quantile_cont(h, 0.75), 2), 'history'
  FROM runs WHERE h > 0 AND h <= 192)"""
OUT = "row, phase, event_id, fix_round, ts"


@query("w1_dedupe_within", f"WITH RECURSIVE {KEPT.format(m=90)} SELECT {OUT} FROM kept")
def _(t):
    return D.dedupe_within(t.phase_events).select("row", "phase", "event_id", "fix_round", "ts")


@query("w1_dedupe_within_three_days", f"WITH RECURSIVE {KEPT.format(m=4320)} SELECT {OUT} FROM kept")
def _(t):
    return D.dedupe_within(t.phase_events, minutes=4320).select("row", "phase", "event_id", "fix_round", "ts")


@query("w2_gaps", f"WITH {GAPS.format(src='phase_events')} SELECT row, event_id, phase, previous_phase, round(hours, 6) AS hours FROM g WHERE hours IS NOT NULL")
def _(t):
    return D.gaps(t.phase_events).select("row", "event_id", "phase", "previous_phase", F.round("hours", 6).alias("hours"))


@query("g21_phase_stats", f"WITH RECURSIVE {KEPT.format(m=90)}, {GAPS.format(src='kept')} SELECT phase, n, p25_h, median_h, p75_h, source FROM stats")
def _(t):
    return D.phase_stats(D.phase_samples(D.gaps(cut_lineage(D.dedupe_within(t.phase_events)))))


@query(
    "g22_fit_durations",
    f"WITH RECURSIVE {KEPT.format(m=90)}, {GAPS.format(src='kept')}, {FACTS.format(src='kept')} "
    "SELECT part, phase, n, p25_h, median_h, p75_h, source FROM model",
)
def _(t):
    return D.fit_durations(cut_lineage(D.dedupe_within(t.phase_events))).select("part", "phase", "n", "p25_h", "median_h", "p75_h", "source")


ESTIMATE_SQL = f"""WITH RECURSIVE {KEPT.format(m=90)}, {GAPS.format(src='kept')}, {FACTS.format(src='kept')},
newest AS (SELECT row, arg_max(phase, (ts, event_id)) AS phase, max(ts) AS ts,
    count(DISTINCT CASE WHEN phase = 'fix' AND fix_round <> 0 THEN fix_round END) AS rounds_done,
    bool_or(phase IN ('intake', 'study')) AS fresh FROM kept GROUP BY row),
activity AS (SELECT user_id AS row, max(ts) AS at FROM events WHERE value > 50 GROUP BY 1),
ahead(phase, tail) AS (VALUES ('intake', ['study', 'build', 'audit']), ('study', ['build', 'audit']),
  ('feasibility', ['cast', 'build', 'audit']), ('cast', ['build', 'audit']), ('build', ['audit']), ('audit', []), ('fix', ['audit'])),
placed AS (SELECT n.row, n.phase, greatest(n.ts, coalesce(v.at, n.ts)) AS ts, n.rounds_done, tail, greatest(0, round_even(CASE WHEN fresh THEN 1.0 ELSE (SELECT median_h FROM model WHERE part = 'fix_rounds') END, 0)::BIGINT - rounds_done) AS rounds_left
  FROM newest n JOIN ahead a USING (phase) LEFT JOIN activity v ON v.row = n.row),
steps AS (SELECT row, phase, ts, rounds_done, unnest(tail || list_transform(range(2 * rounds_left), lambda i: CASE WHEN i % 2 = 0 THEN 'fix' ELSE 'audit' END) || ['deliver']) AS p FROM placed),
sums AS (SELECT s.row, s.phase, s.ts, s.rounds_done, count(*) AS steps, sum(m.p25_h) AS a, sum(m.median_h) AS b, sum(m.p75_h) AS c
  FROM steps s JOIN model m ON m.part = 'phase' AND m.phase = s.p GROUP BY ALL),
spent AS (SELECT *, greatest(0.0, epoch_us((SELECT max(ts) FROM phase_events) - ts) / 3600000000.0) AS e FROM sums),
left_ AS (SELECT *, greatest(0.25e0, b - e) AS l, greatest(0.25e0, a - e) AS w FROM spent),
high AS (SELECT *, greatest(l, c - e) AS h FROM left_)
SELECT row, phase, rounds_done, steps, round(l, 2) AS remaining_hours, round(greatest(0.25e0, (h - w) / 2), 1) AS spread_hours,
  CASE phase WHEN 'fix' THEN CASE WHEN rounds_done > 0 THEN 'fix round ' || rounds_done ELSE 'fix round' END WHEN 'cast' THEN 'casting' WHEN 'deliver' THEN 'delivery' WHEN 'study' THEN 'reference study' ELSE phase END AS phase_label,
  ts AS anchor, (SELECT max(ts) FROM phase_events) + to_seconds(round(round(l, 2) * 3600, 0)::BIGINT) AS eta FROM high"""


@query("g23_estimate", ESTIMATE_SQL)
def _(t):
    newest = t.phase_events.select(F.max("ts")).scalar()
    kept = cut_lineage(D.dedupe_within(t.phase_events))
    activity = t.events.where("value > 50").select(F.col("user_id").alias("row"), F.col("ts").alias("active_at"))
    return D.estimate(kept, cut_lineage(D.fit_durations(kept)), newest, activity=activity)


@query(
    "u2_merge_streams",
    """SELECT 'bus' AS source, user_id AS row, ts, event_type AS phase, event_id FROM events
    UNION ALL SELECT 'registry', o_custkey, o_orderdate, o_orderstatus, NULL FROM orders""",
)
def _(t):
    bus = t.events.select(F.lit("bus").alias("source"), F.col("user_id").alias("row"), F.col("ts").alias("ts"), F.col("event_type").alias("phase"), "event_id")
    registry = t.orders.select(F.lit("registry").alias("source"), F.col("o_custkey").alias("row"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("phase"))
    return D.merge_streams(bus, registry).select("source", "row", "ts", "phase", "event_id")
