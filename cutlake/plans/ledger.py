"""Ledger folds, queues and board queries."""

from pyspark.sql import functions as F

from cutlake.functions import timecode as T
from cutlake.operators import filters as P
from cutlake.operators import ledger as L
from cutlake.operators import scan as S
from cutlake.plans.base import Dialect, query, view

c = F.col


@view
def grade_events(q: Dialect) -> str:
    return f"""SELECT ts, event_id AS seq, concat('CLIP_', cast(user_id as string)) AS stem, user_id AS clip_id,
      CASE event_type WHEN 'signup' THEN 'HERO' WHEN 'click' THEN 'BROLL' WHEN 'view' THEN CASE WHEN k < 50 THEN 'NEVER' ELSE 'odd' END END AS grade,
      CASE WHEN event_type = 'error' THEN 'ME' WHEN event_type = 'purchase' AND k > 40 THEN 'NOTME' END AS ident,
      CASE WHEN k >= 25 THEN cast(5 * (k % 4) as double) END AS t0, CASE WHEN k >= 35 THEN cast(5 * (k % 4) + 5 - 10 * {q.div('k', '95')} as double) END AS t1
      FROM (SELECT *, {q.json_int('props', 'k')} AS k FROM {q.t('events')}) x"""


@view
def clip_tags(q: Dialect) -> str:
    return f"""SELECT concat('C', lpad(cast(p_partkey as string), 7, '0')) AS clip_id, p_partkey AS n, concat('CLIP_', cast(p_partkey as string)) AS stem, p_size * 0.7e0 AS duration,
      lower(p_type) AS role_a, split_part(p_name, ' ', 1) AS role_b, split_part(p_name, ' ', 2) AS verb, p_brand AS world,
      CASE WHEN p_size < 17 THEN 'low' WHEN p_size < 34 THEN 'medium' ELSE 'high' END AS energy, CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 'person' ELSE 'object' END AS subject,
      CASE WHEN p_name LIKE 'hot%' OR p_name LIKE 'red%' THEN 'warm' ELSE 'cool' END AS lighting, CASE WHEN p_size > 10 THEN 'safe' ELSE 'unsafe' END AS crop,
      CASE p_brand WHEN 'Brand#1' THEN 'high' WHEN 'Brand#2' THEN 'medium' ELSE 'low' END AS confidence, p_type <> 'ECONOMY' AS tagged,
      CASE WHEN p_size < 45 THEN concat('proxy/', cast(p_partkey as string)) END AS proxy, p_size * 17 AS frame_count FROM {q.t('part')}"""


@view
def bus_blocks(q: Dialect) -> str:
    """Orders of a customer as the status lines of one receipt."""
    return f"""SELECT o_custkey AS receipt, {q.div('o_custkey', '10')} AS row, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderdate AS ts,
      CASE o_orderstatus WHEN 'P' THEN 'runner' WHEN 'O' THEN 'runner-2' ELSE 'editor' END AS lane,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'picked_up' WHEN '2-HIGH' THEN 'queued' WHEN '3-MEDIUM' THEN 'progress' WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END
        ELSE CASE WHEN o_orderstatus = 'F' THEN 'called' ELSE 'blocked' END END AS state,
      CASE WHEN o_totalprice > 250000 THEN 'disk floor' ELSE 'usage limit' END AS why, {q.seconds('o_orderdate', '3600')} AS not_before FROM {q.t('orders')}"""


FOLD = """w AS (SELECT stem, arg_max(CASE WHEN t0 IS NULL AND t1 IS NULL THEN grade END, (ts, seq)) FILTER (t0 IS NULL AND t1 IS NULL AND grade IS NOT NULL) AS grade,
  arg_max(ident, (ts, seq)) FILTER (t0 IS NULL AND t1 IS NULL AND ident IS NOT NULL) AS ident
  FROM grade_events WHERE (t0 IS NULL) = (t1 IS NULL) GROUP BY 1),
seg AS (SELECT stem, any_value(t0) AS t0, any_value(t1) AS t1, arg_max(grade, (ts, seq)) AS grade FROM grade_events WHERE t0 IS NOT NULL AND t1 IS NOT NULL AND grade IS NOT NULL GROUP BY stem, printf('%.2f-%.2f', t0, t1)),
segs AS (SELECT stem, string_agg(printf('%.2f-%.2f', t0, t1) || '=' || grade, ',' ORDER BY printf('%.2f-%.2f', t0, t1)) AS segments FROM seg GROUP BY 1)"""


def _show(df):
    pairs = F.array_sort(F.transform(F.map_entries("segments"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return df.withColumn("segments", F.when(c("segments").isNotNull(), F.array_join(pairs, ",")))


@query("w3_fold_grades", f"WITH {FOLD} SELECT stem, grade, ident, segments FROM w LEFT JOIN segs USING (stem)")
def _(t):
    return _show(L.fold_grades(t.grade_events)).select("stem", "grade", "ident", "segments")


STRICT = """e AS (SELECT *, coalesce(t1 > t0, false) AS win, CASE WHEN grade IN ('HERO', 'BROLL', 'NEVER') THEN grade END AS g, CASE WHEN ident IN ('ME', 'NOTME') THEN ident END AS i FROM grade_events),
ws AS (SELECT stem, arg_max(g, (ts, seq)) FILTER (NOT win AND g IS NOT NULL) AS grade, arg_max(i, (ts, seq)) FILTER (i IS NOT NULL) AS ident FROM e GROUP BY 1),
ss AS (SELECT stem, t0, t1, arg_max(g, (ts, seq)) AS grade FROM e WHERE win AND g IS NOT NULL GROUP BY 1, 2, 3)"""


@query(
    "w3_fold_grades_strict",
    f"WITH {STRICT}, sg AS (SELECT stem, string_agg(printf('%.2f-%.2f', t0, t1) || '=' || grade, ',' ORDER BY printf('%.2f-%.2f', t0, t1)) AS segments FROM ss GROUP BY 1) SELECT stem, grade, ident, segments FROM ws LEFT JOIN sg USING (stem)",
)
def _(t):
    return _show(L.fold_grades(t.grade_events, strict=True)).select("stem", "grade", "ident", "segments")


SEGMENTS = """cuts AS (SELECT clip_id, stem, duration, greatest(2, round_even(duration / 5.0, 0)::INTEGER) AS n FROM clip_tags),
grid AS (SELECT clip_id, stem, duration, i - 1 AS piece, CASE WHEN duration <= 7.0 THEN 0.0 WHEN i = 1 THEN 0.0 ELSE printf('%.2f', (i - 1) * duration / n)::DOUBLE END::DOUBLE AS t0,
  CASE WHEN duration <= 7.0 OR i = n THEN duration ELSE printf('%.2f', i * duration / n)::DOUBLE END::DOUBLE AS t1 FROM cuts, range(1, 12) r(i) WHERE i <= CASE WHEN duration <= 7.0 THEN 1 ELSE n END)"""


@query("w4_segments", f"WITH {SEGMENTS} SELECT clip_id, piece, t0, t1 FROM grid")
def _(t):
    cut = t.clip_tags.select("clip_id", F.posexplode(T.segments(c("duration"))).alias("piece", "s"))
    return cut.select("clip_id", c("piece").cast("long").alias("piece"), "s.t0", "s.t1")


def _items(t):
    return t.clip_tags.select("clip_id", "stem", "duration").join(L.fold_grades(t.grade_events).drop("clip_id", "ts"), "stem", "left")


PIECES = f"""{FOLD}, {SEGMENTS}, p AS (SELECT g.*, coalesce(seg.grade, w.grade) AS standing FROM grid g LEFT JOIN seg ON seg.stem = g.stem AND printf('%.2f-%.2f', seg.t0, seg.t1) = printf('%.2f-%.2f', g.t0, g.t1)
  LEFT JOIN w ON w.stem = g.stem)"""


@query(
    "w5_piece_coverage",
    f"WITH {PIECES} SELECT clip_id, count(*) AS pieces, count(standing) AS graded, min(piece) FILTER (standing IS NULL) AS first_uncovered FROM p GROUP BY 1",
)
def _(t):
    return L.piece_coverage(_items(t))


@query(
    "g2_grade_summary",
    f"""WITH {PIECES}, k AS (SELECT clip_id, count(*) AS n, count(*) FILTER (standing IN ('HERO', 'BROLL', 'NEVER')) AS k, count(*) FILTER (standing = 'HERO') AS h, count(*) FILTER (standing = 'BROLL') AS b, count(*) FILTER (standing = 'NEVER') AS v FROM p GROUP BY 1),
    l AS (SELECT clip_id, w.grade, w.ident FROM clip_tags LEFT JOIN w USING (stem))
    SELECT (SELECT count(*) FROM l) AS total, (SELECT count(*) FROM l WHERE grade = 'HERO') AS whole_hero, (SELECT count(*) FROM l WHERE grade = 'BROLL') AS whole_broll, (SELECT count(*) FROM l WHERE grade = 'NEVER') AS whole_never,
      (SELECT count(*) FROM l WHERE ident = 'ME') AS ident_me, (SELECT count(*) FROM l WHERE ident = 'NOTME') AS ident_notme, sum(n)::BIGINT AS segments_total, sum(k)::BIGINT AS segments_graded,
      count(*) FILTER (n = k) AS clips_covered, sum(h)::BIGINT AS segments_hero, sum(b)::BIGINT AS segments_broll, sum(v)::BIGINT AS segments_never, min(clip_id) FILTER (k < n) AS first_uncovered_clip FROM k""",
)
def _(t):
    return L.grade_summary(_items(t))


OPENED = "('picked_up', 'running', 'progress', 'queued', 'blocked')"
EFFECTIVE = f"""x AS (SELECT receipt, coalesce(max(seq) FILTER (state NOT IN {OPENED}), -1) AS closed, coalesce(max(seq) FILTER (state NOT IN {OPENED} OR state IN ('queued', 'blocked')), -1) AS waited FROM bus_blocks GROUP BY 1),
r AS (SELECT receipt, arg_max(lane, seq) AS lane, max(row) AS row, arg_min(ts, seq) AS started, arg_min(ts, seq) FILTER (seq > waited) AS work,
  coalesce(arg_max((state, why, not_before), seq) FILTER (state <> 'progress'), arg_max((state, why, not_before), seq)) AS e FROM bus_blocks JOIN x USING (receipt) WHERE seq > closed GROUP BY 1),
eff AS (SELECT receipt, row, lane, started, coalesce(work, started) AS working_since, e[1] AS state, e[1] IN ('queued', 'blocked') AS queued, CASE WHEN e[1] IN ('queued', 'blocked') THEN e[2] END AS why, e[3] AS not_before FROM r)"""


@query("w6_effective_state", f"WITH {EFFECTIVE} SELECT * FROM eff")
def _(t):
    return L.effective_state(t.bus_blocks)


@query(
    "w7_picked_up",
    f"""WITH {EFFECTIVE}, f AS (SELECT * FROM eff WHERE epoch_us((SELECT max(ts) FROM bus_blocks)) - epoch_us(working_since) < 90::BIGINT * 86400 * 1000000)
    SELECT row, arg_max(receipt, (started, receipt)) AS receipt, arg_max(lane, (started, receipt)) AS lane, arg_max(started, (started, receipt)) AS started, arg_max(working_since, (started, receipt)) AS working_since, arg_max(state, (started, receipt)) AS state FROM f GROUP BY 1""",
)
def _(t):
    return L.picked_up(t.bus_blocks, t.bus_blocks.select(F.max("ts")).scalar(), trust_seconds=90 * 86_400)


@query(
    "w8_latest_answer",
    "SELECT o_custkey AS call_id, max(o_orderpriority) AS sequence, arg_max(o_orderkey, (o_orderpriority, o_orderkey)) AS name, arg_max(o_orderstatus, (o_orderpriority, o_orderkey)) AS answer FROM orders GROUP BY 1",
)
def _(t):
    answers = t.orders.select(c("o_custkey").alias("call_id"), c("o_orderpriority").alias("sequence"), c("o_orderkey").alias("name"), c("o_orderstatus").alias("answer"))
    return L.latest_answer(answers)


@query(
    "w9_verdict_history",
    """SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER w AS sequence, lag(o_orderstatus) OVER w AS previous_verdict FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def _(t):
    out = L.verdict_history(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", width=365 * S.DAY_US)
    return out.select("o_custkey", "o_orderkey", "o_orderstatus", "sequence", "previous_verdict")


@query(
    "p9_classify_orders",
    """WITH now_ AS (SELECT max(ts) AS n FROM bus_blocks), ev AS (SELECT *, CASE WHEN row % 3 = 0 THEN NULL ELSE state END AS st, CASE WHEN state = 'called' THEN 'CALL' ELSE 'ACK' END AS head FROM bus_blocks),
    a AS (SELECT receipt, arg_max((head, lane, st, state), seq) AS l, bool_or(lane LIKE 'runner%') AS mine, arg_max((st, lane, not_before), seq) FILTER (lane LIKE 'runner%' AND st IS NOT NULL) AS own, count(*) FILTER (st = 'queued' AND lane = 'runner') AS tries FROM ev GROUP BY 1),
    o AS (SELECT c_custkey AS receipt, CASE c_mktsegment WHEN 'BUILDING' THEN 'smoketest' ELSE 'feedback' END AS kind, TIMESTAMP '2001-07-01' + to_days((c_custkey % 40)::INTEGER) AS sent FROM customer)
    SELECT receipt, kind, CASE WHEN kind = 'smoketest' THEN 'skip' WHEN mine AND own[1] = 'queued' AND own[2] = 'runner' AND tries < 3 AND own[3] <= n THEN 'retry' WHEN mine THEN 'closed'
      WHEN l IS NULL AND n - sent > INTERVAL 14 DAY THEN 'stale' WHEN l IS NULL THEN 'actionable' WHEN l[3] IN ('finished', 'called') THEN 'closed' WHEN l[3] IS NOT NULL THEN 'claimed' WHEN l[1] = 'CALL' THEN 'closed'
      WHEN l[4] = 'picked_up' THEN 'claimed' ELSE 'closed' END AS verdict, coalesce(tries, 0) AS tries FROM o LEFT JOIN a USING (receipt), now_""",
)
def _(t):
    state = F.when(c("row") % 3 != 0, c("state"))
    line = F.concat(F.lit("ACK — "), c("lane"), F.lit(" — "), F.replace(c("state"), F.lit("_"), F.lit(" ")))
    events = t.bus_blocks.select("receipt", "seq", F.when(c("state") == "called", "CALL").otherwise("ACK").alias("head"), "lane", state.alias("state"), "not_before", line.alias("line"))
    day = F.make_dt_interval((c("c_custkey") % 40).cast("int"))
    orders = t.customer.select(
        c("c_custkey").alias("receipt"), F.when(c("c_mktsegment") == "BUILDING", "smoketest").otherwise("feedback").alias("kind"), (F.lit("2001-07-01").cast("timestamp_ntz") + day).alias("sent")
    )
    return P.classify_orders(orders, events, t.bus_blocks.select(F.max("ts")).scalar()).select("receipt", "kind", "verdict", "tries")


@query("o1_order_queue", "SELECT o_orderpriority AS priority, o_orderdate AS sent, o_orderkey AS name FROM orders ORDER BY 1, 2, 3")
def _(t):
    return L.order_queue(t.orders.select(c("o_orderpriority").alias("priority"), c("o_orderdate").alias("sent"), c("o_orderkey").alias("name")))


IDENTITY_SQL = "i AS (SELECT 'CLIP_' || c_custkey AS stem, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 END AS rk FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))"


def _grader(t):
    library = t.clip_tags.select("clip_id", "stem", "proxy", (c("world") == "Brand#3").alias("is_new"), (~c("tagged")).alias("untagged"))
    scores = t.clip_tags.where("energy <> 'low'").select("clip_id", F.when(c("subject") == "person", "PERSON").when(c("lighting") == "warm", "EMPTY").otherwise("FAINT").alias("verdict"))
    usage = t.lineitem.groupBy(F.concat(F.lit("CLIP_"), c("l_partkey").cast("string")).alias("stem")).agg(F.count("*").alias("uses"))
    kinds = F.when(c("c_mktsegment") == "BUILDING", "blacklisted").when(c("c_mktsegment") == "MACHINERY", "not_operator").when(c("c_mktsegment") == "HOUSEHOLD", "settled")
    identity = t.customer.select(F.concat(F.lit("CLIP_"), c("c_custkey").cast("string")).alias("stem"), kinds.alias("kind")).where("kind IS NOT NULL")
    return L.grader_items(library, scores, usage, L.fold_grades(t.grade_events), identity)


ITEMS_SQL = f"""{FOLD}, {IDENTITY_SQL}, u AS (SELECT 'CLIP_' || l_partkey AS stem, count(*) AS uses FROM lineitem GROUP BY 1),
items AS (SELECT t.clip_id, t.stem, t.world = 'Brand#3' AS is_new, NOT tagged AS untagged, CASE WHEN proxy IS NULL THEN 'NO_PROXY' WHEN energy = 'low' THEN 'UNSCANNED' WHEN subject = 'person' THEN 'PERSON' WHEN lighting = 'warm' THEN 'EMPTY' ELSE 'FAINT' END AS verdict,
  CASE rk WHEN 0 THEN 'blacklisted' WHEN 1 THEN 'not_operator' WHEN 2 THEN 'settled' ELSE 'unruled' END AS identity, coalesce(uses, 0) AS uses, w.grade, w.ident
  FROM clip_tags t LEFT JOIN i USING (stem) LEFT JOIN u USING (stem) LEFT JOIN w USING (stem))"""


@query("j3_grader_items", f"WITH {ITEMS_SQL} SELECT clip_id, stem, verdict, identity, uses, grade, ident FROM items")
def _(t):
    return _grader(t).select("clip_id", "stem", "verdict", "identity", "uses", "grade", "ident")


@query(
    "o2_grading_queue",
    f"""WITH {ITEMS_SQL} SELECT clip_id, stem, CASE WHEN is_new THEN 0 WHEN verdict = 'NO_PROXY' THEN 6 WHEN untagged THEN 1 WHEN verdict = 'PERSON' THEN CASE WHEN identity = 'unruled' THEN 2 ELSE 3 END WHEN verdict = 'EMPTY' THEN 5 ELSE 4 END::BIGINT AS queue_group FROM items""",
)
def _(t):
    return L.grading_queue(_grader(t)).select("clip_id", "stem", "queue_group")


@query(
    "o4_brief",
    """SELECT 'lesson' AS part, p_partkey AS id, CASE WHEN p_name LIKE '%ring' OR p_name LIKE 'red%' THEN 0 ELSE 1 END::BIGINT AS tier, p_size = 7 AS starred FROM part
    UNION ALL SELECT 'inbox', o_orderkey, 2, false FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 7""",
)
def _(t):
    lessons = t.part.select(c("p_partkey").alias("id"), c("p_size").alias("row"), F.split("p_name", " ").alias("tags"))
    inbox = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("row"), F.when(c("o_orderstatus") != "O", "done").alias("triage"))
    return L.brief(lessons, inbox, 7, ["ring", "red"])


@query(
    "o5_top_k_per",
    """SELECT user_id, event_id, value, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) x WHERE rn <= 5""",
)
def _(t):
    return S.top_k_per(t.events.select("user_id", "event_id", "value"), ["user_id"], [c("value").desc(), c("event_id")], 5)


@query("o6_recent", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t):
    return L.recent(t.events.select("event_id", "ts", "event_type"), "ts", "event_id", 50)


@query(
    "u1_effective_settled",
    f"""WITH {STRICT}, s AS (SELECT 'CLIP_' || c_custkey AS stem FROM customer WHERE c_mktsegment = 'HOUSEHOLD' UNION SELECT stem FROM ss WHERE grade = 'HERO' UNION SELECT stem FROM ws WHERE grade = 'HERO' OR ident = 'ME')
    SELECT stem FROM s WHERE stem NOT IN (SELECT stem FROM ws WHERE grade = 'NEVER' OR ident = 'NOTME')""",
)
def _(t):
    pool = t.customer.where("c_mktsegment = 'HOUSEHOLD'").select(F.concat(F.lit("CLIP_"), c("c_custkey").cast("string")).alias("stem"))
    return L.effective_settled(pool, t.grade_events)


@query(
    "u3_slot_contract_diff",
    """WITH m AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_tax = 0), v AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_tax = 0.08)
    (SELECT *, 'missing' AS side FROM m EXCEPT SELECT *, 'missing' FROM v) UNION ALL (SELECT *, 'extra' FROM v EXCEPT SELECT *, 'extra' FROM m)""",
)
def _(t):
    li = t.lineitem
    return L.slot_contract_diff(li.where("l_returnflag = 'A' AND l_tax = 0"), li.where("l_returnflag = 'R' AND l_tax = 0.08"), ["l_suppkey", "l_linenumber"])


@query(
    "u5_row_timeline",
    """SELECT o_custkey AS row, o_orderdate AS ts, 'cast' AS kind, o_orderkey AS name FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_custkey, o_orderdate, CASE WHEN o_totalprice > 300000 THEN 'render refused' ELSE 'render' END, o_orderkey FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT user_id, ts, 'receipt', event_id FROM events WHERE event_type <> 'error'""",
)
def _(t):
    o = t.orders.select(c("o_custkey").alias("row"), c("o_orderdate").alias("ts"), c("o_orderkey").alias("name"), (c("o_totalprice") > 300000).alias("refused"), "o_orderstatus")
    receipts = t.events.select(c("user_id").alias("row"), "ts", F.when(c("event_type") == "error", "smoketest").otherwise("note").alias("kind"), c("event_id").alias("name"))
    return L.row_timeline(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'O'"), receipts)


@query(
    "g1_census",
    "SELECT p_brand AS world, count(*) AS clips, round(count(*) / (SELECT count(*) FROM part) * 100, 2) AS share_percent, count(*) AS block_ceiling FROM part GROUP BY 1",
)
def _(t):
    return L.census(t.part.select(c("p_brand").alias("world")), ["world"])


@query(
    "g1_census_rollup",
    "SELECT p_brand AS world, p_type AS kind, count(*) AS clips, round(count(*) / (SELECT count(*) FROM part) * 100, 2) AS share_percent, count(*) AS block_ceiling FROM part GROUP BY ROLLUP (1, 2)",
)
def _(t):
    return L.census(t.part.select(c("p_brand").alias("world"), c("p_type").alias("kind")), ["world", "kind"], rollup=True)


@query(
    "g36_board_counts",
    """WITH k AS (SELECT o_orderkey AS row, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'needs_you' ELSE CASE WHEN o_totalprice > 250000 THEN 'parked' ELSE 'machine' END END AS bucket, CASE WHEN o_orderpriority < '3' THEN o_orderdate END AS eta FROM orders)
    SELECT bucket, count(*) AS cards, arg_min(row, (eta, row)) FILTER (eta IS NOT NULL) AS soonest_row, min(eta) AS soonest_eta, CASE bucket WHEN 'needs_you' THEN 0 WHEN 'machine' THEN 1 WHEN 'parked' THEN 2 ELSE 3 END::BIGINT AS position FROM k GROUP BY 1""",
)
def _(t):
    bucket = F.when(c("o_orderstatus") == "F", "done").when(c("o_orderstatus") == "O", "needs_you").when(c("o_totalprice") > 250000, "parked").otherwise("machine")
    return L.board_counts(t.orders.select(c("o_orderkey").alias("row"), bucket.alias("bucket"), F.when(c("o_orderpriority") < "3", c("o_orderdate")).alias("eta")))


@query(
    "g37_lane_quota",
    """WITH u AS (SELECT lower(n_name) AS holder, 0 AS r FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'nation_' || s_nationkey, 1 FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'nation_' || c_nationkey, 2 FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT holder, ['headline', 'registry', 'intake'][min(r) + 1] AS found_in, count(*) AS declarations FROM u GROUP BY 1""",
)
def _(t):
    lane = lambda cond: F.when(cond, "Craft ").otherwise("volume").alias("lane")
    named = lambda col: F.concat(F.lit("NATION_"), c(col).cast("string")).alias("shortcode")
    return L.lane_quota(
        t.nation.select(c("n_name").alias("shortcode"), lane(c("n_regionkey") == 1)), t.supplier.select(named("s_nationkey"), lane(c("s_acctbal") > 5000)),
        t.customer.select(named("c_nationkey"), lane(c("c_mktsegment") == "BUILDING")), "CRAFT",
    )


@query(
    "j4_pending_drops",
    """SELECT event_id, user_id AS shortcode, ts AS sent FROM events WHERE event_type = 'signup' AND (SELECT max(ts) FROM events) - ts <= INTERVAL 480 HOUR AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 450000)""",
)
def _(t):
    drops = t.events.where("event_type = 'signup'").select("event_id", c("user_id").alias("shortcode"), c("ts").alias("sent"))
    registry = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 450000").select(c("o_custkey").alias("shortcode"))
    return L.pending_drops(drops, registry, t.events.select(F.max("ts")).scalar(), hours=480)


@query(
    "j4_terminally_failed",
    """WITH j AS (SELECT o_orderkey, o_custkey AS project, o_orderpriority AS stage, CASE WHEN o_totalprice > 100000 THEN substr(CAST(o_orderdate AS VARCHAR), 1, 4) END AS h, o_orderstatus AS s FROM orders)
    SELECT o_orderkey, project FROM j WHERE s = 'O' AND EXISTS (SELECT 1 FROM j f WHERE f.s = 'F' AND f.project = j.project AND f.stage = j.stage AND f.h IS NOT DISTINCT FROM j.h)""",
)
def _(t):
    jobs = t.orders.select("o_orderkey", c("o_custkey").alias("project"), c("o_orderpriority").alias("stage"), F.when(c("o_totalprice") > 100000, F.date_format("o_orderdate", "yyyy")).alias("input_hash"), "o_orderstatus")
    return L.terminally_failed(jobs.where("o_orderstatus = 'O'"), jobs.where("o_orderstatus = 'F'")).select("o_orderkey", "project")


@query(
    "j12_answered_after",
    """WITH k AS (SELECT event_id AS call_id, user_id AS row, ts AS raised FROM events WHERE event_type = 'error'), n AS (SELECT user_id AS row, event_id - 1 AS name, ts FROM events WHERE event_type = 'view' AND value > 90)
    SELECT * FROM k WHERE call_id NOT IN (SELECT event_id + 1 FROM events WHERE event_type = 'click') AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = 'purchase' AND f.value > 120 AND f.user_id = k.row AND f.ts > k.raised)
      AND NOT EXISTS (SELECT 1 FROM n WHERE n.row = k.row AND n.ts > k.raised AND n.name <> k.call_id)""",
)
def _(t):
    e = t.events
    calls = e.where("event_type = 'error'").select(c("event_id").alias("call_id"), c("user_id").alias("row"), c("ts").alias("raised"))
    rulings = e.where("event_type = 'click'").select((c("event_id") + 1).alias("call_id"))
    finished = e.where("event_type = 'purchase' AND value > 120").select(c("user_id").alias("row"), "ts")
    notes = e.where("event_type = 'view' AND value > 90").select(c("user_id").alias("row"), (c("event_id") - 1).alias("name"), "ts")
    return L.answered_after(calls, rulings, finished, notes)


@query(
    "j17_merge_calls",
    """WITH r AS (SELECT s_suppkey AS call_id, s_nationkey::BIGINT AS project, 'AWAITING' AS state, 'registry' AS source FROM supplier), i AS (SELECT c_custkey AS call_id, c_nationkey::BIGINT AS project, 'OPEN' AS state, 'intake' AS source FROM customer),
    m AS (SELECT * FROM r UNION ALL SELECT * FROM i WHERE call_id NOT IN (SELECT call_id FROM r)), a AS (SELECT o_custkey AS call_id, arg_max(o_orderkey, (o_orderpriority, o_orderkey)) AS name FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
    SELECT call_id, project, CASE WHEN name IS NULL THEN state ELSE 'ANSWERED' END AS state, source, name AS answer_receipt FROM m LEFT JOIN a USING (call_id)""",
)
def _(t):
    registry = t.supplier.select(c("s_suppkey").alias("call_id"), c("s_nationkey").cast("long").alias("project"), F.lit("AWAITING").alias("state"))
    intake = t.customer.select(c("c_custkey").alias("call_id"), c("c_nationkey").cast("long").alias("project"), F.lit("OPEN").alias("state"))
    answers = t.orders.where("o_totalprice > 400000").select(c("o_custkey").alias("call_id"), c("o_orderpriority").alias("sequence"), c("o_orderkey").alias("name"))
    return L.merge_calls(registry, intake, answers)


@view
def file_index(q: Dialect) -> str:
    return f"""SELECT concat('v', cast(l_partkey as string), '.mp4') AS name, CASE WHEN l_tax > 0.02e0 THEN l_suppkey END AS owner,
      concat(CASE l_returnflag WHEN 'A' THEN '/w/deliver/' WHEN 'N' THEN '/w/deliver/variants/' ELSE '/w/raw/' END, cast(l_orderkey as string), '-', cast(l_linenumber as string)) AS path, cast(l_quantity as bigint) AS bytes, l_shipdate AS mtime FROM {q.t('lineitem')}"""


@query(
    "j18_resolve_file",
    """WITH w AS (SELECT DISTINCT l_suppkey AS row, 'v' || l_partkey || '.mp4' AS name, (l_partkey % 50)::BIGINT AS bytes FROM lineitem),
    p AS (SELECT w.*, path, mtime, f.bytes AS b, CASE WHEN owner IS NULL THEN 2 WHEN path LIKE '%/deliver/%' AND path NOT LIKE '%/variants/%' THEN 0 ELSE 1 END AS tier FROM w JOIN file_index f ON f.name = w.name AND (f.owner IS NULL OR f.owner = w.row)),
    k AS (SELECT *, row_number() OVER (PARTITION BY row, name ORDER BY tier, b = bytes DESC, mtime DESC, path DESC) AS rn FROM p)
    SELECT w.row, w.name, w.bytes, k.path FROM w LEFT JOIN k ON k.row = w.row AND k.name = w.name AND rn = 1""",
)
def _(t):
    wants = t.lineitem.select(c("l_suppkey").alias("row"), F.concat(F.lit("v"), c("l_partkey").cast("string"), F.lit(".mp4")).alias("name"), (c("l_partkey") % 50).alias("bytes"))
    # a name has one size, so this is DISTINCT, already dealt by the keys that owned copies are met on
    wants = wants.groupBy("row", "name").agg(F.max("bytes").alias("bytes"))
    return L.resolve_file(wants, t.file_index).select("row", "name", "bytes", "path")


@query("j21_unlisted_cards", "SELECT c_custkey AS call_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    return L.unlisted_cards(t.customer.select(c("c_custkey").alias("call_id"), "c_name"), t.orders.where("o_orderstatus = 'F'").select(c("o_custkey").alias("call_id")))


@view
def batch_files(q: Dialect) -> str:
    return f"""SELECT l_suppkey AS row, l_linenumber AS stamp, CASE WHEN l_tax < 0.03e0 THEN concat('cast_var', cast(cast(round(l_discount * 100) as int) as string), '.json') WHEN l_linenumber > 5 AND l_suppkey < 5 THEN 'card.md'
        ELSE concat('08 — TRIAL VARIANT 0', cast(cast(round(l_tax * 100) as int) as string), ' (v0', cast(cast(floor(l_quantity / 10) as int) as string), ').mp4') END AS name,
      concat(CASE WHEN l_returnflag = 'A' THEN '/deliver/' ELSE '/index/' END, cast(l_orderkey as string)) AS path FROM {q.t('lineitem')}"""


VARIANT = r"try_cast(nullif(regexp_extract(name, '(?i)trial\s+variant\s+(\d{1,2})([^0-9]|$)', 1), '') AS INTEGER)"


@query(
    "w37_newest_batch",
    f"""WITH m AS (SELECT *, {VARIANT} AS v, lower(name) LIKE '%.mp4' AS vid FROM batch_files), s AS (SELECT row, max(stamp) AS stamp FROM m WHERE vid AND v BETWEEN 1 AND 99 GROUP BY 1), b AS (SELECT m.* FROM m JOIN s USING (row, stamp)),
    e AS (SELECT row, count(DISTINCT name) AS expected FROM b WHERE name LIKE 'cast_var%' GROUP BY 1), k AS (SELECT row, stamp, name, v AS variant, arg_min(path, (path NOT LIKE '%deliver%', path)) AS path FROM b WHERE vid AND v BETWEEN 1 AND 99 GROUP BY ALL)
    SELECT k.*, expected, count(*) OVER (PARTITION BY row) AS found FROM k LEFT JOIN e USING (row)""",
)
def _(t):
    return L.newest_batch(t.batch_files)


@query(
    "w38_current_version",
    r"""WITH s AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey % 3 = 0 THEN 3 END AS want FROM supplier), f AS (SELECT row, name, try_cast(nullif(regexp_extract(name, '(?i)\(\s*v(\d{1,3})([^0-9a-z_]|$)', 1), '') AS INTEGER) AS v FROM batch_files)
    SELECT f.row, coalesce(min(name) FILTER (v = want), arg_min(name, (-v, name)) FILTER (v IS NOT NULL), max(name)) AS name FROM f LEFT JOIN s USING (row) GROUP BY 1""",
)
def _(t):
    states = t.supplier.select(c("s_suppkey").alias("row"), F.when(c("s_suppkey") % 3 == 0, "RECAST_V003__READY").otherwise("READY").alias("state"))
    return L.current_version(t.batch_files, states)
