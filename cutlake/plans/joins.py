"""Interval, nearest and comparison joins."""

from pyspark.sql import functions as F

from cutlake.functions import timecode as T
from cutlake.operators import filters as P
from cutlake.operators import joins as J
from cutlake.operators import ledger as L
from cutlake.operators.nearest import as_of, nearest
from cutlake.plans.base import Dialect, query, view
from cutlake.plans.filters import clips
from cutlake.plans.ledger import STRICT

c = F.col


@view
def inventory(q: Dialect) -> str:
    return f"""SELECT concat('C', lpad(cast(p_partkey as string), 7, '0')) AS clip_id, {q.sha("concat(p_brand, ' ', cast(p_partkey as string))")} AS sha256,
      concat(CASE WHEN p_size > 4 THEN 'masters/' ELSE 'proxy/' END, 'ab12__CLIP_', cast(p_partkey as string), '.MP4') AS relative_path, CASE WHEN p_size = 50 THEN 'FAIL' ELSE 'PASS' END AS status, p_brand FROM {q.t('part')}"""


BANS = """SELECT 'id' AS kind, 'C' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS key FROM orders WHERE o_totalprice > 480000 UNION ALL SELECT 'file', 'CLIP_' || o_custkey FROM orders WHERE o_totalprice < 20000"""


@query(
    "j1_candidate_table",
    f"""WITH b AS ({BANS}) SELECT i.clip_id, relative_path, CASE WHEN t.clip_id IS NOT NULL THEN t.clip_id END AS library_id, CASE WHEN status <> 'PASS' THEN 'not_pass' WHEN relative_path NOT LIKE 'masters/%' THEN 'not_master'
      WHEN i.clip_id IN (SELECT key FROM b WHERE kind = 'id') OR regexp_extract(relative_path, '__(.*)\\.MP4', 1) IN (SELECT key FROM b WHERE kind = 'file') THEN 'banned' WHEN NOT coalesce(t.tagged, false) THEN 'untagged' ELSE 'candidate' END AS outcome
    FROM inventory i LEFT JOIN clip_tags t ON t.stem || '.MP4' = regexp_extract(relative_path, '__(.*)', 1) AND t.energy <> 'low'""",
)
def _(t):
    dear, cheap = t.orders.where("o_totalprice > 480000"), t.orders.where("o_totalprice < 20000")
    entries = dear.select(F.concat(F.lit("C"), F.lpad(c("o_custkey").cast("string"), 7, "0")).alias("id"), F.lit(None).cast("string").alias("file"))
    entries = entries.unionByName(cheap.select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("CLIP_"), c("o_custkey").cast("string")).alias("file")))
    bans = P.ban_keys(entries.withColumn("match_keys", F.array().cast("array<string>")), ["id"], ["file"], ["match_keys"])
    library = clips(t).where("tags IS NULL OR tags.energy <> 'low'").join(t.clip_tags.where("energy <> 'low'").select("clip_id"), "clip_id").withColumn("path", F.concat(F.lit("/lib/"), "stem", F.lit(".MP4")))
    return J.candidate_table(t.inventory, library, bans)


@query(
    "j2_bind_to_inventory",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'masters/ab12__CLIP_' || l_partkey || '.MP4' AS p, l_tax < 0.02 AS moved FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p AS source_path, i.clip_id AS source_clip_id, CASE WHEN i.clip_id IS NULL THEN 'not_in_inventory' WHEN moved THEN 'hash_changed' END AS fault
    FROM s LEFT JOIN inventory i ON i.relative_path = p AND i.status = 'PASS'""",
)
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    inv = t.inventory.withColumn("path", c("relative_path"))
    sha = t.inventory.select(F.regexp_extract("relative_path", r"CLIP_(\d+)", 1).cast("long").alias("l_partkey"), "sha256")
    picked = t.lineitem.join(sha.hint("merge"), "l_partkey").select(*keys, F.concat(F.lit("masters/ab12__CLIP_"), c("l_partkey").cast("string"), F.lit(".MP4")).alias("source_path"), F.when(c("l_tax") >= 0.02, c("sha256")).alias("source_sha256"))
    return J.bind_to_inventory(picked, inv, keys)


@view
def clip_uses(q: Dialect) -> str:
    """Line items as uses of a clip: the customer number names the clip, the in-point comes from the quantity."""
    return f"""SELECT o_orderkey AS use_id, o_custkey, concat('CLIP_', cast(o_custkey as string)) AS stem, concat('/vol/ab12__CLIP_', cast(o_custkey as string), '.MP4') AS ident,
      CASE WHEN o_orderpriority <> '5-LOW' THEN floor(o_totalprice / 20000) END AS t0, CASE WHEN o_orderpriority < '4' THEN floor(o_totalprice / 20000) + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 2.5e0 END END AS t1,
      CASE o_orderstatus WHEN 'F' THEN 'subject' WHEN 'O' THEN 'none' ELSE '' END AS identity FROM {q.t('orders')}"""


WG = f"""{STRICT}, u AS (SELECT *, CASE WHEN t1 > t0 THEN t1 ELSE t0 END AS b FROM clip_uses),
hit AS (SELECT use_id, bool_or(grade = 'NEVER') AS never, arg_min(grade, (s.t0, s.t1)) FILTER (s.t0 <= u.t0 AND u.t0 < s.t1) AS held FROM u JOIN ss s ON s.stem = u.stem AND ((s.t0 <= u.t0 AND u.t0 < s.t1) OR (b > u.t0 AND u.t0 < s.t1 AND b > s.t0)) GROUP BY 1),
wg AS (SELECT u.*, CASE WHEN never THEN 'NEVER' ELSE coalesce(held, ws.grade) END AS window_grade, ws.grade AS clip_grade, ws.ident AS who FROM u LEFT JOIN hit USING (use_id) LEFT JOIN ws ON ws.stem = u.stem)"""


@query("j5_window_grade", f"WITH {WG} SELECT use_id, stem, window_grade FROM wg")
def _(t):
    whole, parts = L.fold_parts(t.grade_events, strict=True)
    return J.window_grade(t.clip_uses, whole, parts).select("use_id", "stem", "window_grade")


BAN_SQL = f"""{WG}, bw AS (SELECT 'CLIP_' || c_custkey AS key, c_nationkey::DOUBLE AS lo, c_nationkey + 4.0 AS hi FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')), bf AS (SELECT 'CLIP_' || c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'),
bn AS (SELECT wg.*, CASE WHEN stem IN (SELECT key FROM bf) THEN 'full' WHEN t0 IS NULL AND stem IN (SELECT key FROM bw) THEN 'no_in_point'
  WHEN EXISTS (SELECT 1 FROM bw WHERE key = stem AND CASE WHEN b > t0 THEN t0 < hi AND b > lo ELSE lo <= t0 AND t0 < hi END) THEN 'window' END AS ban FROM wg)"""


def _bans(t):
    key = F.concat(F.lit("CLIP_"), c("c_custkey").cast("string")).alias("key")
    full = t.customer.where("c_mktsegment = 'BUILDING'").select(key)
    return full, t.customer.where("c_mktsegment IN ('MACHINERY', 'FURNITURE')").select(key, c("c_nationkey").cast("double").alias("lo"), (c("c_nationkey") + 4.0).alias("hi"))


@query("j6_blacklist_reason", f"WITH {BAN_SQL} SELECT use_id, ban FROM bn")
def _(t):
    return J.blacklist_reason(t.clip_uses, *_bans(t)).select("use_id", "ban")


@query(
    "j7_check_cast",
    f"""WITH {BAN_SQL}, st AS (SELECT stem FROM (SELECT 'CLIP_' || c_custkey AS stem FROM customer WHERE c_mktsegment = 'HOUSEHOLD' UNION SELECT stem FROM ss WHERE grade = 'HERO' UNION SELECT stem FROM ws WHERE grade = 'HERO' OR ident = 'ME')
      WHERE stem NOT IN (SELECT stem FROM ws WHERE grade = 'NEVER' OR ident = 'NOTME')),
    f AS (SELECT *, coalesce(clip_grade = 'NEVER' OR window_grade = 'NEVER' OR (t0 IS NULL AND stem IN (SELECT stem FROM ss WHERE grade = 'NEVER')), false) AS nv, coalesce(window_grade = 'BROLL', false) OR coalesce(who = 'NOTME', false) AS wrong FROM bn),
    v AS (SELECT use_id, unnest([CASE WHEN ban IS NOT NULL THEN 'blacklisted' END, CASE WHEN ban IS NULL AND nv THEN 'graded_never' END, CASE WHEN identity = 'subject' AND wrong THEN 'identity_not_subject' END,
      CASE WHEN identity = 'subject' AND NOT wrong AND stem NOT IN (SELECT stem FROM st) THEN 'identity_not_settled' END, CASE WHEN identity = '' THEN 'identity_undeclared' END]) AS violation FROM f)
    SELECT * FROM v WHERE violation IS NOT NULL""",
)
def _(t):
    whole, parts = L.fold_parts(t.grade_events, strict=True)
    pool = t.customer.where("c_mktsegment = 'HOUSEHOLD'").select(F.concat(F.lit("CLIP_"), c("c_custkey").cast("string")).alias("stem"))
    full, window = _bans(t)
    return J.check_cast(t.clip_uses.drop("stem"), full, window, whole, parts, L.effective_settled(pool, t.grade_events))


@view
def user_cuts(q: Dialect) -> str:
    return f"SELECT user_id AS asset, event_id, {q.div(q.us('ts'), '60000000')} - 28401120 AS frame, event_type FROM {q.t('events')}"


NEAR = """cu AS (SELECT * FROM user_cuts WHERE event_type IN ('click', 'view')), ons AS (SELECT DISTINCT asset, frame + CASE WHEN asset % 7 = 0 THEN 50000 ELSE 0 END AS frame FROM user_cuts WHERE event_type = 'purchase'),
d AS (SELECT cu.*, o.frame AS o, row_number() OVER (PARTITION BY cu.event_id ORDER BY abs(o.frame - cu.frame), o.frame) AS rn FROM cu LEFT JOIN ons o USING (asset)),
near AS (SELECT asset, event_id, frame, o AS nearest, abs(o - frame) AS distance FROM d WHERE rn = 1)"""


def _onsets(t):
    """Purchases; those of every seventh asset lie far from its cuts."""
    return t.user_cuts.where("event_type = 'purchase'").select("asset", (c("frame") + F.when(c("asset") % 7 == 0, 50000).otherwise(0)).alias("frame"))


def _aligned(t, tolerance):
    return J.beat_alignment(t.user_cuts.where("event_type IN ('click', 'view')"), _onsets(t), ["asset"], tolerance=tolerance, width=10080)


@query("j8_nearest", f"WITH {NEAR} SELECT asset, event_id, frame, nearest, distance, coalesce(distance <= 120, false) AS within_tolerance FROM near")
def _(t):
    return _aligned(t, 120).select("asset", "event_id", "frame", "nearest", "distance", "within_tolerance")


@query(
    "j8_beat_verdict",
    f"""WITH {NEAR}, g AS (SELECT asset, count(*) AS cuts, bool_and(coalesce(distance <= 6000, false)) AS ok FROM near GROUP BY 1), e AS (SELECT c_custkey AS asset, c_nationkey AS n FROM customer)
    SELECT e.asset, coalesce(cuts, 0) AS cuts, CASE WHEN CASE WHEN cuts IS NULL THEN n = 0 ELSE ok END THEN 'PASS' ELSE 'FAIL' END AS verdict FROM e LEFT JOIN g USING (asset)""",
)
def _(t):
    expected = t.customer.select(c("c_custkey").alias("asset"), c("c_nationkey").alias("expected_cuts"))
    return J.beat_verdict(_aligned(t, 6000), expected, ["asset"])


@query("d3_onset_delta", f"WITH {NEAR} SELECT asset, event_id, round(1000.0 * (frame / 24.0 - nearest / 24.0), 3) AS delta_ms FROM near")
def _(t):
    near = nearest(t.user_cuts.where("event_type IN ('click', 'view')"), _onsets(t), ["asset"], "frame", "frame", 10080)
    return near.select("asset", "event_id", F.round((c("frame") / 24.0 - c("nearest") / 24.0) * 1000.0, 3).alias("delta_ms"))


@view
def frame_metrics(q: Dialect) -> str:
    return f"""SELECT l_linestatus AS side, l_suppkey AS asset, {q.div(q.day('l_shipdate'), '28')} AS frame, min(l_quantity) / 50 AS y_q05, avg(l_quantity) / 50 AS y_q50, max(l_quantity) / 50 AS y_q95,
      sum(cast(round(l_discount * 100) as bigint)) / 50e0 / count(*) AS saturation_mean,
      sum(cast(round(l_tax * 100) as bigint)) * 3e0 / count(*) AS lab_a_mean, sum(cast(round(l_extendedprice * 100) as bigint)) / 200000e0 / count(*) AS lab_b_mean FROM {q.t('lineitem')} GROUP BY l_linestatus, l_suppkey, {q.div(q.day('l_shipdate'), '28')}"""


@view
def picture_blocks(q: Dialect) -> str:
    return f"""SELECT DISTINCT asset, {q.div('frame', '9')} AS block_id, {q.div('frame', '9')} * 9 AS start_frame, {q.div('frame', '9')} * 9 + 8 AS end_frame FROM {q.t('frame_metrics')}"""


FC = """b AS (SELECT coalesce(r.asset, k.asset) AS asset, coalesce(r.frame, k.frame) AS frame, r.y_q05 AS r5, r.y_q50 AS r50, r.y_q95 AS r95, r.saturation_mean AS rs, r.lab_a_mean AS ra, r.lab_b_mean AS rb, k.y_q05 AS c5, k.y_q50 AS c50, k.y_q95 AS c95, k.saturation_mean AS cs, k.lab_a_mean AS ca, k.lab_b_mean AS cb
  FROM (SELECT * FROM frame_metrics WHERE side = 'O') r FULL JOIN (SELECT * FROM frame_metrics WHERE side = 'F') k ON r.asset = k.asset AND r.frame = k.frame)"""


@query(
    "j9_frame_compare",
    f"""WITH {FC}, m AS (SELECT b.asset, block_id, count(*) FILTER (r50 IS NULL OR c50 IS NULL) AS unmatched, count(*) FILTER (c95 < 0.03 AND r95 >= 0.03) AS bl, count(*) FILTER (c5 > 0.97 AND r5 <= 0.97) AS wh,
      printf('%.8f', median(r50))::DOUBLE AS r50, printf('%.8f', median(c50))::DOUBLE AS c50, printf('%.8f', median(rs))::DOUBLE AS rs, printf('%.8f', median(cs))::DOUBLE AS cs, printf('%.8f', median(ra))::DOUBLE AS ra, printf('%.8f', median(ca))::DOUBLE AS ca, printf('%.8f', median(rb))::DOUBLE AS rb, printf('%.8f', median(cb))::DOUBLE AS cb
      FROM b JOIN picture_blocks p ON p.asset = b.asset AND b.frame >= start_frame AND b.frame < end_frame GROUP BY 1, 2),
    k AS (SELECT *, abs(c50 - r50) AS l, cs / greatest(rs, 1e-9) AS sr, sqrt(pow(ca - ra, 2) + pow(cb - rb, 2)) AS ax FROM m),
    f AS (SELECT *, concat_ws(',', CASE WHEN unmatched > 0 THEN 'frame_counts' END, CASE WHEN NOT coalesce(l <= 0.1, false) THEN 'luma_parity' END, CASE WHEN NOT coalesce(CASE WHEN rs < 0.05 THEN abs(cs - rs) <= 0.08 ELSE sr BETWEEN 0.75 AND 1.25 END, false) THEN 'saturation_parity' END,
      CASE WHEN NOT coalesce(ax <= 12, false) THEN 'neutral_axis_cast' END, CASE WHEN bl > 0 THEN 'no_unexpected_black' END, CASE WHEN wh > 0 THEN 'no_unexpected_white' END) AS failed FROM k)
    SELECT asset, block_id, unmatched, printf('%.8f', l)::DOUBLE AS luma_delta, printf('%.8f', sr)::DOUBLE AS saturation_ratio, printf('%.8f', ax)::DOUBLE AS neutral_axis, failed, CASE WHEN failed = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM f""",
)
def _(t):
    side = lambda s: t.frame_metrics.where(c("side") == s)
    return J.frame_compare(side("O"), side("F"), t.picture_blocks)


@query(
    "g27_shot_luma_delta",
    f"""WITH {FC}, p AS (SELECT b.asset, block_id AS shot, frame, c50 * 255.3719 - r50 * 255.3719 AS d FROM b JOIN picture_blocks p ON p.asset = b.asset AND frame >= start_frame AND frame < end_frame WHERE r50 IS NOT NULL AND c50 IS NOT NULL),
    s AS (SELECT *, abs(d - lag(d) OVER (PARTITION BY asset, shot ORDER BY frame)) AS st FROM p)
    SELECT asset, shot, printf('%.2f', avg(d))::DOUBLE AS mean, printf('%.2f', arg_max(d, (abs(d), -frame)))::DOUBLE AS worst, arg_max(frame, (abs(d), -frame)) AS worst_frame, printf('%.2f', coalesce(max(st), 0.0))::DOUBLE AS step, coalesce(arg_max(frame, (st, frame)) FILTER (st IS NOT NULL), min(frame)) AS step_frame FROM s GROUP BY 1, 2""",
)
def _(t):
    side = lambda s: t.frame_metrics.where(c("side") == s).withColumn("luma", c("y_q50") * 255.3719)
    return J.shot_luma_delta(side("F"), side("O"), t.picture_blocks.withColumnRenamed("block_id", "shot"))


@query(
    "j9_block_of_frame",
    """SELECT f.asset, f.side, f.frame, p.block_id FROM frame_metrics f LEFT JOIN picture_blocks p ON p.asset = f.asset AND p.start_frame = (SELECT max(start_frame) FROM picture_blocks x WHERE x.asset = f.asset AND x.start_frame <= f.frame)""",
)
def _(t):
    return as_of(t.frame_metrics.select("asset", "side", "frame"), t.picture_blocks, ["asset"], "frame", "start_frame", ["block_id"]).select("asset", "side", "frame", "block_id")


@view
def spans(q: Dialect) -> str:
    """Line items as caption states, one per (supplier, order, part, line)."""
    return f"""SELECT l_suppkey AS asset, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, {q.day('l_shipdate')} AS start_frame, {q.day('l_shipdate')} + 1 + cast(floor(l_quantity / 8) as bigint) AS end_frame, l_linenumber AS z,
      {q.day('l_shipdate')} + cast(floor(l_quantity / 20) as bigint) AS frame, round(l_discount * 1000) AS x0, round(l_tax * 1000) AS y0, round(l_discount * 1000) + l_quantity AS x1, round(l_tax * 1000) + 20 AS y1
      FROM (SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, max(l_shipdate) AS l_shipdate, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax
        FROM {q.t('lineitem')} GROUP BY l_suppkey, l_orderkey, l_partkey, l_linenumber) x"""


@query(
    "j11_overlap_conflicts",
    """WITH b AS (SELECT *, max((end_frame, id)) OVER (PARTITION BY asset, z ORDER BY start_frame, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM spans)
    SELECT asset, z, id, p[2] AS with_id, least(p[1], end_frame) AS until FROM b WHERE p[1] > start_frame""",
)
def _(t):
    return J.overlap_conflicts(t.spans, ["asset", "z"])


@query(
    "j11_overlap_pairs",
    "SELECT a.asset, a.z, a.id AS a_id, b.id AS b_id FROM spans a JOIN spans b ON a.asset = b.asset AND a.z = b.z AND a.id < b.id AND a.start_frame < b.end_frame AND b.start_frame < a.end_frame",
)
def _(t):
    return J.overlap_pairs(t.spans, ["asset", "z"], 16)


@query(
    "j13_positional_diff",
    """WITH a AS (SELECT o_custkey AS k, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'O')
    SELECT k, pos, a.v AS ours, b.v AS theirs FROM a FULL JOIN b USING (k, pos) WHERE a.v IS DISTINCT FROM b.v""",
)
def _(t):
    side = lambda s: t.orders.where(c("o_orderstatus") == s).select(c("o_custkey").alias("k"), "o_orderkey", c("o_orderpriority").alias("v"))
    return J.positional_diff(side("F"), side("O"), ["k"], ["o_orderkey"], "v", width=1_000_000)


@query(
    "u4_order_equal",
    """WITH a AS (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders), b AS (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders)
    SELECT k, pos, a.v AS ours, b.v AS theirs FROM a FULL JOIN b USING (k, pos) WHERE a.v IS DISTINCT FROM b.v""",
)
def _(t):
    o = t.orders.select(c("o_custkey").alias("k"), "o_orderkey", "o_orderdate", c("o_orderkey").alias("v"))
    by_key = J.S.scan(o, ["k"], ["o_orderkey"], 1_000_000, n=J.S.position()).select("k", "n", "v")
    by_date = J.S.scan(o, ["k"], ["o_orderdate", "o_orderkey"], 365 * J.S.DAY_US, n=J.S.position()).select("k", "n", "v")
    return J.positional_diff(by_key, by_date, ["k"], ["n"], "v")


LEDGERS = """a AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderstatus AS v FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT o_custkey AS k, o_orderkey AS i, CASE WHEN o_totalprice > 450000 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderpriority <> '5-LOW' OR o_totalprice < 20000),
j AS (SELECT k, i, a.v IS DISTINCT FROM b.v AS bad FROM a FULL JOIN b USING (k, i))"""


def _ledgers(t):
    base = t.orders.select(c("o_custkey").alias("k"), c("o_orderkey").alias("i"), c("o_orderstatus").alias("v"), "o_orderpriority", "o_totalprice")
    after = base.where("o_orderpriority <> '5-LOW' OR o_totalprice < 20000").withColumn("v", F.when(c("o_totalprice") > 450000, "X").otherwise(c("v")))
    return base.where("o_orderpriority <> '5-LOW'"), after


@query("j20_ledger_equal", f"WITH {LEDGERS} SELECT k, count(*) AS entries, count(*) FILTER (bad) AS divergent, min(i) FILTER (bad) AS first_divergence, CASE WHEN count(*) FILTER (bad) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM j GROUP BY 1")
def _(t):
    return J.ledger_equal(*_ledgers(t), ["k"], "i", "v")


@query(
    "d8_scope_proof",
    f"""WITH {LEDGERS}, al AS (SELECT o_custkey AS k, o_orderkey AS i FROM orders WHERE o_totalprice > 430000), ch AS (SELECT k, i FROM j WHERE bad)
    (SELECT k, i, 'not_allowed' AS side FROM (SELECT * FROM ch EXCEPT SELECT * FROM al)) UNION ALL (SELECT k, i, 'not_changed' FROM (SELECT * FROM al EXCEPT SELECT * FROM ch))""",
)
def _(t):
    allowed = t.orders.where("o_totalprice > 430000").select(c("o_custkey").alias("k"), c("o_orderkey").alias("i"))
    return J.scope_proof(*_ledgers(t), allowed, ["k"], "i", "v")


@query(
    "j22_box_neighbours",
    """WITH k AS (SELECT asset, id AS state, frame, x0 - round_even((x1 - x0) * 0.2, 0) AS cx0, y0 - round_even((y1 - y0) * 0.2, 0) AS cy0, x1 + round_even((x1 - x0) * 0.2, 0) AS cx1, y1 + round_even((y1 - y0) * 0.2, 0) AS cy1 FROM spans)
    SELECT k.asset, state, k.frame, o.id AS neighbour FROM k JOIN spans o ON o.asset = k.asset AND o.id <> state AND o.start_frame <= k.frame AND k.frame < o.end_frame AND NOT (cx1 <= o.x0 OR o.x1 <= cx0 OR cy1 <= o.y0 OR o.y1 <= cy0)""",
)
def _(t):
    return J.box_neighbours(t.spans, width=16)


@view
def face_samples(q: Dialect) -> str:
    return f"SELECT asset, frame * 4 AS frame, max(y_q95) / 10 AS face_height FROM {q.t('frame_metrics')} GROUP BY asset, frame"


PERSON = """w AS (SELECT asset, window_id, f0, f1, f0 - f0 % 4 AS a FROM {src}), ins AS (SELECT w.asset, w.window_id, count(*) AS n, count(*) FILTER (face_height >= 0.06) AS k FROM w JOIN face_samples s ON s.asset = w.asset AND s.frame >= a AND s.frame <= f1 GROUP BY 1, 2),
e AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM ins i WHERE i.asset = w.asset AND i.window_id = w.window_id)),
lent AS (SELECT e.asset, e.window_id, face_height >= 0.06 AS f, row_number() OVER (PARTITION BY e.asset, e.window_id ORDER BY abs(s.frame - (f0 + f1) // 2), s.frame) AS rn FROM e JOIN face_samples s ON s.asset = e.asset),
pw AS (SELECT w.asset, w.window_id, coalesce(n, CASE WHEN f IS NOT NULL THEN 1 END, 0)::BIGINT AS sampled, coalesce(k, CASE WHEN f THEN 1 END, 0)::BIGINT AS with_face FROM w LEFT JOIN ins USING (asset, window_id) LEFT JOIN (SELECT * FROM lent WHERE rn = 1) l USING (asset, window_id)),
pv AS (SELECT *, sampled > 0 AND with_face >= greatest(1, round_even(sampled * (1.0e0 / 3), 0)) AS person FROM pw)"""


@query("g29_person_windows", f"WITH {PERSON.format(src='(SELECT asset, id AS window_id, start_frame AS f0, end_frame - 1 AS f1 FROM spans)')} SELECT asset, window_id, sampled, with_face, person FROM pv")
def _(t):
    windows = t.spans.select("asset", c("id").alias("window_id"), c("start_frame").alias("f0"), (c("end_frame") - 1).alias("f1"))
    return J.person_windows(windows, t.face_samples)


RULE_SRC = """(SELECT s.asset, s.id AS window_id, CASE WHEN z < 3 THEN s.start_frame WHEN z < 5 THEN s.start_frame + 2 ELSE b.start_frame * 4 END AS f0, CASE WHEN z < 3 THEN s.end_frame WHEN z < 5 THEN s.start_frame + 9 ELSE b.end_frame * 4 END AS f1
  FROM spans s LEFT JOIN picture_blocks b ON b.asset = s.asset AND b.block_id = s.z * 2 WHERE z < 5 OR b.asset IS NOT NULL)"""


@query(
    "j23_person_rule",
    f"""WITH {PERSON.format(src=RULE_SRC)} SELECT w.asset, w.window_id AS slot, w.f0, w.f1, sampled, with_face FROM pv JOIN w USING (asset, window_id) JOIN spans s ON s.asset = w.asset AND s.id = w.window_id WHERE person AND s.x0 <> 50""",
)
def _(t):
    slots = t.spans.select("asset", c("id").alias("slot"), F.when(c("x0") == 50, "Subject").otherwise("none").alias("identity"), F.when(c("z") < 3, c("start_frame")).alias("ref_in"), F.when(c("z") < 3, c("end_frame")).alias("ref_out"))
    shots = t.spans.where("z >= 3 AND z < 5").select("asset", c("id").alias("slot"), (c("start_frame") + 2).alias("f0"), (c("start_frame") + 9).alias("f1"))
    late = t.spans.where("z >= 5").select("asset", c("id").alias("slot"), (c("z") * 2).cast("long").alias("block_id"))
    blocks = late.join(t.picture_blocks, ["asset", "block_id"]).select("asset", "slot", (c("start_frame") * 4).alias("f0"), (c("end_frame") * 4).alias("f1"))
    return J.person_rule(slots, shots, blocks, t.face_samples)


BLANK = "clock AS (SELECT s_suppkey AS asset, unnest(range(0, 2600 + 10 * s_nationkey)) AS frame FROM supplier), bl AS (SELECT k.asset, k.frame FROM clock k WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.asset = k.asset AND s.start_frame <= k.frame AND k.frame < s.end_frame))"


def _clocks(t):
    return t.supplier.select(c("s_suppkey").alias("asset"), (c("s_nationkey") * 10 + 2600).cast("long").alias("frame_count"))


@query("w23_blank_frames", f"WITH {BLANK} SELECT asset, frame FROM bl")
def _(t):
    return J.blank_frames(t.spans, _clocks(t))


@query(
    "w23_blank_check",
    f"""WITH {BLANK}, de AS (SELECT DISTINCT asset, start_frame - 1 AS frame FROM spans) (SELECT *, 'undeclared' AS side FROM (SELECT * FROM bl EXCEPT SELECT * FROM de)) UNION ALL (SELECT *, 'covered' FROM (SELECT * FROM de EXCEPT SELECT * FROM bl))""",
)
def _(t):
    return J.blank_check(t.spans, _clocks(t), t.spans.select("asset", (c("start_frame") - 1).alias("frame")))


@query(
    "s18_plate_gaps",
    f"""WITH {BLANK}, n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM bl)
    SELECT asset, frame FROM n WHERE n <= 12 OR i IN (SELECT floor(k * (n / 12.0e0))::BIGINT FROM range(12) r(k))""",
)
def _(t):
    return J.plate_gaps(t.spans, _clocks(t))


@query(
    "w24_stack_slots",
    """WITH RECURSIVE n AS (SELECT asset, id, start_frame, end_frame, row_number() OVER (PARTITION BY asset ORDER BY start_frame, id) AS rn FROM spans),
    k AS (SELECT asset, rn, id, start_frame, end_frame, [end_frame] AS ends, 0::BIGINT AS slot FROM n WHERE rn = 1
      UNION ALL
      SELECT asset, rn, id, start_frame, end_frame, CASE WHEN p IS NULL THEN list_append(old, end_frame) ELSE list_transform(old, lambda e, i: CASE WHEN i = p THEN end_frame ELSE e END) END, coalesce(p - 1, len(old))::BIGINT
      FROM (SELECT n.*, k.ends AS old, list_position(list_transform(k.ends, lambda e: e <= n.start_frame), true) AS p FROM k JOIN n ON n.asset = k.asset AND n.rn = k.rn + 1) x)
    SELECT asset, id, start_frame, end_frame, slot FROM k""",
)
def _(t):
    return J.stack_slots(t.spans)


@query("w25_state_span", "SELECT asset, z, min(start_frame) FILTER (x0 >= 40) AS start_frame, max(start_frame) FILTER (x0 >= 40) + 1 AS end_frame FROM spans GROUP BY 1, 2")
def _(t):
    return J.state_span(t.spans, ["asset", "z"], "start_frame", "x0", 40)


TIMING = """w AS (SELECT DISTINCT asset, unnest(range(start_frame + CASE WHEN z = 5 THEN 1 ELSE 0 END, end_frame + CASE WHEN z >= 4 THEN 2 ELSE 0 END)) AS frame FROM spans), d AS (SELECT DISTINCT asset, frame FROM spans),
df AS ((SELECT *, 'missing' AS side FROM (SELECT * FROM w EXCEPT SELECT * FROM d)) UNION ALL (SELECT *, 'unexpected' FROM (SELECT * FROM d EXCEPT SELECT * FROM w)))"""


def _declared(t):
    """Spans as declared: the later layers end two frames after what is drawn, one layer starts a frame late."""
    return t.spans.withColumns({"start_frame": c("start_frame") + F.when(c("z") == 5, 1).otherwise(0), "end_frame": c("end_frame") + F.when(c("z") >= 4, 2).otherwise(0)})


@query("w26_timing_diff", f"WITH {TIMING} SELECT * FROM df")
def _(t):
    return J.timing_diff(_declared(t), t.spans)


@query(
    "w26_timing_report",
    f"WITH {TIMING}, g AS (SELECT asset, count(*) AS n, min(frame) AS f FROM df GROUP BY 1) SELECT s_suppkey AS asset, coalesce(n, 0) AS divergent, f AS first_divergence, CASE WHEN n IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict FROM supplier LEFT JOIN g ON asset = s_suppkey",
)
def _(t):
    return J.timing_report(J.timing_diff(_declared(t), t.spans), t.supplier.select(c("s_suppkey").alias("asset")))


@query("w35_hold_frames", "SELECT asset, id, unnest(range(greatest(start_frame, end_frame - 3), end_frame)) AS frame FROM spans")
def _(t):
    return t.spans.select("asset", "id", F.explode(T.hold_frames(c("start_frame"), c("end_frame"), 3)).alias("frame"))


@query(
    "g38_range_check",
    """WITH r AS (SELECT l_suppkey, l_orderkey AS frame, CASE WHEN l_linestatus = 'F' THEN 4.0 ELSE 1.0 END AS sc, l_linestatus, l_quantity * 0.9 + 14 AS lo, 200 + l_quantity AS hi FROM lineitem), k AS (SELECT *, lo < 16 * sc OR hi > 235 * sc AS bad FROM r)
    SELECT l_suppkey, l_linestatus, count(*) AS frames, min(lo) AS observed_min, max(hi) AS observed_max, count(*) FILTER (bad) AS failures, min(frame) FILTER (bad) AS first_failure, CASE WHEN count(*) FILTER (bad) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM k GROUP BY 1, 2""",
)
def _(t):
    frames = t.lineitem.select("l_suppkey", "l_linestatus", c("l_orderkey").alias("frame"), (c("l_quantity") * 0.9 + 14).alias("ymin"), (c("l_quantity") + 200).alias("ymax"))
    return J.range_check(frames, ["l_suppkey", "l_linestatus"], F.when(c("l_linestatus") == "F", 10).otherwise(8))
