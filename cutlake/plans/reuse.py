"""Reuse, family, trial and documented-method queries."""

from pyspark.sql import functions as F

from cutlake.operators import methods as M
from cutlake.operators import reuse as R
from cutlake.plans.base import Dialect, query, view

c = F.col


@view
def hashed_docs(q: Dialect) -> str:
    return f"SELECT {q.sha('text')} AS sha256, concat(source, '/', cast(doc_id as string)) AS path FROM {q.t('documents')}"


@query("g3_duplicate_groups", "SELECT sha256, path, count(*) OVER (PARTITION BY sha256) AS copies FROM hashed_docs QUALIFY copies > 1")
def _(t):
    return R.duplicate_groups(t.hashed_docs)


@query("g3_unique_content", "SELECT sum(n)::BIGINT AS files, count(*) AS unique_content, count(*) FILTER (n > 1) AS duplicate_groups FROM (SELECT sha256, count(*) AS n FROM hashed_docs GROUP BY 1) x")
def _(t):
    return R.unique_content(t.hashed_docs)


@view
def deliveries(q: Dialect) -> str:
    """Orders as rows, lines as slots, parts as masters; the return flag and line number say what kind of record it is."""
    return f"""SELECT row, slot, master_id, version, file, kind, prefix, max(ordinal) AS ordinal FROM (
      SELECT l_suppkey AS row, concat('p', cast(l_linenumber as string), cast({q.div('l_orderkey', '50')} as string)) AS slot, CASE WHEN l_tax > 0 THEN concat('CLIP_', cast(l_partkey as string)) END AS master_id, l_linestatus AS version,
        concat(l_returnflag, cast(l_orderkey as string)) AS file, l_orderkey * 1000000 + l_partkey AS ordinal,
        CASE WHEN l_returnflag = 'A' THEN 'base' WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'supersede' ELSE 'also' END ELSE CASE WHEN l_linestatus = 'F' THEN 'variant' ELSE 'historic' END END AS kind,
        CASE WHEN l_returnflag = 'R' THEN concat('v', l_linestatus, ':') WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'alt:' ELSE '' END AS prefix FROM {q.t('lineitem')}) x GROUP BY row, slot, master_id, version, file, kind, prefix"""


DELIVERED = """su AS (SELECT row, slot, arg_max((version, master_id, file), ordinal) AS s FROM deliveries WHERE kind = 'supersede' GROUP BY 1, 2),
ds AS (SELECT row, slot, version, master_id, file, false AS historic FROM deliveries d WHERE kind = 'base' AND NOT EXISTS (SELECT 1 FROM su WHERE su.row = d.row AND su.slot = d.slot) AND master_id IS NOT NULL
  UNION ALL SELECT row, slot, s[1], s[2], s[3], false FROM su WHERE s[2] IS NOT NULL
  UNION ALL SELECT row, prefix || slot, version, master_id, file, kind = 'historic' FROM deliveries WHERE kind IN ('also', 'variant', 'historic') AND master_id IS NOT NULL)"""


@query(
    "g4_reuse_map",
    f"WITH {DELIVERED}, k AS (SELECT master_id, count(*) AS uses, count(DISTINCT row) AS rows FROM ds GROUP BY 1) SELECT master_id, row, slot, version, file, historic, uses, rows FROM ds JOIN k USING (master_id)",
)
def _(t):
    return R.reuse_map(R.delivered_slots(t.deliveries))


@query("g5_first_ship", f"WITH {DELIVERED} SELECT master_id, min((row, slot))[1] AS first_row, min((row, slot))[2] AS first_slot, count(*) AS uses FROM ds GROUP BY 1")
def _(t):
    return R.first_ship(R.delivered_slots(t.deliveries))


@query("d7_usage_histogram", f"WITH {DELIVERED} SELECT master_id, count(*) AS uses, count(*) > 1 AS reused FROM ds GROUP BY 1")
def _(t):
    return R.usage_histogram(R.delivered_slots(t.deliveries))


@query(
    "g6_plan_health",
    """WITH r AS (SELECT * REPLACE (CASE WHEN row % 3 = 0 AND kind = 'base' THEN 'draft' ELSE kind END AS kind) FROM deliveries), a AS (SELECT row, count(*) FILTER (kind = 'base') AS b, count(*) FILTER (kind = 'base' AND master_id IS NULL) AS s, count(DISTINCT file) FILTER (kind = 'variant') AS v FROM r GROUP BY 1)
    SELECT s_suppkey AS row, coalesce(b, 0) AS base_records, coalesce(s, 0) AS sourceless, coalesce(v, 0) AS variants, CASE WHEN coalesce(b, 0) = 0 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status, coalesce(s, 0) * 2 > coalesce(b, 0) AS delta_warning, coalesce(v, 0) < 95 + s_nationkey AS too_few_variants
    FROM supplier LEFT JOIN a ON row = s_suppkey""",
)
def _(t):
    records = t.deliveries.withColumns({"variant": c("file"), "kind": F.when((c("row") % 3 == 0) & (c("kind") == "base"), "draft").otherwise(c("kind"))})
    return R.plan_health(records, t.supplier.select(c("s_suppkey").alias("row"), (c("s_nationkey") + 95).alias("expected_variants")))


@query(
    "g7_coverage_gap",
    """SELECT event_id AS row FROM events WHERE event_type IN ('click', 'view', 'error') AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(t):
    kind = c("event_type")
    tail = F.when(kind == "click", '"b": {"c": [{"Drive_File_Id": "x"}]}').when(kind == "view", '"last_delivery_note": {}').when(kind == "error", '"today_files": [1]').when(kind == "signup", '"today_files": [ ]').otherwise('"note": "delivery"')
    registry = t.events.select(c("event_id").alias("row"), "user_id", F.concat(F.lit('{"props": '), "props", F.lit(", "), tail, F.lit("}")).alias("document"))
    declared = t.events.join(t.customer.where("c_mktsegment = 'BUILDING'"), c("user_id") == c("c_custkey"), "left_semi").select(c("event_id").alias("row"))
    return R.coverage_gap(registry, declared).select("row")


@query(
    "g8_reuse_violations",
    """WITH s AS (SELECT l_suppkey AS project, l_orderkey AS block_id, l_partkey AS source FROM lineitem), b AS (SELECT o_orderkey AS block_id, CASE WHEN o_totalprice <= 60000 THEN NULL WHEN o_orderstatus = 'F' THEN 'g1' WHEN o_orderstatus = 'O' THEN 'g2' ELSE '' END AS g FROM orders)
    SELECT project, source, count(*) AS uses FROM s LEFT JOIN b USING (block_id) GROUP BY 1, 2 HAVING count(*) > 1 AND (min(coalesce(g, '')) <> max(coalesce(g, '')) OR min(coalesce(g, '')) = '')""",
)
def _(t):
    slots = t.lineitem.select(c("l_suppkey").alias("project"), c("l_orderkey").alias("block_id"), c("l_partkey").alias("source"))
    group = t.orders.select(c("o_orderkey").alias("block_id"), F.when(c("o_totalprice") <= 60000, None).when(c("o_orderstatus") == "F", "g1").when(c("o_orderstatus") == "O", "g2").otherwise("").alias("repeat_group"))
    blocks = slots.select("project", "block_id").distinct().join(group, "block_id")
    return R.reuse_violations(slots, blocks)


@view
def family_slots(q: Dialect) -> str:
    return f"""SELECT l_suppkey AS family, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN NULL ELSE concat(l_returnflag, l_linestatus) END AS variant, CASE WHEN l_linenumber >= 7 AND l_tax <= 0.03e0 THEN 8 ELSE l_linenumber END AS slot_id, CASE WHEN max(l_tax) > 0.07e0 THEN 'wide' ELSE 'close' END AS role, 24 AS frames,
      cast({q.div('max(l_partkey)', '8')} as string) AS source_sha256, cast(max(l_quantity) as bigint) AS source_start_frame, cast(max(l_quantity) as bigint) + 24 AS source_end_frame FROM {q.t('lineitem')}
      GROUP BY l_suppkey, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN NULL ELSE concat(l_returnflag, l_linestatus) END, CASE WHEN l_linenumber >= 7 AND l_tax <= 0.03e0 THEN 8 ELSE l_linenumber END"""


@query(
    "g9_family_audit",
    """WITH m AS (SELECT * FROM family_slots WHERE variant IS NULL), v AS (SELECT * FROM family_slots WHERE variant IS NOT NULL), w AS (SELECT DISTINCT v.family, v.variant, m.slot_id, m.role AS mr, m.frames AS mf, m.source_sha256 AS ms FROM v JOIN m USING (family)),
    j AS (SELECT coalesce(w.family, v.family) AS family, coalesce(w.variant, v.variant) AS variant, coalesce(w.slot_id, v.slot_id) AS slot_id, mr, mf, ms, v.role, v.frames, v.source_sha256 AS s, v.source_start_frame AS a, v.source_end_frame AS b FROM w FULL JOIN v ON w.family = v.family AND w.variant = v.variant AND w.slot_id = v.slot_id),
    p AS (SELECT family, variant, count(*) FILTER (ms IS NOT NULL AND s IS NULL) AS missing, count(*) FILTER (ms IS NULL) AS extra, count(*) FILTER (s IS NOT NULL AND ms IS NOT NULL AND (role <> mr OR frames <> mf)) AS contract, count(*) FILTER (s <> ms) AS changed,
      max(s) FILTER (slot_id = 1) AS op, max(ms) FILTER (slot_id = 1) AS mo, list_sort(list((slot_id, s, a, b)) FILTER (s IS NOT NULL)) AS pk FROM j GROUP BY 1, 2),
    x AS (SELECT p.*, min(variant) OVER (PARTITION BY family, pk) AS fp, CASE WHEN op IS NOT NULL THEN min(variant) OVER (PARTITION BY family, op) END AS fo, count(*) OVER (PARTITION BY family) AS nv, (SELECT count(*) FROM m WHERE m.family = p.family) AS sz FROM p)
    SELECT family, variant, changed, round(changed / sz, 4) AS ratio, concat_ws(',', CASE WHEN nv < 5 THEN 'too_few_variants' END, CASE WHEN missing > 0 THEN 'missing_slots' END, CASE WHEN extra > 0 THEN 'extra_slots' END, CASE WHEN contract > 0 THEN 'contract_changed' END,
      CASE WHEN variant <> fp THEN 'duplicate_package' END, CASE WHEN op = mo THEN 'opening_not_new' END, CASE WHEN variant <> fo THEN 'opening_reused' END, CASE WHEN changed < 4 THEN 'too_few_changes' END, CASE WHEN changed / sz + 1e-12 < 0.75 THEN 'ratio_too_low' END) AS faults,
      CASE WHEN nv >= 5 AND missing = 0 AND extra = 0 AND contract = 0 AND variant = fp AND coalesce(op <> mo, true) AND coalesce(variant = fo, true) AND changed >= 4 AND changed / sz + 1e-12 >= 0.75 THEN 'PASS' ELSE 'FAIL' END AS status FROM x""",
)
def _(t):
    return R.family_audit(t.family_slots, F.lit(1), min_variants=5, min_changed=4, min_ratio=0.75)


MATRIX = """fs AS (SELECT family, coalesce(variant, 'master') AS variant, slot_id, source_sha256 FROM family_slots), sz AS (SELECT family, count(DISTINCT slot_id) AS n FROM fs GROUP BY 1),
mx AS (SELECT a.family, a.variant AS a, b.variant AS b, count(*) AS k FROM fs a JOIN fs b ON a.family = b.family AND a.slot_id = b.slot_id AND a.source_sha256 = b.source_sha256 AND a.variant < b.variant GROUP BY 1, 2, 3)"""


def _family(t):
    return t.family_slots.withColumn("variant", F.coalesce("variant", F.lit("master")))


@query("g10_distance_matrix", f"WITH {MATRIX} SELECT family, a, b, n - k AS changed, round((n - k) / n, 4) AS ratio FROM mx JOIN sz USING (family)")
def _(t):
    return R.distance_matrix(_family(t))


@query("g10_closest_variants", f"WITH {MATRIX}, u AS (SELECT DISTINCT family, variant FROM fs), r AS (SELECT x.family, n - coalesce(k, 0) AS changed, x.variant AS a, y.variant AS b, row_number() OVER (PARTITION BY x.family ORDER BY n - coalesce(k, 0), x.variant, y.variant) AS rn FROM u x JOIN u y ON x.family = y.family AND x.variant < y.variant JOIN sz ON sz.family = x.family LEFT JOIN mx ON mx.family = x.family AND mx.a = x.variant AND mx.b = y.variant) SELECT family, changed, a, b FROM r WHERE rn = 1")
def _(t):
    return R.closest_variants(_family(t))


@query(
    "g11_frame_distance_pairs",
    """WITH u AS (SELECT min(vec_id) AS id, CAST(embedding AS DOUBLE[]) AS v, count(*) AS copies FROM embeddings GROUP BY embedding),
    d AS (SELECT a.id AS a, b.id AS b, a.copies AS a_copies, b.copies AS b_copies, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / len(a.v) AS distance FROM u a JOIN u b ON a.id < b.id)
    SELECT a, b, a_copies, b_copies, round(distance, 9) AS distance FROM d WHERE distance <= 0.1""",
)
def _(t):
    return R.frame_distance_pairs(t.embeddings, "vec_id", "embedding", 0.1, 64).withColumn("distance", F.round("distance", 9))


@query(
    "g20_shot_stats",
    """WITH f AS (SELECT l_suppkey AS asset, l_linenumber AS shot, l_quantity AS lum_mean, CASE WHEN l_tax < 0.02 THEN NULL ELSE l_discount END AS sat_mean, l_quantity * 7 AS hue, [l_discount, l_tax, l_quantity / 500] AS h FROM lineitem),
    b AS (SELECT asset, shot, i - 1 AS bin, round(avg(h[i]), 9) AS share FROM f, range(1, 4) r(i) GROUP BY 1, 2, 3), t AS (SELECT asset, shot, arg_max(bin, (share, -bin)) AS bin FROM b GROUP BY 1, 2)
    SELECT f.asset, f.shot, count(*) AS frames, median(lum_mean) AS lum_mean, median(sat_mean) AS sat_mean, round((degrees(atan2(sum(round(sin(radians(hue)), 12)), sum(round(cos(radians(hue)), 12)))) % 360 + 360) % 360, 6) AS hue_mean, max(bin)::INTEGER AS dominant_bin FROM f JOIN t USING (asset, shot) GROUP BY 1, 2""",
)
def _(t):
    frames = t.lineitem.select(
        c("l_suppkey").alias("asset"), c("l_linenumber").alias("shot"), c("l_quantity").alias("lum_mean"), F.when(c("l_tax") < 0.02, F.lit(float("nan"))).otherwise(c("l_discount")).alias("sat_mean"), (c("l_quantity") * 7).alias("hue"),
        F.array(c("l_discount"), c("l_tax"), c("l_quantity") / 500).alias("hist"),
    )
    return R.shot_stats(frames, ["asset", "shot"], ["lum_mean", "sat_mean"], "hue", "hist")


@query(
    "g24_feasibility_ratio",
    """WITH a AS (SELECT o_custkey AS project, count(*) AS blocks, count(*) FILTER (o_orderstatus <> 'P') AS exact, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 450000) AS missing FROM orders GROUP BY 1)
    SELECT *, round(exact / blocks, 8) AS ratio, exact / blocks < 0.8 AS mode_switch, CASE WHEN missing > 0 OR exact / blocks < 0.8 THEN 'BLOCKED' ELSE 'PASS' END AS status FROM a""",
)
def _(t):
    cover = F.when(c("o_orderstatus") != "P", "exact_scene_available").when(c("o_totalprice") > 450000, "missing").otherwise("role_equivalent_substitute")
    return R.feasibility_ratio(t.orders.select(c("o_custkey").alias("project"), cover.alias("coverage")))


METRICS = ["views", "reach", "likes", "saves", "shares"]
TRIALS = """tr AS (SELECT user_id AS trial, CASE WHEN value > 35 THEN '24h' ELSE '72h' END AS \"window\", CASE event_type WHEN 'view' THEN 'views' WHEN 'click' THEN 'reach' WHEN 'error' THEN 'likes' WHEN 'signup' THEN 'saves' ELSE 'shares' END AS metric, value, event_id FROM events),
f AS (SELECT trial, \"window\", metric, max(value) AS value, count(*) AS n FROM tr GROUP BY 1, 2, 3)"""


def _trials(t):
    name = F.when(c("event_type") == "view", "views").when(c("event_type") == "click", "reach").when(c("event_type") == "error", "likes").when(c("event_type") == "signup", "saves").otherwise("shares")
    return t.events.select(c("user_id").alias("trial"), F.when(c("value") > 35, "24h").otherwise("72h").alias("window"), name.alias("metric"), "value")


@query(
    "g34_trial_metrics",
    f"WITH {TRIALS} SELECT trial, \"window\", " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in METRICS) + ", false AS duplicated, concat_ws(',', " + ", ".join(f"CASE WHEN count(*) FILTER (metric = '{m}') = 0 THEN '{m}' END" for m in METRICS) + ") AS withheld FROM f GROUP BY 1, 2",
)
def _(t):
    once = _trials(t).groupBy("trial", "window", "metric").agg(F.max("value").alias("value"))
    return R.trial_metrics(once, METRICS)


@query("g34_duplicate_snapshots", f"WITH {TRIALS} SELECT trial, \"window\", bool_or(n > 1) AS duplicated FROM f GROUP BY 1, 2")
def _(t):
    return R.trial_metrics(_trials(t), METRICS).select("trial", "window", "duplicated")


@query("g35_comparable_trials", f"WITH {TRIALS} SELECT \"window\", metric, count(DISTINCT trial) AS trials, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM f GROUP BY 1, 2 HAVING count(DISTINCT trial) >= 3")
def _(t):
    once = _trials(t).groupBy("trial", "window", "metric").agg(F.max("value").alias("value"))
    return R.comparable_trials(once).withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query(
    "d1_cadence_stats",
    """WITH s AS (SELECT asset, (end_frame - start_frame) / 7.3e0 AS s FROM spans) SELECT asset, count(*) AS shots, round(avg(s), 6) AS mean_s, round(min(s), 6) AS min_s, round(max(s), 6) AS max_s, count(*) FILTER (s < 0.5) AS bursts, round(median(s), 6) AS median_s FROM s GROUP BY 1""",
)
def _(t):
    return M.cadence_stats(t.spans, ["asset"], 7.3)


@query(
    "d2_cut_density",
    """WITH a AS (SELECT asset, frame // 30 AS bin, count(*) AS n FROM supplier_days WHERE b < 20 GROUP BY 1, 2), r AS (SELECT asset, frame // 30 AS bin, count(*) AS n FROM supplier_days WHERE b >= 20 GROUP BY 1, 2),
    s AS (SELECT asset, unnest(range(0, max(bin) + 1)) AS bin FROM (SELECT * FROM a UNION ALL SELECT * FROM r) GROUP BY 1) SELECT asset, bin, coalesce(a.n, 0) AS ours, coalesce(r.n, 0) AS reference FROM s LEFT JOIN a USING (asset, bin) LEFT JOIN r USING (asset, bin)""",
)
def _(t):
    return M.cut_density(t.supplier_days.where("b < 20"), t.supplier_days.where("b >= 20"), "asset", "frame", 30.0)


@query(
    "d4_fit_grid",
    """WITH f AS (SELECT asset, count(*) AS n, regr_slope(a, frame) AS s, regr_intercept(a, frame) AS p, regr_syy(a, frame) AS yy, regr_sxy(a, frame) AS xy, regr_sxx(a, frame) AS xx FROM (SELECT asset, frame, a + frame * 2 AS a FROM supplier_days) GROUP BY 1)
    SELECT asset, n, round(p, 4) AS phase, round(s, 6) AS step, round(60 / s, 4) AS bpm, round(sqrt(greatest(0.0, yy - xy * xy / xx) / n), 4) AS rms FROM f""",
)
def _(t):
    return M.fit_grid(t.supplier_days.withColumn("t", c("a") + c("frame") * 2), ["asset"], "frame", "t")


@query(
    "d5_word_consensus",
    """WITH v AS (SELECT l_suppkey AS asset, l_orderkey // 100 AS word, l_orderkey // 100 * 0.3e0 + l_quantity / 6 AS t, l_orderkey // 100 * 0.3e0 - l_discount * 10 AS w FROM lineitem), m AS (SELECT asset, word, median(t) AS m, count(*) AS votes FROM v WHERE t - w >= 1.5 AND w + 12 - t >= 1.5 GROUP BY 1, 2)
    SELECT asset, word, votes, round(max(m) OVER (PARTITION BY asset ORDER BY word), 6) AS time FROM m""",
)
def _(t):
    word = F.floor(c("l_orderkey") / 100)
    votes = t.lineitem.select(c("l_suppkey").alias("asset"), word.alias("word"), (word * 0.3 + c("l_quantity") / 6).alias("t"), (word * 0.3 - c("l_discount") * 10).alias("w"))
    return M.word_consensus(votes, ["asset"], "word", "t", "w")


@query(
    "d6_sustained_band",
    """WITH l AS (SELECT asset, hop, flux - 90 AS lv FROM hops), p AS (SELECT asset, hop, lv, quantile_cont(lv, 0.9) OVER (PARTITION BY asset ORDER BY hop RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS q FROM l),
    i AS (SELECT asset, hop, hop - row_number() OVER (PARTITION BY asset ORDER BY hop) AS g FROM p WHERE lv - q BETWEEN -90 AND -12) SELECT asset, min(hop) AS start, max(hop) + 1 AS "end" FROM i GROUP BY asset, g HAVING (max(hop) + 1 - min(hop)) * 0.2 >= 0.4""",
)
def _(t):
    return M.sustained_band(t.hops.withColumn("level", c("flux") - 90), ["asset"], "hop", "level", 0.2, low=-90.0, width=256)
