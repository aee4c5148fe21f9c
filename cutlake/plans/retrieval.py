"""Retrieval queries."""

from pyspark.sql import functions as F

from cutlake.functions import text as X
from cutlake.operators import ledger as L
from cutlake.operators import retrieval as R
from cutlake.plans.base import Dialect, query, view
from cutlake.plans.filters import clips
from cutlake.plans.ledger import STRICT

c = F.col
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.ALIAS.items()) + "}"


def toks(expr: str) -> str:
    kept = f"list_filter(list_distinct(regexp_extract_all(lower({expr}), '[a-z0-9]{{2,}}')), lambda w: NOT list_contains({STOP}, w))"
    return f"list_distinct(list_concat({kept}, list_filter(list_transform({kept}, lambda w: ({ALIAS})[w]), lambda w: w IS NOT NULL)))"


@view
def clip_catalog(q: Dialect) -> str:
    return f"""SELECT doc_id, concat('src/', lpad(cast(doc_id as string), 8, '0')) AS path, concat('D', cast(doc_id as string)) AS clip_id, text,
      cast(n_chars as double) / 100 AS duration_s, cast(n_chars as double) / 40000 AS motion_speed, length(source) AS local_peaks, CASE lang WHEN 'en' THEN 'locked_or_nearly_locked' ELSE 'moving' END AS motion_label,
      CASE lang WHEN 'fr' THEN 2 WHEN 'de' THEN 1 ELSE 0 END AS poses, 0 AS faces, CASE WHEN lang <> 'es' THEN cast(n_chars % 256 as double) END AS luma_p50, cast(n_chars % 100 as double) AS sat_p50, cast(n_chars as double) / 7 AS laplacian_var FROM {q.t('documents')}"""


@view
def shot_roles(q: Dialect) -> str:
    return f"""SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN 'walking pair hold' WHEN item_id % 5 = 1 THEN 'the entrance of nothing' WHEN item_id % 5 = 2 THEN 'sport' ELSE '' END AS role, text AS reference_observation,
      CASE WHEN item_id % 2 = 0 THEN 'locked seated portrait' ELSE '' END AS composition, cast(length(text) as double) / 24 AS target_duration, CASE WHEN item_id % 3 > 0 THEN cast(length(text) % 256 as double) END AS target_luma, cast(length(text) % 100 as double) AS target_sat FROM {q.t('benchmark')}"""


@query("a2_tokens", f"WITH t AS (SELECT doc_id, {toks('text')} AS ts FROM documents) SELECT doc_id, len(ts)::INTEGER AS n, sha256(array_to_string(list_sort(ts), ' ')) AS digest FROM t")
def _(t):
    # dealt first: the table is one split and tokens are heavy
    found = t.documents.select("doc_id", "text").repartition("doc_id").select("doc_id", X.tokens(c("text")).alias("ts"))
    return found.select("doc_id", F.size("ts").alias("n"), F.sha2(F.array_join(F.array_sort("ts"), " "), 256).alias("digest"))


SHORTLIST = f"""r AS (SELECT *, {toks('role')} AS a, {toks("concat_ws(' ', reference_observation, composition)")} AS o, {toks("'steady ' || CASE WHEN id % 4 = 0 THEN 'people in motion' ELSE 'wide room' END")} AS q FROM shot_roles),
rr AS (SELECT *, list_distinct(a || o || q) AS al FROM r), k AS (SELECT *, {toks("path || ' ' || text")} AS ts FROM clip_catalog),
p AS (SELECT rr.id AS role_id, k.path, k.clip_id, 5.0 * len(list_intersect(a, ts)) + 3.0 * len(list_intersect(q, ts)) + 1.5 * len(list_intersect(o, ts)) AS words,
  CASE WHEN list_has_any(al, ['motion', 'sport', 'walking']) THEN least(3.0, motion_speed * 20) + least(2.0, local_peaks * 0.5) ELSE 0 END + CASE WHEN list_contains(al, 'walking') AND list_contains(ts, 'static') THEN -12 ELSE 0 END
  + CASE WHEN list_contains(al, 'sport') AND list_contains(ts, 'static') THEN -8 ELSE 0 END + CASE WHEN list_has_any(al, ['stable', 'hold', 'locked']) AND motion_label LIKE 'locked%' THEN 2 ELSE 0 END
  + CASE WHEN list_contains(al, 'human') AND (poses > 0 OR list_contains(ts, 'human')) THEN 1.5 ELSE 0 END + CASE WHEN list_contains(al, 'pair') THEN CASE WHEN poses >= 2 THEN 3 WHEN list_contains(ts, 'pair') THEN 1 ELSE 0 END ELSE 0 END
  + CASE WHEN duration_s + 1e-6 < target_duration THEN -20 ELSE 1 END + coalesce(greatest(0.0, 1.5 - abs(target_luma - luma_p50) / 64), 0) + greatest(0.0, 1 - abs(target_sat - sat_p50) / 128) + least(1.0, ln(1 + laplacian_var) / 8) AS num FROM rr, k)"""


def _roles(t):
    needs = F.concat(F.lit("steady "), F.when(c("id") % 4 == 0, "people in motion").otherwise("wide room"))
    return t.shot_roles.withColumn("substitute_requirements", F.array(needs))


def _catalog(t):
    none = F.array().cast("array<string>")
    return t.clip_catalog.withColumns({"semantic_groups": F.array("text"), "labels": none, "families": none})


@query(
    "a1_shortlist",
    f"""WITH {SHORTLIST}, s AS (SELECT role_id, path, clip_id, round(words + num, 6) AS score FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY score DESC, path) AS rank FROM s) SELECT * FROM n WHERE rank <= 20""",
)
def _(t):
    return R.shortlist(_roles(t), _catalog(t), t.clip_catalog, 20).select("role_id", "path", "clip_id", "score", "rank")


@query("j10_score_overlaps", f"WITH {SHORTLIST} SELECT role_id, path, words::DOUBLE AS word_score FROM p WHERE words > 0")
def _(t):
    found = R.score_overlaps(R.role_terms(_roles(t)), R.catalog_terms(_catalog(t), t.clip_catalog))
    return found.select("role_id", "path", "word_score")


@query(
    "a3_bed_penalty",
    """WITH f AS (SELECT l_linenumber AS state, l_returnflag AS text, 200.0 AS ink, round(avg(l_quantity), 3) AS bed, round(avg(l_tax) * 100, 3) AS sd FROM lineitem GROUP BY 1, 2),
    w AS (SELECT l_suppkey AS stem, l_partkey AS t0, l_linenumber AS state, l_returnflag AS text, l_quantity AS bed, l_tax * 317.77 AS sd FROM lineitem)
    SELECT stem, t0, round(sum(greatest(0.0, abs(ink - f.bed) - abs(ink - w.bed)) / greatest(abs(ink - f.bed), 1.0) + greatest(0.0, w.sd - f.sd) / 50), 3) AS penalty FROM w JOIN f USING (state, text) GROUP BY 1, 2""",
)
def _(t):
    ref = t.lineitem.groupBy(c("l_linenumber").alias("state"), c("l_returnflag").alias("text")).agg(F.round(F.avg("l_quantity"), 3).alias("bed"), F.round(F.avg("l_tax") * 100, 3).alias("sd"))
    windows = t.lineitem.select(c("l_suppkey").alias("stem"), c("l_partkey").alias("t0"), c("l_linenumber").alias("state"), c("l_returnflag").alias("text"), c("l_quantity").alias("bed"), (c("l_tax") * 317.77).alias("sd"))
    return R.bed_penalty(windows, ref.withColumn("ink", F.lit(200.0)), ["stem", "t0"])


ALLOW = f"""{STRICT}, cu AS (SELECT 'CLIP_' || c_custkey AS stem, c_mktsegment AS m FROM customer), al AS (SELECT stem FROM cu WHERE m <> 'BUILDING' AND stem NOT IN (SELECT stem FROM ws WHERE grade = 'NEVER')),
st AS (SELECT stem FROM (SELECT stem FROM cu WHERE m = 'HOUSEHOLD' UNION SELECT stem FROM ss WHERE grade = 'HERO' UNION SELECT stem FROM ws WHERE grade = 'HERO' OR ident = 'ME') WHERE stem NOT IN (SELECT stem FROM ws WHERE grade = 'NEVER' OR ident = 'NOTME'))"""


def _allowed(t, identity):
    stems = t.customer.select(F.concat(F.lit("CLIP_"), c("c_custkey").cast("string")).alias("stem"), "c_mktsegment")
    whole, parts = L.fold_parts(t.grade_events, strict=True)
    settled = L.effective_settled(stems.where("c_mktsegment = 'HOUSEHOLD'").select("stem"), t.grade_events)
    return R.allowed_clips(stems.select("stem"), whole, parts, stems.where("c_mktsegment = 'BUILDING'"), settled, identity)


@query("a4_allowed_clips", f"WITH {ALLOW} SELECT stem, false AS hero FROM al")
def _(t):
    return _allowed(t, False)


@query(
    "a4_allowed_identity_clips",
    f"WITH {ALLOW} SELECT stem, coalesce(stem IN (SELECT stem FROM ss WHERE grade = 'HERO' UNION SELECT stem FROM ws WHERE grade = 'HERO'), false) AS hero FROM al WHERE stem IN (SELECT stem FROM st) AND stem NOT IN (SELECT stem FROM ws WHERE grade = 'BROLL' OR ident = 'NOTME')",
)
def _(t):
    return _allowed(t, True)


@query(
    "a5_shot_score",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 20 AS luma, l_extendedprice / 300 AS sharp, (l_linenumber - 1) AS people, l_linenumber % 2 AS faces, l_discount * 2.5 AS fa, l_tax * 6 AS area, 0.9 + l_tax AS top, l_returnflag <> 'A' AS idn, l_linestatus = 'F' AS night, l_suppkey % 2 = 0 AS okk FROM lineitem),
    b AS (SELECT *, least(sharp, 300.0) / 300 AS base FROM p)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN luma < CASE WHEN night THEN 34 ELSE 45 END OR sharp < 15 THEN -1e9 WHEN NOT idn THEN base WHEN people = 0 THEN CASE WHEN okk AND sharp >= 60 THEN base * 0.2 ELSE -1e9 END
      ELSE base + CASE WHEN faces > 0 THEN 2 + CASE WHEN fa BETWEEN 0.004 AND 0.12 THEN 0.5 ELSE 0 END - CASE WHEN fa > 0.2 THEN 1.5 ELSE 0 END ELSE 1 - CASE WHEN area > 0.35 AND top > 0.97 THEN 1.5 ELSE 0 END END - CASE WHEN people > 2 THEN 0.6 ELSE 0 END END, 6) AS score FROM b""",
)
def _(t):
    s = R.shot_score(
        c("l_quantity") + 20, c("l_extendedprice") / 300, c("l_linenumber") - 1, c("l_linenumber") % 2, c("l_discount") * 2.5, c("l_tax") * 6, c("l_tax") + 0.9,
        c("l_returnflag") != "A", c("l_linestatus") == "F", c("l_suppkey") % 2 == 0,
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(s, 6).alias("score"))


@query(
    "a6_pool_windows",
    """WITH u AS (SELECT clip_id, greatest(0, frame_count - 48) AS usable FROM clip_tags), s AS (SELECT DISTINCT clip_id, CASE WHEN usable = 0 THEN 0 ELSE round_even(usable * i / 11.0, 0)::BIGINT END AS start_frame FROM u, range(12) r(i)) SELECT clip_id, start_frame, start_frame + 48 AS end_frame FROM s""",
)
def _(t):
    return R.pool_windows(clips(t), F.lit(48))


@query(
    "a6_window_start",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(round_even((l_extendedprice::BIGINT) * [0.10, 0.38, 0.66, 0.88][l_linenumber % 4 + 1]::DOUBLE, 0)::BIGINT, l_extendedprice::BIGINT)) AS start_frame FROM (SELECT * REPLACE (floor(l_extendedprice) AS l_extendedprice) FROM lineitem)""",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.window_start(F.floor("l_extendedprice"), c("l_linenumber")).alias("start_frame"))


@query(
    "a7_spread_assignment",
    """WITH p AS (SELECT DISTINCT world AS family, energy AS slot, clip_id FROM clip_tags UNION SELECT DISTINCT world, lighting, clip_id FROM clip_tags),
    s AS (SELECT *, row_number() OVER w - 1 AS seat, count(*) OVER (PARTITION BY family, slot) AS n, ('0x' || sha256('seed-1|' || family || '|' || slot)[1:12])::BIGINT AS o FROM p
      WINDOW w AS (PARTITION BY family, slot ORDER BY sha256('seed-1|' || family || '|' || slot || '|' || clip_id))),
    a AS (SELECT family, slot, clip_id, seat, n, v FROM s, range(1, 7) r(v) WHERE seat = (v + o) % n),
    f AS (SELECT *, min(slot) OVER (PARTITION BY family, v, clip_id) = slot AS first FROM a),
    m AS (SELECT f.family, f.slot, f.v, s.clip_id FROM f JOIN s ON s.family = f.family AND s.slot = f.slot AND s.seat = (f.seat + 6) % f.n WHERE NOT f.first),
    c AS (SELECT m.*, min(slot) OVER (PARTITION BY family, v, clip_id) = slot AND NOT EXISTS (SELECT 1 FROM f WHERE f.first AND f.family = m.family AND f.v = m.v AND f.clip_id = m.clip_id) AS free FROM m)
    SELECT family, slot, v::INTEGER AS variant, clip_id, 'first' AS choice FROM f WHERE first
    UNION ALL SELECT family, slot, v::INTEGER, clip_id, CASE WHEN free THEN 'second' ELSE 'conflict' END FROM c""",
)
def _(t):
    pools = t.clip_tags.select(c("world").alias("family"), c("energy").alias("slot"), "clip_id").unionByName(t.clip_tags.select(c("world").alias("family"), c("lighting").alias("slot"), "clip_id"))
    return R.spread_assignment(pools, 6, "seed-1")


@query(
    "a8_rank_windows",
    """WITH o AS (SELECT o_custkey AS slot, 'C' || o_orderkey % 9 AS clip_id, floor(o_totalprice / 400)::BIGINT AS s, max(o_totalprice / 3017) AS p05, max(150 + o_totalprice / 6011) AS p95 FROM (SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders) GROUP BY 1, 2, 3),
    b AS (SELECT o_custkey AS slot, 'C' || o_orderkey % 9 AS clip_id, floor(o_totalprice / 400)::BIGINT + 30 AS s FROM (SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders) WHERE o_orderstatus = 'F'),
    f AS (SELECT *, round(255.0 - 25.0 / 0.6, 2) AS hi, round(25.0 / 0.6, 2) AS lo FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.slot = o.slot AND b.clip_id = o.clip_id AND o.s < b.s + 48 AND b.s < o.s + 48)),
    m AS (SELECT *, round(greatest(hi - p95, p05 - lo), 2) AS margin FROM f WHERE p95 < hi OR p05 > lo)
    SELECT slot, clip_id, s AS start_frame, s + 48 AS end_frame, margin, row_number() OVER (PARTITION BY slot ORDER BY margin DESC, clip_id = 'C3', clip_id, s) AS rank FROM m""",
)
def _(t):
    price = F.floor("o_totalprice")
    start = F.floor(price / 400)
    base = t.orders.select(c("o_custkey").alias("slot"), F.concat(F.lit("C"), (c("o_orderkey") % 9).cast("string")).alias("clip_id"), start.alias("start_frame"), price.alias("p"), "o_orderstatus")
    options = base.groupBy("slot", "clip_id", "start_frame").agg((F.max(c("p")) / 3017).alias("p05"), F.max(c("p") / 6011 + 150).alias("p95")).withColumn("end_frame", c("start_frame") + 48).withColumn("plate_alpha", F.lit(0.6))
    siblings = base.where("o_orderstatus = 'F'").select("slot", "clip_id", (c("start_frame") + 30).alias("start_frame"), (c("start_frame") + 78).alias("end_frame"))
    return R.rank_windows(options, siblings, F.lit("C3"), ["slot"])
